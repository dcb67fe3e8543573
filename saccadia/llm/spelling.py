"""Spelling variants: words one edit apart, found by dense comparison of padded code-point matrices.

Where one code point is inserted, deleted or replaced, the common prefix and the common suffix of two words together reach the
longer length minus one. A block of words is a matrix of code points; two blocks are compared column by column from either end,
which gives the prefix and the suffix lengths of all pairs of rows at once. Only blocks that can hold such pairs meet: a word
is cut into PARTS parts, the edit leaves all but one of them as they are, so the two words agree on what is before and what is
behind that part, and a block holds words that do. A pair counts in the block of the part that holds its first difference,
therefore once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, whole_groups
from .near_dup import in_tiles

#: Maximal runs of letters; the characters are a fixed value of the operator.
LETTERS = "A-Za-zÀ-ÿ"
#: Parts of a word.
PARTS = 3
#: Words that one comparison holds; a larger block is cut into tiles that meet two by two.
TILE = 1024
#: Up to this size blocks are compared by shifting the sorted words against themselves, many blocks at once.
SMALL = 16
#: Code points compared at a time.
CELLS = 1 << 22


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, hurt_every: int = 31) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only) with their number of occurrences.

    Where ``hurt_every`` divides the crc32 of ``<doc_id>:<run>``, the code point number crc32 % length is deleted first; NULL
    doc_id is written as nothing. Only runs of ``least_length`` code points, counted afterwards, and ``least_count``
    occurrences stay. NULL texts have no runs, whole texts are read.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    at = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", at.alias("h")).withColumn("p", (F.col("h") % F.length("run")).cast("int"))
    hurt = F.concat(F.substring("run", 1, F.col("p")), F.expr("substring(run, p + 2)"))
    word = F.when(F.col("h") % hurt_every == 0, hurt).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def placed(words: DataFrame) -> DataFrame:
    """(m, part, key, word, times): a word as one of m code points and as the longer one of m + 1, once per part and block.

    ``key`` hashes what is before and behind the part; words of equal hashes but other letters only meet in vain.
    """
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size - 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    before, behind = F.expr(f"left(word, cast((part * m) div {PARTS} as int))"), F.expr(f"right(word, cast(m - ((part + 1) * m) div {PARTS} as int))")
    return rows.select("m", "part", F.xxhash64(before, behind).alias("key"), "word", "times")


def code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words padded behind, the same padded in front, and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    within = np.arange(width)
    left, right = np.zeros((2, len(words), width), np.uint32)
    left[within < sizes[:, None]] = flat
    right[within >= width - sizes[:, None]] = flat
    return left, right, sizes


def _same(a: np.ndarray, b: np.ndarray, columns: Iterable[int]) -> np.ndarray:
    """Equal columns from the first one on, for every pair of rows that broadcasting makes."""
    count = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int32)
    alive = np.ones(count.shape, bool)
    for c in columns:
        alive &= (a[..., c] == b[..., c]) & (a[..., c] != 0)
        if not alive.any():
            break
        count += alive
    return count


def one_edit(left_a, right_a, size_a, left_b, right_b, size_b, m: int, part) -> np.ndarray:
    """Which pairs are one edit apart, with the shorter word of m code points and the first difference in ``part``."""
    width = left_a.shape[-1]
    prefix = _same(left_a, left_b, range(width))
    suffix = _same(right_a, right_b, range(width - 1, -1, -1))
    longer, shorter = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    # a word and itself share more than that; a first difference behind the end counts for the last part
    cuts = np.array([p * m // PARTS for p in range(1, PARTS)])
    of_part = (prefix[..., None] >= cuts).sum(axis=-1)
    return (shorter == m) & (prefix + suffix >= longer - 1) & ((prefix < longer) | (size_a != size_b)) & (of_part == part)


class _Near:
    """Sums over the near words of each word of a table: their number, and the most frequent of them."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n, self.count, self.best = words, n, np.zeros(len(words), np.int64), {}

    def add(self, of: np.ndarray, near: np.ndarray) -> None:
        np.add.at(self.count, of, 1)
        for a, b in zip(of.tolist(), near.tolist()):
            key = (-int(self.n[b]), self.words[b])
            if a not in self.best or key < self.best[a]:
                self.best[a] = key

    def rows(self) -> pa.RecordBatch:
        found = np.flatnonzero(self.count)
        best = [self.best[k] for k in found.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([self.words[k] for k in found.tolist()], pa.string()), pa.array(self.count[found]),
                                           pa.array([-b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
                                          ["word", "n_near", "form_n", "form"])


def _compare(keys: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            columns = {k: table.column(k).to_numpy() for k in keys}
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in columns.values()])
            group, at = np.cumsum(new) - 1, np.flatnonzero(new)
            sizes = np.diff(np.append(at, table.num_rows))
            words, n = table.column("word").to_pylist(), table.column("times").to_numpy()
            near = _Near(words, n)
            m, part = columns["m"].astype(np.int64), columns["part"].astype(np.int64)
            # small blocks: the same shift for all of them, words of equal m together so that no word pads another
            small = 0 if "lo" in keys else SMALL
            spot = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= small))
            for length in np.unique(m[spot]).tolist():
                some = spot[m[spot] == length]
                step = max(SMALL, CELLS // (length + 1))
                for s in range(1, SMALL):
                    i = some[:-s][group[some[:-s]] == group[some[s:]]] if len(some) > s else some[:0]
                    if not len(i):
                        break
                    for a in range(0, len(i), step):
                        x, y = i[a:a + step], i[a:a + step] + s
                        (lx, rx, sx), (ly, ry, sy) = (code_points([words[k] for k in z.tolist()], length + 1) for z in (x, y))
                        hit = one_edit(lx, rx, sx, ly, ry, sy, length, part[x])
                        near.add(x[hit], y[hit])
                        near.add(y[hit], x[hit])
            # large blocks: every row against every row, rows of the block's first tile against those of the second
            for g in np.flatnonzero(sizes > small).tolist():
                rows = np.arange(at[g], at[g] + sizes[g])
                length, its_part = int(m[at[g]]), int(part[at[g]])
                left, right, size = code_points([words[k] for k in rows.tolist()], length + 1)
                tile = table.column("tile").to_numpy()[rows] if "lo" in keys else None
                step = max(1, CELLS // (len(rows) * 4))
                for a in range(0, len(rows), step):
                    z = slice(a, a + step)
                    hit = one_edit(left[z, None], right[z, None], size[z, None], left[None], right[None], size[None], length, its_part)
                    if tile is not None and columns["lo"][at[g]] != columns["hi"][at[g]]:
                        hit &= tile[z, None] != tile[None]  # pairs inside a tile belong to its own meeting
                    i, j = np.nonzero(hit)
                    near.add(rows[i + a], rows[j])
            if near.count.any():
                yield near.rows()

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have near words: how many, and the most frequent of them."""
    rows = placed(words.withColumnRenamed("n", "times"))
    keys, out = ["m", "part", "key"], "word string, n_near long, form_n long, form string"
    tile = F.greatest(F.lit(SMALL), F.least(F.lit(TILE), F.expr(f"cast({CELLS} div (m + 1) as int)")))
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > tile)
    sized = rows.join(large, keys, "left")
    plain = (sized.where("n is null").repartition(*keys).sortWithinPartitions(*keys, "word").select(*keys, "word", "times")
             .mapInArrow(_compare(keys), out))
    pairs = [*keys, "lo", "hi"]
    tiled = (in_tiles(sized.where("n is not null"), tile, "word").repartition(*pairs).sortWithinPartitions(*pairs, "word")
             .select(*pairs, "tile", "word", "times").mapInArrow(_compare(pairs), out))
    best = F.min(F.struct((-F.col("form_n")).alias("down"), "form"))
    return plain.union(tiled).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.down")).alias("form_n"), F.col("b.form").alias("form"))


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, hurt_every: int = 31, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``word_counts``.

    The form is the near word of largest n, ties to the smaller one in code-point order, where that n is ``ratio`` times the
    word's own at least. The root follows forms to the last; a chain is no longer than the powers of ``ratio`` up to the
    largest n. An empty table, or one of NULL texts, gives no words; other columns may have any name.
    """
    words = stage(word_counts(docs, least_length, least_count, hurt_every), "words")
    near = near_words(words)
    enough = F.col("form_n") >= ratio * F.col("n")
    named = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"),
        F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    most = named.agg(F.max("n")).first()[0] or 1
    links = named.where("form is not null").select("word", F.col("form").alias("root"))
    # each round doubles the steps taken
    for _ in range(max(0, math.ceil(math.log2(max(1, math.log(most, ratio)))))):
        links = stage(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "links")
    return named.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
