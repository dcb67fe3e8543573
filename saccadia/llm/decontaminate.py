"""Benchmark decontamination by spaced seeds: hashes that ignore some word positions find overlaps despite substitutions.

A mask is laid over every run of words; only the words under its ones are hashed, so a word replaced under a zero does not
hide the passage. Hashes of the benchmark items and of the documents are joined, and every hit fixes an alignment. Along it
the words are compared one by one, and every ungapped window of enough equal words and a large enough share of them counts.

The masks together hit every window of 12 to 20 words that counts (tests walk all of them), and all of 21 to 24 words that
were drawn at random.

The benchmark is the build side and is cut into blocks of bounded size, one broadcast each; the documents never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, stage, text_or_empty

#: Masks over consecutive words; a one is a word that must be equal.
MASKS = ("11010111", "110100001011", "111011001", "111001010001", "1101111", "100011111", "1101100011")
#: A window of an alignment is an overlap from this many equal words on, or from all words of a shorter item,
LEAST_WORDS = 12
#: and with at least this share of equal words.
LEAST_SHARE = 0.75
#: Words of the benchmark that one broadcast block holds, about.
BLOCK_WORDS = 200_000

#: Everything between words: white space, control characters and ASCII punctuation.
_GAPS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_FACTORS = mix64(np.arange(11, 11 + max(map(len, MASKS)), dtype=np.uint64)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_GAPS).split()


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask at every position where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)))
    for k in _offsets(mask):
        out += words[k:k + n] * _FACTORS[k]
    return mix64(out)


class Items:
    """One block of the benchmark: words of its items and, per mask, their sorted seed hashes."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes = WordHashes()
        found = [(i, hashes.of(words_of(t))) for i, t in rows]
        self.items = [(i, w) for i, w in found if len(w)]
        shortest = min(map(len, MASKS))
        lengths = {len(w) for _, w in self.items if len(w) < max(map(len, MASKS))}
        #: items too short for a mask are looked up whole
        self.masks = [*MASKS, *("1" * n for n in sorted(lengths))] if lengths else list(MASKS)
        self.tables = []
        for mask in self.masks:
            seeds, owner, place = [], [], []
            for k, (_, w) in enumerate(self.items):
                if len(mask) == len(w) or (set(mask) != {"1"} and len(w) >= shortest):
                    s = _seeds(w, mask)
                    seeds.append(s)
                    owner.append(np.full(len(s), k))
                    place.append(np.arange(len(s)))
            joined = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
            order = np.argsort(joined, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(joined >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((joined[order], np.concatenate(owner)[order] if seeds else order, np.concatenate(place)[order] if seeds else order, seen))

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, equal words, words of the window, first word in the text): the best window per item."""
        hits: set[tuple[int, int]] = set()
        for mask, (seeds, owner, place, seen) in zip(self.masks, self.tables, strict=True):
            mine = _seeds(words, mask)
            spot = np.flatnonzero(seen[(mine >> np.uint64(44)).astype(np.int64)])
            if not len(spot) or not len(seeds):
                continue
            lo, hi = np.searchsorted(seeds, mine[spot], side="left"), np.searchsorted(seeds, mine[spot], side="right")
            for p, a, b in zip(spot[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                hits.update((int(owner[j]), p - int(place[j])) for j in range(a, b))
        best: dict[int, tuple[int, int, int]] = {}
        for k, shift in hits:
            item = self.items[k][1]
            first, last = max(0, -shift), min(len(item), len(words) - shift)
            found = best_window(item[first:last] == words[first + shift:last + shift], min(LEAST_WORDS, len(item)))
            if found:
                equal, length, begin = found
                best[k] = max(best.get(k, (0, 0, 0)), (equal, -length, -(begin + first + shift)))
        return [(self.items[k][0], e, -n, -at) for k, (e, n, at) in sorted(best.items(), key=lambda x: (x[0], x[1]))]


def best_window(equal: np.ndarray, least: int, share: float = LEAST_SHARE) -> tuple[int, int, int] | None:
    """(equal words, length, start) of the window with the most equal words among those of ``least`` and of ``share``, if any.

    ``score`` rises where words are equal and falls where they are not, so a window of the share is one whose end is no lower
    than its start. For every end the first such start is the best one.
    """
    if int(equal.sum()) < least:
        return None
    count = np.concatenate(([0], np.cumsum(equal)))
    score = count - share * np.arange(len(count)) + 1e-9 * np.arange(len(count))
    start = np.searchsorted(-np.minimum.accumulate(score), -score)
    inside = count - count[start]
    end = int(np.argmax(inside))
    if inside[end] < least:
        return None
    begin, end = int(np.flatnonzero(equal[start[end]:])[0] + start[end]), int(np.flatnonzero(equal[:end])[-1] + 1)
    return int(count[end] - count[begin]), end - begin, begin


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal words, length, start) of the segment with the largest sum of 1 per equal and -2 per different word."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.flatnonzero(sums[:end + 1] == low[end])[-1])
    return int(equal[begin:end].sum()), end - begin, begin


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


def _per_block(docs: DataFrame, benchmark: DataFrame, apply: Callable, schema: str) -> DataFrame | None:
    """Run ``apply(items)`` over the documents once per block; further blocks are written as they are done."""
    spark = docs.sparkSession
    found = None
    for n, rows in enumerate(_blocks(benchmark)):
        block = spark.sparkContext.broadcast(Items(rows))
        one = docs.mapInArrow(apply(block), schema)
        if found is not None:
            found = (stage(found, "block") if n == 1 else found).union(stage(one, "block"))
        else:
            found = one
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched_words, segment_words, first_word, share) of each text and benchmark item that overlap.

    Words are lower-cased runs without ASCII punctuation. A pair counts if a window of an alignment has LEAST_WORDS equal words
    (all words for shorter items) and LEAST_SHARE of them; ``segment_words`` is the length of that with the most. Texts are
    read whole, whatever their length. NULL and empty texts or items never overlap, items without an id are ignored; repeated
    rows of ``docs`` are each judged, repeated items count once per id. Extra columns are ignored.
    """
    schema = "doc_id long, item_id long, matched_words long, segment_words long, first_word long, share double"

    def apply(block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, items = WordHashes(), block.value
            for batch in batches:
                rows = [(d, i, e, n, at, e / n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                        for i, e, n, at in _once(items.overlaps(hashes.of(words_of(t.as_py()))))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.float64() if k == 5 else pa.int64()) for k in range(6)],
                    ["doc_id", "item_id", "matched_words", "segment_words", "first_word", "share"])
        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = _per_block(texts, benchmark, apply, schema)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _once(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The best row of each item id."""
    best: dict[int, tuple] = {}
    for row in rows:
        if row[0] not in best or row[1:] > best[row[0]][1:]:
            best[row[0]] = row
    return list(best.values())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no benchmark item; each block filters what the one before kept.

    NULL and empty texts stay, repeated rows stay or go together; without a benchmark or without rows nothing changes.
    """
    at, spark = docs.columns.index("text"), docs.sparkSession
    for n, rows in enumerate(_blocks(benchmark)):
        block = spark.sparkContext.broadcast(Items(rows))

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            hashes, items = WordHashes(), block.value
            for batch in batches:
                keep = [not items.overlaps(hashes.of(words_of(t.as_py() or ""))) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = (docs if n == 0 else stage(docs, "kept")).mapInArrow(run, docs.schema)
    return docs
