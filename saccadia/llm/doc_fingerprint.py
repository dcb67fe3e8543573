"""Document fingerprints: weighted terms vote on signed bits, permuted block tables find all neighbours in a Hamming radius.

Terms are words and pairs of neighbouring words, each once with a weight that grows with the logarithm of its count. Bit b of
a fingerprint is set if the weights of the terms whose hash has that bit outweigh the others.

For radius 3 a fingerprint is cut into five blocks. Each of the ten tables holds all fingerprints with two chosen blocks
moved to the front; two fingerprints within the radius agree on the front of at least one table and are counted in the first
such table. Equal fingerprints enter once with their number, and a table hands on counts, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, mix64, stage, text_or_empty, to_hex, whole_groups
from .decontaminate import words_of

BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 3
#: Fingerprints of a table bucket that one comparison holds; larger ones are cut into tiles that meet two by two.
BUCKET = 4096
SMALL = 24
#: Weight of a single word against a pair of words.
WORD_WEIGHT = 0.5

_SIGNS = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), 1.0, -1.0)


def fingerprint(text: str, hashes: WordHashes) -> int:
    """Signed vote of all terms of a text; 0 without words."""
    words = hashes.of(words_of(text))
    if not len(words):
        return 0
    votes = np.zeros((8, 8))
    for terms, weight in ((words, WORD_WEIGHT), (mix64(words[:-1] * np.uint64(3) + words[1:]), 1.0)):
        values, counts = np.unique(terms, return_counts=True)
        weights = weight * (1 + np.log(counts))
        parts = values.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            votes[j] += np.bincount(parts[:, j], weights, 256) @ _SIGNS
    return int(np.packbits(votes.ravel() > 0, bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / 64


# ---------------------------------------------------------------- documents beside their successors

def _in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id; the first row of each range is also at the end of the range before (tail = 1)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(rows.select("key").agg(F.percentile_approx("key", shares, 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", part)
    firsts = sorted((r["part"], r["key"]) for r in rows.select("part", "key").groupBy("part").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return rows.select("part", F.lit(0).alias("tail"), "key", "doc_id", "text")
    heads = F.create_map(*[F.lit(x) for p, k in firsts for x in (p, k)])
    before = F.create_map(*[F.lit(x) for (p, _), (q, _) in zip(firsts, [firsts[-1], *firsts]) for x in (p, q)])
    place = lambda p, tail: F.struct(p.alias("part"), F.lit(tail).alias("tail"))
    own = place(F.col("part"), 0)
    places = F.when(F.col("key") == F.element_at(heads, F.col("part")), F.array(own, place(F.element_at(before, F.col("part")), 1))).otherwise(F.array(own))
    rows = rows.select(F.explode(places).alias("place"), "key", "doc_id", "text").select("place.part", "place.tail", "key", "doc_id", "text")
    return rows.repartition(len(firsts), "part").sortWithinPartitions("part", "tail", "key", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of another text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pair_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last: tuple | None = None  # part, doc_id, text, fingerprint
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for part, tail, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if tail and last is None:
                continue
            text = text.as_py()
            fp = fingerprint(text, hashes)
            if last is not None:
                _, its_id, its_text, its_fp = last
                new = edited(its_text, text)
                new_fp = fingerprint(new, hashes)
                for column, value in zip(rows, (its_id, len(its_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _signed(its_fp),
                                                _signed(new_fp), likeness(its_fp, new_fp), likeness(its_fp, fp)), strict=True):
                    column.append(value)
            last = None if tail else (part, doc_id, text, fp)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                                                                               pa.float64(), pa.float64()), strict=True)], names)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every document and its successor."""
    return _in_order(docs).mapInArrow(_pair_rows, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double")


# ---------------------------------------------------------------- permuted block tables

def _tables(blocks: tuple[int, ...], front: int) -> list[list[tuple[int, int]]]:
    """For each table the blocks (low bit, bits) from the highest place down."""
    edges = np.cumsum((0, *blocks)).tolist()
    spans = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    return [[spans[i] for i in chosen] + [s for i, s in enumerate(spans) if i not in chosen] for chosen in combinations(range(len(blocks)), front)]


def _permuted(fp: Column, order: list[tuple[int, int]]) -> Column:
    out, place = F.lit(0).cast("long"), 64
    for low, bits in order:
        place -= bits
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)), place))
    return out


def _pairs(values: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of rows of one group whose values differ in at most ``radius`` bits."""
    small = np.flatnonzero(size <= SMALL)
    for s in range(1, SMALL):
        if len(small) <= s:
            break
        same = group[small[:-s]] == group[small[s:]]
        if not same.any():
            break
        i, j = small[:-s][same], small[s:][same]
        near = np.bitwise_count(values[i] ^ values[j]) <= radius
        yield i[near], j[near]
    large = np.flatnonzero(size > SMALL)
    at = 0
    while at < len(large):
        begin, n = int(large[at]), int(size[large[at]])
        block = values[begin:begin + n]
        rows = max(1, (1 << 20) // n)
        for r in range(0, n, rows):
            i, j = np.nonzero(np.bitwise_count(block[r:r + rows, None] ^ block[None]) <= radius)
            later = j > i + r
            yield begin + i[later] + r, begin + j[later]
        at += n


def neighbour_counts(classes: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(fp, near) from the distinct ``fp`` and their numbers ``n``: how many rows have another fingerprint within the radius."""
    orders = _tables(blocks, len(blocks) - radius)
    fronts = [sum(((1 << bits) - 1) << low for low, bits in order[:len(blocks) - radius]) for order in orders]
    lead = [64 - sum(bits for _, bits in order[:len(blocks) - radius]) for order in orders]
    rows = classes.select("fp", "n", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(_permuted(F.col("fp"), order), lead[t]).alias("key")) for t, order in enumerate(orders)])).alias("row"))
    rows = rows.select("row.t", "row.key", "fp", "n").withColumn("size", F.count("*").over(Window.partitionBy("t", "key")))

    def run(keys: list[str]):
        def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, keys):
                values, n, t, tile = (table.column(c).to_numpy() for c in ("fp", "n", "t", "tile"))
                values = values.view(np.uint64)
                start = np.ones(len(values), bool)
                start[1:] = np.logical_or.reduce([(v := table.column(k).to_numpy())[1:] != v[:-1] for k in keys])
                group = np.cumsum(start) - 1
                cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
                near = np.zeros(len(values), np.int64)
                for i, j in _pairs(values, group, np.bincount(group)[group], radius):
                    differ, mine = values[i] ^ values[j], t[i]
                    first = np.full(len(i), len(fronts))
                    for k in range(len(fronts) - 1, -1, -1):
                        first[differ & np.uint64(fronts[k]) == 0] = k
                    new = (first == mine) & (~cross[i] | (tile[i] != tile[j]))
                    i, j = i[new], j[new]
                    near += np.bincount(i, n[j], len(near)).astype(np.int64) + np.bincount(j, n[i], len(near)).astype(np.int64)
                hit = near > 0
                yield pa.RecordBatch.from_arrays([pa.array(values[hit].view(np.int64)), pa.array(near[hit])], ["fp", "near"])
        return counted

    schema = "fp long, near long"
    whole = rows.filter(f"size > 1 and size <= {BUCKET}").withColumns({c: F.lit(0) for c in ("lo", "hi", "tile")})
    plain = whole.sortWithinPartitions("t", "key").mapInArrow(run(["t", "key"]), schema)
    tiles = F.ceil(F.col("size") / BUCKET).cast("int")
    tiled = (rows.filter(f"size > {BUCKET}").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}))
    keys = ["t", "key", "lo", "hi"]
    crowded = tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run(keys), schema)
    return plain.union(crowded).groupBy("fp").agg(F.sum("near").alias("near"))


def fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """with_edits plus class_id, the smallest doc_id of equal fingerprint, and n_near, the other documents in the radius.

    NULL texts are empty and have fingerprint 0. Documents follow each other by doc_id, NULL ids first, equal ids by text;
    the last is followed by the first, a single one by itself. Repeated rows stay. An empty table gives an empty result.
    """
    found = stage(with_edits(docs), "fingerprints")
    classes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    near = neighbour_counts(classes.select("fp", "n"), radius)
    lookup = classes.join(near, "fp", "left").select("fp", "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"))
    return found.join(lookup, "fp").select(
        "doc_id", "n_chars", "edited_sha256", to_hex("fp").alias("fingerprint"), to_hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
        "class_id", "n_near")
