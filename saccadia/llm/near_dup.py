"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced inside block tables.

A fingerprint of 64 bits is cut into six blocks. Two fingerprints that differ in at most four bits agree on two whole
blocks, so each of the 15 pairs of blocks is one table and equal blocks are one bucket. Inside a bucket the fingerprints
are stored vertically, one plane of words per bit; the distances of 64 fingerprints at a time are counted by carry-save
adders over the planes, and a word is abandoned as soon as all its 64 lanes are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty, whole_groups
from .components import components

#: Blocks of a fingerprint, low bits first, and how many of them must agree when at most RADIUS bits differ.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
RADIUS = 4
#: Fingerprints of one bucket that one comparison holds; larger buckets are cut into tiles of this size.
BUCKET = 4096
#: Up to this size a bucket is compared by shifting the sorted rows against themselves, all such buckets at once.
SMALL = 16
#: Shingles hashed at a time, so that a very long text needs no more memory than its own bytes.
SHINGLES_AT_ONCE = 60_000

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str, width: int, seed: int = 42) -> int:
    """Majority of the hash bits of all word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(starts[at:at + SHINGLES_AT_ONCE], ends[at:at + SHINGLES_AT_ONCE], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long. NULL text counts as no words.

    Columns of longs named in ``keep`` are handed on.
    """
    keep = list(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keep])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *keep).mapInArrow(
        run, ", ".join(["doc_id long", "fp long", *(f"{k} long" for k in keep)]))


# ---------------------------------------------------------------- bit-sliced comparison

def planes_of(values: np.ndarray) -> np.ndarray:
    """64 planes: bit j of word i of plane b is bit b of value 64 * i + j."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _over(digits: list[np.ndarray], dead: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is beyond the radius."""
    greater, equal = dead.copy(), np.full_like(dead, ALL)
    for k in range(len(digits) - 1, -1, -1):
        if radius >> k & 1:
            equal &= digits[k]
        else:
            greater |= equal & digits[k]
            equal &= ~digits[k]
    return greater


def lanes_within(differs: Callable[[int, np.ndarray], np.ndarray], n_words: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with a lane at distance <= radius, and those lanes as set bits.

    ``differs(b, words)`` gives the difference bits of plane ``b``. Two planes at a time enter the lowest counter digit
    through a full adder, the carry ripples upwards, and a carry out of the top digit marks the lane for good.
    """
    words = np.arange(n_words)
    digits = [np.zeros(n_words, np.uint64) for _ in range(radius.bit_length())]
    dead = np.zeros(n_words, np.uint64)
    for b in range(0, 64, 2):
        x, y = differs(b, words), differs(b + 1, words)
        half = digits[0] ^ x
        carry = (digits[0] & x) | (half & y)
        digits[0] = half ^ y
        for k in range(1, len(digits)):
            digits[k], carry = digits[k] ^ carry, digits[k] & carry
        dead |= carry
        if b % 8 == 6:
            live = _over(digits, dead, radius) != ALL
            if not live.all():
                words, dead, digits = words[live], dead[live], [d[live] for d in digits]
                if not len(words):
                    break
    return words, ~_over(digits, dead, radius)


def _shifted_links(values: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside all small buckets: row i against row i + s, for every shift s below the largest small bucket."""
    small = size <= SMALL
    values, group = values[small], group[small]
    for s in range(1, SMALL):
        left = np.flatnonzero(group[:-s] == group[s:]) if len(group) > s else np.empty(0, np.int64)
        if not len(left):
            return
        for at in range(0, len(left), 1 << 16):
            part = left[at:at + (1 << 16)]
            planes = planes_of(values[part] ^ values[part + s])
            words, near = lanes_within(lambda b, w, planes=planes: planes[b][w], planes.shape[1], radius)
            word, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            hit = words[word] * 64 + lane
            hit = part[hit[hit < len(part)]]
            yield values[hit], values[hit + s]


def _bucket_forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One link from each fingerprint to the first of its component inside a bucket, instead of all its pairs."""
    m, planes = len(values), planes_of(values)
    n_words = planes.shape[1]
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    near = np.zeros((m, n_words), np.uint64)
    rows = max(1, (1 << 16) // n_words)
    for at in range(0, m, rows):
        asked = np.where(bits[at:at + rows], ALL, np.uint64(0))
        words, lanes = lanes_within(lambda b, w, asked=asked: planes[b][w % n_words] ^ asked[w // n_words, b],
                                    len(asked) * n_words, radius)
        near[at + words // n_words, words % n_words] = lanes
    if m % 64:
        near[:, -1] &= np.uint64((1 << m % 64) - 1)
    index = np.arange(m)
    near[index, index // 64] &= ~(np.uint64(1) << (index % 64).astype(np.uint64))
    waiting = np.packbits((near != 0).any(axis=1), bitorder="little")
    unseen = np.zeros(n_words, np.uint64)
    unseen.view(np.uint8)[:len(waiting)] = waiting
    firsts, others = [], []
    members = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    for first in members(unseen.copy()).tolist():
        if not int(unseen[first // 64]) >> first % 64 & 1:
            continue
        unseen[first // 64] &= ~(np.uint64(1) << np.uint64(first % 64))
        front = np.array([first])
        while len(front):
            reached = np.bitwise_or.reduce(near[front], axis=0) & unseen
            unseen &= ~reached
            front = members(reached)
            firsts.append(np.full(len(front), first))
            others.append(front)
    if not firsts:
        return values[:0], values[:0]
    return values[np.concatenate(firsts)], values[np.concatenate(others)]


def _links(keys: list[str], radius: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            values = table.column("fp").to_numpy().view(np.uint64)
            starts = np.ones(len(values), bool)
            starts[1:] = np.logical_or.reduce([(v := table.column(k).to_numpy())[1:] != v[:-1] for k in keys])
            group = np.cumsum(starts) - 1
            at = np.flatnonzero(starts)
            counts = np.diff(np.append(at, len(values)))
            found = list(_shifted_links(values, group, counts[group], radius))
            found += [_bucket_forest(values[at[i]:at[i] + counts[i]], radius) for i in np.flatnonzero(counts > SMALL)]
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def block_masks(blocks: tuple[int, ...], agreeing: int) -> list[int]:
    """One signed 64-bit mask per choice of blocks that have to agree."""
    edges = np.cumsum((0, *blocks)).tolist()
    single = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(single, agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_forest(values: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCK_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` whose closure is that of all links within the radius."""
    masks = block_masks(blocks, len(blocks) - radius)
    rows = values.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")
    ).select("k.t", "k.key", "fp")
    return bucket_links(rows, radius)


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the radius between the fingerprints of each bucket (t, key), as a forest per bucket.

    A bucket hands on a forest of its links, never all pairs. Buckets beyond ``BUCKET`` fingerprints are cut into tiles
    by hash and every two tiles meet in a task of their own, so no task holds more than two tiles and no pair is lost.
    """
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("t", "key")))
    keys = ["t", "key"]
    plain = (rows.filter(f"n > 1 and n <= {BUCKET}").sortWithinPartitions(*keys).select(*keys, "fp")
             .mapInArrow(_links(keys, radius), "a long, b long"))
    tiled = in_tiles(rows.filter(f"n > {BUCKET}"), BUCKET, "fp")
    keys = [*keys, "lo", "hi"]
    return plain.union(tiled.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp")
                       .mapInArrow(_links(keys, radius), "a long, b long"))


def in_tiles(rows: DataFrame, size: int, by: str) -> DataFrame:
    """Rows of groups of ``n`` dealt into tiles of about ``size``; each row goes to every pair (lo, hi) with its tile."""
    tiles = F.ceil(F.col("n") / size).cast("int")
    dealt = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64(by), F.col("tiles")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns(
        {"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})


def near_duplicate_components(docs: DataFrame, width: int = 4, radius: int = RADIUS, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of <= ``radius`` differing bits can reach.

    Equal fingerprints are one class, so copies never multiply the work; only distinct fingerprints are compared.
    NULL or empty texts have fingerprint 0 and link like any other. Repeated rows stay, each with the id of its class.
    A NULL doc_id never becomes a component id unless the component has no other. An empty table gives an empty result.
    Columns of longs named in ``keep`` are handed on.
    """
    found = stage(fingerprints(docs, width=width, keep=keep), "fingerprints")
    classes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(link_forest(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = named.join(smallest, "root").select("fp", "component_id")
    return found.join(lookup, "fp").select("doc_id", "fp", "component_id", *keep)


def keep_first(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a document of smaller doc_id in their component stands for.

    A row is known by doc_id and text, so another text under the same doc_id is judged for itself. Repeated rows of the
    document that stays, stay. A row without doc_id goes where its component has a document with one, and stays otherwise.
    NULL and empty texts are one component. An empty table stays empty; other columns may have any name.
    """
    said = F.xxhash64(text_or_empty())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), said.alias("said"))
    found = near_duplicate_components(rows, width, radius, keep=("said",))
    gone = found.filter("component_id is not null and not (doc_id <=> component_id)").select(
        F.col("doc_id").alias("__gone_id"), F.col("said").alias("__gone_said")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__gone_id")) & (said == F.col("__gone_said")), "left_anti")
