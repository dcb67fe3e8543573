"""Exact repeated passages by enhanced suffix arrays: every byte inside a string of ``LENGTH`` bytes that occurs elsewhere.

Equal windows of ``LENGTH`` bytes contain the same ``gram`` of smallest hash, their anchor. All windows of one anchor in one
text are one segment. Anchors that occur once in the corpus cannot belong to a repeat; the segments of the others meet by
anchor, identical ones collapse, and blocks of them become one enhanced suffix array each: suffixes, common prefixes of
neighbours and the byte to the left. A stack scan walks the tree of common-prefix intervals; an interval of depth
``LENGTH`` or more whose left bytes differ is a maximal repeat and stands for all its occurrences.

An anchor with more than ``CAP`` different segments is cut again by longer grams, up to whole windows, where equal segments
have collapsed to one. So no task holds an unbounded group and nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, mix64, release_memory, stage, text_or_empty, whole_groups

LENGTH = 200
#: Anchor lengths, from the first cut to whole windows.
GRAMS = (64, 136, 184, 200)
#: Different segments of one anchor that a single suffix array takes.
CAP = 8192
#: Bytes of one suffix array, beyond which a further anchor starts the next one.
ARRAY_BYTES = 1 << 17
#: Bytes of texts that are taken out of a batch at once.
TEXT_BYTES = 4 << 20
#: Bytes whose windows are hashed at once.
BLOCK = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base & 0xFFFFFFFFFFFFFFFF)
    return np.multiply.accumulate(out)


_FORWARD, _BACKWARD = _powers(BLOCK + 512, _BASE), _powers(BLOCK + 512, pow(_BASE, -1, 1 << 64))


# ---------------------------------------------------------------- anchors

def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every substring of ``gram`` bytes."""
    n = len(data) - gram + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * _FORWARD[:len(data)], out=sums[1:])
    return mix64((sums[gram:] - sums[:-gram]) * _BACKWARD[:n])


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive keys, from running minima of blocks in both directions."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n - width + 1], right[width - 1:n])


def anchors(data: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, hash) of each run of windows with the same anchor; ``ends`` bounds the texts in ``data``.

    Windows never cross texts. Ties take the leftmost gram. Long data is hashed in overlapping blocks.
    """
    found: list[tuple] = []
    width, start_of = LENGTH - gram + 1, ends[:-1]
    for at in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        piece = data[at:at + BLOCK + LENGTH - 1]
        hashes = _gram_hashes(piece, gram)
        keys = (hashes & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (_window_minima(keys, width) & np.uint64(0x3FFFFF)).astype(np.int64)
        where = at + np.arange(len(chosen))
        text = np.searchsorted(start_of, where, side="right") - 1
        inside = where + LENGTH <= ends[text + 1]
        if not inside.any():
            continue
        chosen, where, text = chosen[inside], where[inside], text[inside]
        first = np.ones(len(chosen), bool)
        first[1:] = (chosen[1:] != chosen[:-1]) | (where[1:] != where[:-1] + 1) | (text[1:] != text[:-1])
        begin = np.flatnonzero(first)
        found.append((text[begin], where[begin] - start_of[text[begin]], np.diff(np.append(begin, len(chosen))), hashes[chosen[begin]]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes of a text or binary column and where each value starts and ends."""
    wide = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0]:ends[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _pieces(column: pa.Array, limit: int = TEXT_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The column in runs of rows of about ``limit`` bytes: first row, bytes, ends."""
    data, ends = _bytes_of(column)
    row = 0
    while row < len(ends) - 1:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield row, data[ends[row]:ends[last]], ends[row:last + 1] - ends[row]
        row = last


# ---------------------------------------------------------------- enhanced suffix array

def suffix_array(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``width`` or more symbols, and the exact common prefixes of neighbours up to there.

    Symbols above 255 end a segment and are all different. Ranks start from seven packed bytes and double; the ranks of
    all steps stay, so that common prefixes are read off them from the longest step down.
    """
    n = len(symbols)
    packed = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    for k in range(7):
        here = np.concatenate((symbols[k:], np.full(min(k, n), 256)))
        open_ &= here < 256
        packed = packed << np.uint64(9) | np.where(open_, here + 1, 0).astype(np.uint64)
    steps, ranks, length = [], [], 7
    order = np.argsort(packed)
    new = np.ones(n, bool)
    # suffixes that end inside their first seven symbols have different ends: ordered like the others, but never equal
    new[1:] = (packed[order[1:]] != packed[order[:-1]]) | ~open_[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    while True:
        steps.append(length)
        ranks.append(rank)
        if length >= width:
            break
        follow = np.zeros(n, np.int64)
        follow[:n - length] = rank[length:] if length < n else 0
        key = rank * (n + 1) + follow
        order = np.argsort(key)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for length, rank in zip(reversed(steps), reversed(ranks)):
        while True:
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            common[same] += length
            a[same] += length
            b[same] += length
            if length != steps[-1] or not same.any():
                break
    for _ in range(6):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = (symbols[a[inside]] == symbols[b[inside]]) & (symbols[a[inside]] < 256)
        common[same] += 1
        a[same] += 1
        b[same] += 1
    return order, common


def maximal_repeats(common: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval of at least ``least`` symbols whose left symbols differ.

    ``left`` is the symbol before each suffix in suffix order, negative and unique where nothing is known. Intervals are
    closed from the deepest outwards; the occurrences of one are the suffixes first .. last.
    """
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return
    breaks = np.flatnonzero(np.diff(deep) > 1) + 1
    for run in np.split(deep, breaks):
        start, depths = int(run[0]), common[run[0]:run[-1] + 1].tolist()
        lefts = left[run[0]:run[-1] + 2].tolist()
        stack: list[list] = []  # depth, first suffix, the one left symbol seen or None when they differ
        for i, depth in enumerate([*depths, 0]):
            first, symbol = i, lefts[i]
            while stack and stack[-1][0] > depth:
                d, first, s = stack.pop()
                s = s if s is not None and s == symbol else None
                if s is None:
                    yield d, start + first, start + i
                symbol = s
            if depth:
                if stack and stack[-1][0] == depth:
                    if stack[-1][2] is not None and stack[-1][2] != symbol:
                        stack[-1][2] = None
                else:
                    stack.append([depth, first, symbol])


def repeated_ranges(segments: list[bytes]) -> list[tuple[int, int, int]]:
    """(segment, from, to) of the bytes that maximal repeats of LENGTH or more cover, over different segments."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.empty(int(sizes.sum()) + len(segments), np.int64)
    body = np.ones(len(symbols), bool)
    body[starts + sizes] = False
    symbols[body] = np.frombuffer(b"".join(segments), np.uint8)
    symbols[~body] = 256 + np.arange(len(segments))
    order, common = suffix_array(symbols, int(sizes.max()))
    before = np.concatenate(([-1], symbols[:-1]))
    before = np.where((before < 0) | (before > 255), -1 - np.arange(len(symbols)), before)
    reach = np.zeros(len(symbols), np.int64)
    for depth, first, last in maximal_repeats(common, before[order], LENGTH):
        np.maximum(reach[first:last + 1], depth, out=reach[first:last + 1])
    hit = np.flatnonzero(reach)
    if not len(hit):
        return []
    begin = order[hit]
    sort = np.argsort(begin)
    begin, end = begin[sort], (begin + reach[hit])[sort]
    segment = np.searchsorted(starts, begin, side="right") - 1
    limit = np.maximum.accumulate(end)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] > limit[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(begin)) - 1
    base = starts[segment[at]]
    return list(zip(segment[at].tolist(), (begin[at] - base).tolist(), (limit[last] - base).tolist(), strict=True))


# ---------------------------------------------------------------- Spark

def _key() -> list[Column]:
    """Two hashes of a text: 64 bits, and 24 more that travel beside a position."""
    return [F.xxhash64("text").alias("k"), F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 40).alias("tag")]


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts; of copies that meet in one task two are enough to show that their anchors repeat."""
    release_memory()  # of tasks that this worker did before
    times: dict[tuple[int, int], int] = {}
    for batch in batches:
        if len(times) > 200_000:
            times.clear()
        fresh = []
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            times[pair] = times.get(pair, 0) + 1
            fresh.append(times[pair] <= 2)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        key, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for row, data, ends in _pieces(batch.column(2)):
            text, start, windows, hashes = anchors(data, ends, GRAMS[0])
            if len(text):
                at = (tag[row + text] << 39) | (start << 8) | windows
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(key[row + text]), pa.array(at)], ["m", "k", "at"])


def _segment_hash(segment: bytes) -> int:
    value = xxhash.xxh64_intdigest(segment, 3)
    return value - (1 << 64) if value >> 63 else value


def _segment_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each text; the bytes only where this task has not sent them yet, as far as it remembers."""
    release_memory()  # of tasks that this worker did before
    sent: set[int] = set()
    names = ["m", "sh", "k", "tag", "start", "size", "copies", "body"]
    for batch in (part for b in batches for part in by_bytes(b, b.schema.get_field_index("text"), TEXT_BYTES)):
        held: list[list] = [[] for _ in names]
        for text, k, tag, copies, spots in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist(), batch.column("tag").to_pylist(),
                                               batch.column("copies").to_pylist(), batch.column("spots"), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            at = spots.values.field(1).to_numpy()
            start, windows = ((at >> 8) & 0x7FFFFFFF).tolist(), (at & 0xFF).tolist()
            pieces = [data[a:a + w + LENGTH - 1] for a, w in zip(start, windows, strict=True)]
            hashes = [_segment_hash(p) for p in pieces]
            bodies = []
            for h, p in zip(hashes, pieces, strict=True):
                bodies.append(None if h in sent else p)
                sent.add(h)
            if len(sent) > 500_000:
                sent.clear()
            n = len(pieces)
            for column, values in zip(held, (spots.values.field(0).to_pylist(), hashes, [k] * n, [tag] * n, start, list(map(len, pieces)),
                                             [copies] * n, bodies), strict=True):
                column.extend(values)
            if len(held[0]) > 20_000:
                yield _segment_batch(held, names)
                held = [[] for _ in names]
        if held[0]:
            yield _segment_batch(held, names)


def _segment_batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())], names)


def _array_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole anchors, packed to about ARRAY_BYTES."""
    release_memory()  # of tasks that this worker did before
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = repeated_ranges([h[2] for h in held])
        return pa.RecordBatch.from_arrays([pa.array([held[s][0] for s, _, _ in found], pa.int64()), pa.array([held[s][1] for s, _, _ in found], pa.int64()),
                                           pa.array([a for _, a, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.int64())],
                                          ["m", "sh", "lo", "hi"])

    for table in whole_groups(batches, ["m"]):
        m, sh = table.column("m").to_numpy(), table.column("sh").to_numpy()
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (sh[1:] != sh[:-1])
        rows = np.flatnonzero(new)
        group = m[rows]
        several = np.zeros(len(rows), bool)
        several[1:] |= group[1:] == group[:-1]
        several[:-1] |= group[1:] == group[:-1]
        bodies, last = table.column("body"), None
        for r in rows[several].tolist():
            if size >= ARRAY_BYTES and m[r] != last:
                yield flush()
                held, size = [], 0
            last = m[r]
            body = bodies[r].as_py()
            held.append((int(m[r]), int(sh[r]), body))
            size += len(body)
    if held:
        yield flush()


def _finer(gram: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, ends in _pieces(batch.column("body")):
                segment, start, windows, hashes = anchors(data, ends, gram)
                whole, base = data.tobytes(), ends[:-1]
                parts = [whole[base[s] + a:base[s] + a + w + LENGTH - 1] for s, a, w in zip(segment, start, windows, strict=True)]
                take = pa.array(row + segment)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array([_segment_hash(p) for p in parts], pa.int64()),
                     batch.column("m").take(take), batch.column("sh").take(take), pa.array(start.astype(np.int64)),
                     pa.array(parts, pa.binary()), batch.column("copies").take(take)],
                    ["m", "sh", "up_m", "up_sh", "start", "body", "copies"])

    return run


def _ranges(segments: DataFrame, counts: DataFrame, level: int = 0) -> DataFrame:
    """(m, sh, lo, hi): repeated bytes of each different segment.

    ``segments`` has the bytes (m, sh, body), perhaps several times; ``counts`` has (m, sh, size, copies) once each.
    """
    whole = counts.filter("copies > 1").select("m", "sh", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    crowded = counts.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > CAP).select("m")
    spread = segments.join(crowded, "m", "left_anti")
    found = (spread.repartition("m").sortWithinPartitions("m", "sh").mapInArrow(_array_rows, "m long, sh long, lo long, hi long"))
    if level + 1 == len(GRAMS):
        return whole.union(found)
    hot = counts.join(crowded, "m", "left_semi")
    if not hot.take(1):
        return whole.union(found)
    bodies = segments.join(crowded, "m", "left_semi").dropDuplicates(["m", "sh"]).join(hot.select("m", "sh", "copies"), ["m", "sh"])
    finer = stage(bodies.mapInArrow(_finer(GRAMS[level + 1]), "m long, sh long, up_m long, up_sh long, start long, body binary, copies long"), "finer")
    total = finer.groupBy("m").agg(F.sum("copies").alias("n")).filter("n > 1").select("m")
    alive = stage(finer.join(total, "m", "left_semi"), "alive")
    below = _ranges(alive.select("m", "sh", "body"), alive.groupBy("m", "sh").agg(
        F.max(F.octet_length("body")).cast("long").alias("size"), F.sum("copies").alias("copies")), level + 1)
    back = alive.select("m", "sh", "up_m", "up_sh", "start").join(below, ["m", "sh"]).select(
        F.col("up_m").alias("m"), F.col("up_sh").alias("sh"), (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return whole.union(found).union(back)


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the texts of ``docs`` repeat.

    Returns (texts, ranges). ``texts`` has one row per different text: k, tag, first_id (smallest doc_id that carries it)
    and copies. ``ranges`` has (k, tag, spans) for the texts that occur once and have repeated bytes; spans are [lo, hi)
    pairs that may overlap. A text of LENGTH bytes or more with copies > 1 is repeated throughout and not in ``ranges``.
    Copies enter the work once. NULL texts are empty. Rows may repeat and doc_id may be NULL or ambiguous.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", *_key(), "text")
    kinds = stage(texts.groupBy("k", "tag").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "kinds")
    anchor = texts.select("k", "tag", "text").mapInArrow(_anchor_rows, "m long, k long, at long")
    often = anchor.groupBy("m").count().filter("count > 1").select("m")
    spots = (anchor.join(often, "m", "left_semi").distinct()
             .withColumn("tag", F.shiftright("at", 39)).groupBy("k", "tag").agg(F.collect_list(F.struct("m", "at")).alias("spots")))
    wanted = spots.join(kinds, ["k", "tag"]).withColumnRenamed("first_id", "doc_id")
    same = [texts["k"] == wanted["k"], texts["tag"] == wanted["tag"], texts["doc_id"].eqNullSafe(wanted["doc_id"])]
    rows = texts.join(wanted, same).select(texts["k"], texts["tag"], texts["text"], wanted["copies"], wanted["spots"])
    seen = stage(rows.mapInArrow(_segment_rows, "m long, sh long, k long, tag long, start long, size long, copies long, body binary"), "segments")
    # a repeated row gives its text twice, under one key; its segments count as copies either way
    counts = stage(seen.groupBy("m", "sh").agg(F.max("size").alias("size"), F.sum("copies").alias("copies")), "counts")
    found = _ranges(seen.filter("body is not null").select("m", "sh", "body"), counts)
    single = seen.filter("copies = 1").select("m", "sh", "k", "tag", "start")
    spans = single.join(found, ["m", "sh"]).select("k", "tag", F.struct(
        (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("span"))
    return kinds, spans.groupBy("k", "tag").agg(F.collect_list("span").alias("spans"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal runs of the given half-open ranges."""
    sort = np.argsort(lo, kind="stable")
    lo, hi = lo[sort], np.maximum.accumulate(hi[sort])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _remaining(data: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    edges = [0, *np.stack((lo, hi), axis=1).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
            spans = batch.column("spans")[i].values
            lo, hi = merged(spans.field(0).to_numpy(), spans.field(1).to_numpy())
            rows.append((int((hi - lo).sum()), len(lo), hashlib.sha256(_remaining(data, lo, hi)).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("tag"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.string())], ["k", "tag", "removed", "spans", "sha"])


def removal_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, see ``repeated_bytes``."""
    kinds, ranges = repeated_bytes(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", *_key(), "text")
    places = ranges.join(kinds, ["k", "tag"]).withColumnRenamed("first_id", "doc_id")
    same = [texts["k"] == places["k"], texts["tag"] == places["tag"], texts["doc_id"].eqNullSafe(places["doc_id"])]
    cut = texts.join(places, same).select(texts["k"], texts["tag"], texts["text"], places["spans"]).mapInArrow(
        _digest_rows, "k long, tag long, removed long, spans long, sha string")
    base = texts.select("doc_id", "k", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("full"))
    copied = kinds.filter("copies > 1").select("k", "tag", F.lit(True).alias("copied"))
    joined = base.join(copied, ["k", "tag"], "left").join(cut, ["k", "tag"], "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "full")).alias("kept_sha256"))


def _whole_characters(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrink ranges to full UTF-8 characters."""
    inner = (np.frombuffer(data + b"\0\0\0\0", np.uint8) & 0xC0) == 0x80
    lo, hi = lo.copy(), hi.copy()
    for _ in range(3):
        lo += inner[lo]
        hi -= inner[hi]
    keep = lo < hi
    return lo[keep], hi[keep]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, repeated passages cut out of ``text`` at character borders, ``n_chars`` brought up to date.

    Texts that lose everything stay as empty texts; rows without repeats are not touched.
    """
    kinds, ranges = repeated_bytes(docs)
    columns = docs.columns
    keyed = docs.withColumn("__repeats_text", text_or_empty()).withColumn("__repeats_k", F.xxhash64("__repeats_text")).withColumn(
        "__repeats_tag", F.shiftrightunsigned(F.xxhash64(F.lit(1), "__repeats_text"), 40)).drop("__repeats_text")
    copied = kinds.filter(F.col("copies") > 1).select(F.col("k").alias("__repeats_k"), F.col("tag").alias("__repeats_tag"), F.lit(True).alias("__repeats_copied"))
    spans = ranges.select(F.col("k").alias("__repeats_k"), F.col("tag").alias("__repeats_tag"), F.col("spans").alias("__repeats_spans"))
    joined = keyed.join(copied, ["__repeats_k", "__repeats_tag"], "left").join(spans, ["__repeats_k", "__repeats_tag"], "left").select(*columns, "__repeats_copied", "__repeats_spans")
    at, out = columns.index("text"), docs.schema
    count_at = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in by_bytes(b, at, TEXT_BYTES)):
            texts, counts = batch.column(at).to_pylist(), batch.column(count_at).to_pylist() if count_at is not None else None
            for i in range(batch.num_rows):
                if texts[i] is None:
                    continue
                data = texts[i].encode("utf-8", "surrogatepass")
                if batch.column("__repeats_copied")[i].as_py() and len(data) >= LENGTH:
                    texts[i] = ""
                elif batch.column("__repeats_spans")[i].is_valid:
                    spans = batch.column("__repeats_spans")[i].values
                    lo, hi = _whole_characters(data, *merged(spans.field(0).to_numpy(), spans.field(1).to_numpy()))
                    texts[i] = _remaining(data, lo, hi).decode("utf-8", "surrogatepass")
                else:
                    continue
                if counts is not None:
                    counts[i] = len(texts[i])
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[at] = pa.array(texts, batch.column(at).type)
            if count_at is not None:
                arrays[count_at] = pa.array(counts, batch.column(count_at).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.mapInArrow(run, out)
