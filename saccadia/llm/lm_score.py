"""Cross-entropy difference: two matched bigram models, one of a target part and one of the whole corpus, score each text.

Both models have the same order, smoothing and vocabulary, the words that occur at least ``LEAST_COUNT`` times in the corpus;
the others are one unknown word. The score of a text is its loss per word under the target model minus that under the
background model: the lower, the closer to the target. A text's own counts are taken out of both models before it is scored.

The models are never gathered. Tasks pack the texts they read into batches; a batch asks every shard of the key space for
the counts of the words and pairs it contains and hands in its own at the same time, packed and each key once, so a
frequent word weighs no more than a rare one. A shard adds up what all batches handed in and answers each; the answers meet
their batch again. Every answer also has the totals of its shard, whose sums are the totals of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, each_group, mix64, text_or_empty
from .decontaminate import words_of

#: Words rarer than this in the corpus are the unknown word.
LEAST_COUNT = 2
#: Weight of the pair estimate against the single-word estimate, where the word before is known.
PAIR_WEIGHT = 0.7
#: Words that a task packs into one batch.
BATCH_WORDS = 2_000_000
#: Keys are 48-bit hashes.
KEY_BITS = 48
_KEY_MASK = np.uint64((1 << KEY_BITS) - 1)

_TOTALS = ("background", "target", "vocabulary", "unknown_background", "unknown_target")


# ---------------------------------------------------------------- packing

@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes that hold them all, all first bytes first, compressed."""
    values = values.astype("<u8", copy=False)
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + _codec()[0].compress(planes)


def _numbers_back(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_codec()[1].decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :blob[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _keys(values: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return _numbers(np.diff(values, prepend=np.uint64(0)))


def _keys_back(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers_back(blob), dtype=np.uint64)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(3) + word) & _KEY_MASK


def _has_pair(sizes: np.ndarray) -> np.ndarray:
    """For each word of the joined texts whether a word of the same text stands before it."""
    out = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    out[starts[sizes > 0]] = False
    return out


def _counts(index: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(index, minlength=n), np.bincount(index[target], minlength=n)


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """Words of a batch from the most frequent one down: frequent words then have small numbers."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


_REQUEST = ("words", "word_all", "word_target", "pairs", "pair_all", "pair_target")
_SORTED = ("words", "pairs")
PACKED = "batch long, shard int, place int, docs binary, " + ", ".join(f"{c} binary" for c in _REQUEST)


def _shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the sorted keys of each shard begin; shards are equal ranges of the key space."""
    return np.searchsorted(keys, [-(-(s << KEY_BITS) // shards) for s in range(shards + 1)])


def _packed(ids: list, targets: list[bool], parts: list[np.ndarray], batch: int, shards: int) -> pa.RecordBatch:
    sizes = np.array([len(p) for p in parts])
    tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    target = np.repeat(np.array(targets, bool), sizes)
    words, index = np.unique(tokens, return_inverse=True)
    second = np.flatnonzero(_has_pair(sizes))
    pairs, pair_index = np.unique(_pair_keys(tokens[second - 1], tokens[second]), return_inverse=True)
    columns = dict(zip(_REQUEST, (words, *_counts(index, target, len(words)), pairs, *_counts(pair_index, target[second], len(pairs))), strict=True))
    cuts = {c: _shard_cuts(words if c.startswith("word") else pairs, shards) for c in _REQUEST}
    rank = np.empty(len(words), np.int64)
    rank[_by_frequency(columns["word_all"])] = np.arange(len(words))
    docs = b"".join((len(ids).to_bytes(8, "little"), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(),
                     np.array(targets, np.uint8).tobytes(), sizes.astype("<i8").tobytes(), _numbers(rank[index])))
    rows = {c: [(_keys if c in _SORTED else _numbers)(columns[c][a:b]) for a, b in zip(cuts[c], cuts[c][1:])] + [None] for c in _REQUEST}
    home = batch % shards  # the texts travel with some shard and pass through
    return pa.RecordBatch.from_arrays(
        [pa.array([batch] * (shards + 1), pa.int64()), pa.array([*range(shards), -1], pa.int32()), pa.array([*range(shards), home], pa.int32()),
         pa.array([None] * shards + [docs], pa.binary()), *(pa.array(rows[c], pa.binary()) for c in _REQUEST)],
        ["batch", "shard", "place", "docs", *_REQUEST])


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts for the way to their labels."""
    for batch in batches:
        small = [_codec()[0].compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], ["doc_id", "text"])


def _packer(shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, unpack = WordHashes(), TaskContext.get().partitionId(), _codec()[1]
        ids, targets, parts, held, n = [], [], [], 0, 0
        for rows in batches:
            for d, t, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                ids.append(d)
                targets.append(t)
                parts.append(hashes.of(words_of(unpack.decompress(text.as_py()).decode("utf-8", "surrogatepass"))) & _KEY_MASK)
                held += len(parts[-1])
                if held >= BATCH_WORDS or len(ids) >= BATCH_WORDS // 10:
                    yield _packed(ids, targets, parts, part << 32 | n, shards)
                    ids, targets, parts, held, n = [], [], [], 0, n + 1
        if ids:
            yield _packed(ids, targets, parts, part << 32 | n, shards)

    return run


# ---------------------------------------------------------------- shards

def _summed(keys: list[np.ndarray], every: list[np.ndarray], target: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its sums."""
    values, index = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda parts: np.bincount(index, np.concatenate(parts).astype(float), len(values)).astype(np.int64)
    return values, add(every), add(target)


_ANSWER = ("words", "own", "word_all", "word_target", "pair_all", "pair_target")
ANSWER = "batch long, shard int, docs binary, totals array<long>, " + ", ".join(f"{c} binary" for c in _ANSWER)


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["batch", "shard", "docs", "totals", *_ANSWER]
    for table in each_group(batches, "shard"):
        batch, shard = table.column("batch").to_pylist(), table.column("shard")[0].as_py()
        if shard < 0:
            none = [pa.nulls(len(batch), pa.binary())] * len(_ANSWER)
            yield pa.RecordBatch.from_arrays([pa.array(batch), pa.array([-1] * len(batch), pa.int32()), table.column("docs").combine_chunks(),
                                              pa.nulls(len(batch), pa.list_(pa.int64())), *none], names)
            continue
        got = {c: [(_keys_back if c in _SORTED else _numbers_back)(v.as_py()) for v in table.column(c)] for c in _REQUEST}
        words, word_all, word_target = _summed(got["words"], got["word_all"], got["word_target"])
        pairs, pair_all, pair_target = _summed(got["pairs"], got["pair_all"], got["pair_target"])
        rare = word_all < LEAST_COUNT
        totals = [int(x) for x in (word_all.sum(), word_target.sum(), (~rare).sum(), word_all[rare].sum(), word_target[rare].sum())]
        for k in range(len(batch)):
            w, p = np.searchsorted(words, got["words"][k]), np.searchsorted(pairs, got["pairs"][k])
            counts = [_numbers(c) for c in (word_all[w], word_target[w], pair_all[p], pair_target[p])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch[k]]), pa.array([shard], pa.int32()), pa.nulls(1, pa.binary()), pa.array([totals], pa.list_(pa.int64())),
                 *(pa.array([b], pa.binary()) for b in (table.column("words")[k].as_py(), table.column("word_all")[k].as_py(), *counts))], names)


# ---------------------------------------------------------------- scoring

def _losses(word: np.ndarray, before: np.ndarray | None, pair: np.ndarray, rare: np.ndarray, total: float, unknown: float, vocabulary: int) -> np.ndarray:
    """Loss of each word: counts of the word, of the word before (0 where unusable) and of the pair."""
    single = (np.where(rare, unknown, word) + 1) / (total + vocabulary + 1)
    seen = before > 0
    both = np.where(seen, PAIR_WEIGHT * pair / np.maximum(before, 1) + (1 - PAIR_WEIGHT) * single, single)
    return -np.log(both)


def score_text(index: np.ndarray, pair: np.ndarray, own_target: bool, word_counts: tuple, pair_counts: tuple, totals: dict) -> tuple[float, float]:
    """(target, background) loss per word of one text; counts are those of the corpus for each word and pair in place."""
    n = len(index)
    _, inverse, own = np.unique(index, return_inverse=True, return_counts=True)
    own_word = own[inverse]
    own_pair = np.zeros(n, np.int64)
    if n > 1:
        _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
        own_pair[1:] = own[inverse]
    out = []
    rare = word_counts[0] < LEAST_COUNT
    for k, name in ((1, "target"), (0, "background")):
        mine = 1 if k == 0 or own_target else 0
        word = word_counts[k] - mine * own_word
        pairs = np.zeros(n, np.int64)
        pairs[1:] = pair_counts[k] - mine * own_pair[1:]
        before = np.zeros(n, np.int64)
        before[1:] = np.where(rare[:-1] | rare[1:], 0, word[:-1])
        unknown = totals[f"unknown_{name}"] - mine * int(rare.sum())
        out.append(float(_losses(word, before, pairs, rare, totals[name] - mine * n, unknown, totals["vocabulary"]).mean()))
    return out[0], out[1]


def _scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in each_group(batches, "batch"):
        docs = next(d.as_py() for d in table.column("docs") if d.is_valid)
        rows = [k for k, s in enumerate(table.column("shard").to_pylist()) if s >= 0]  # sorted by shard, so by key
        whole = {c: np.concatenate([(_keys_back if c in _SORTED else _numbers_back)(table.column(c)[k].as_py()) for k in rows]).astype(np.int64) for c in _ANSWER}
        totals = dict(zip(_TOTALS, np.sum([table.column("totals")[k].as_py() for k in rows], axis=0).tolist(), strict=True))
        n = int.from_bytes(docs[:8], "little")
        ids, known = np.frombuffer(docs, "<i8", n, 8), np.frombuffer(docs, np.uint8, n, 8 + 8 * n)
        target, sizes = np.frombuffer(docs, np.uint8, n, 8 + 9 * n), np.frombuffer(docs, "<i8", n, 8 + 10 * n)
        index = _by_frequency(whole["own"])[_numbers_back(docs[8 + 18 * n:]).astype(np.int64)]
        words = whole["words"].astype(np.uint64)
        second = np.flatnonzero(_has_pair(sizes))
        _, pair = np.unique(_pair_keys(words[index[second - 1]], words[index[second]]), return_inverse=True)
        ends, pair_ends = np.cumsum(sizes), np.cumsum(np.maximum(sizes - 1, 0))
        found = []
        for k in range(n):
            mine = index[ends[k] - sizes[k]:ends[k]]
            if not len(mine):
                found.append((None, None))
                continue
            its = pair[pair_ends[k] - len(mine) + 1:pair_ends[k]]
            found.append(score_text(mine, its, bool(target[k]), (whole["word_all"][mine], whole["word_target"][mine]),
                                    (whole["pair_all"][its], whole["pair_target"][its]), totals))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(i) if ok else None for i, ok in zip(ids, known)], pa.int64()), pa.array(target.astype(bool)), pa.array(sizes),
             pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()),
             pa.array([None if f[0] is None else f[0] - f[1] for f in found], pa.float64())],
            ["doc_id", "is_target", "n_words", "loss_target", "loss_background", "score"])


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, is_target, n_words, loss_target, loss_background, score) of every text.

    ``target_ids`` names the target part by doc_id, repeated or NULL ids do no harm. All texts are background. NULL and
    empty texts count nothing and have NULL losses. Repeated rows are texts of their own. ``shards`` ranges of the key
    space are added up one at a time in a task, by default two per shuffle partition.
    """
    shards = shards or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("is_target", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_compressed, "doc_id long, text binary")
    # the target part grows with the corpus: it is merged, never broadcast
    rows = texts.join(chosen.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("is_target", F.lit(False)).alias("is_target"), "text")
    packed = rows.sortWithinPartitions("doc_id", "text").mapInArrow(_packer(shards), PACKED)
    answers = packed.repartition("place").sortWithinPartitions("shard", "batch").mapInArrow(_answers, ANSWER)
    return answers.repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(
        _scores, "doc_id long, is_target boolean, n_words long, loss_target double, loss_background double, score double")
