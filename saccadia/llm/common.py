"""Helpers that several operators share: whole groups out of sorted batches, hashing of words, the shared folder."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.session import ensure_checkpoint_dir, stage

__all__ = ["WordHashes", "by_bytes", "each_group", "ensure_checkpoint_dir", "mix64", "release_memory", "stage", "text_or_empty", "to_hex", "whole_groups"]

#: Words kept by a worker with their hashes; the table is emptied when it is full.
HASH_TABLE_WORDS = 500_000


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def to_hex(col: Column | str) -> Column:
    """A long as 16 lowercase hex digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut sorted batches into tables that never split rows of equal ``keys``; what follows the last change waits."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        changed = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for k in keys:
            values = table.column(k).to_numpy()
            changed |= values[1:] != values[:-1]
        last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        new_start = bool(held) and any(held[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys)
        if new_start:
            yield pa.concat_tables(held)
            held = []
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)


def each_group(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches as one table per value of ``key``."""
    for table in whole_groups(batches, [key]):
        values = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a string column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.concatenate(([0], np.cumsum(sizes)[:-1])) // most
    cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def release_memory() -> None:
    """Give memory that Arrow and the C library hold in reserve back to the system; workers are used again by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words given as bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_TABLE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

