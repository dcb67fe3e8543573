"""Vectors of integers, and the meeting of a query set with all rows in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that one task holds.
QUERIES = 2048
#: Rows compared at a time: few at first, until the thresholds stand, then twice as many each time up to the second number.
FIRST_ROWS, ROWS = 64, 2048
#: Vectors of this squared length or more have no score in a long.
TOO_LONG = 2.0 ** 62


def integer_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                    label: Column | None = None) -> DataFrame:
    """(id, label, v, norm): every component x as floor(scale * x), x as double, and the length of the integer vector.

    Rows with a NULL id, a NULL vector or a NULL or non-finite component take no part, nor do those of a NULL ``label`` where
    one is given, nor those whose scores no long can hold. Of rows that share an id the one of the smallest (label, vector)
    counts. Vectors of different numbers of components are compared as if zeros followed the shorter one.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                     F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                      & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    squared = F.aggregate("x", F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0)))
    rows = rows.where(squared < TOO_LONG).select("id", F.struct("label", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).alias("_row"))
    one = rows.groupBy("id").agg(F.min("_row").alias("_row")).select("id", "_row.label", "_row.v")
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def in_blocks(asked: DataFrame, rows: DataFrame, by: Sequence[str], carried: Sequence[str], n_asked: int, least_tasks: int) -> DataFrame:
    """Both tables in one, dealt out so that a task holds a block of about QUERIES queries and meets a stripe of the rows.

    ``n_asked`` is the number of queries with equal values of ``by``, at most. Inside (``by``, block, stripe) the queries
    (side 0) come first, then the rows (side 1) by falling length. Every row is sent once per block, every query once per
    stripe; the stripes only give the tasks something to share, their number does not grow with the rows.
    """
    blocks = max(1, -(-n_asked // QUERIES))
    stripes = max(1, -(-least_tasks // blocks))
    columns = [*by, "block", "stripe", "side", "id", "norm", "v", *carried]
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_of = lambda n, turn: F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(n)).cast("int")
    left = asked.withColumn("stripe", all_of(stripes)).withColumns({"block": one_of(blocks, 0), "side": F.lit(0)})
    right = rows.withColumn("block", all_of(blocks)).withColumns({"stripe": one_of(stripes, 1), "side": F.lit(1)})
    right = right.withColumns({c: F.lit(None).cast(asked.schema[c].dataType) for c in carried if c not in right.columns})
    at = F.col("block") * stripes + F.col("stripe")
    if by:
        at = F.pmod(F.xxhash64(*by), F.lit(1 << 20)).cast("int") + at
    keys = [*by, "block", "stripe"]
    return (left.select(*columns).unionByName(right.select(*columns)).repartitionById(blocks * stripes, at)
            .sortWithinPartitions(*keys, "side", F.desc("norm"), "id"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of integers as rows, zeros behind the shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, none of them beyond ``bound`` in size.

    By Cauchy-Schwarz no partial sum is either, so the narrowest type that holds such integers exactly is enough.
    """
    width = min(a.shape[1], b.shape[1])
    kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.int64
    return a[:, :width].astype(kind) @ b[:, :width].astype(kind).T


class Block:
    """Queries of one group; ``see`` takes rows by falling length, ``result`` gives what was found."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").to_numpy()
        self.vectors = matrix(table.column("v"))
        self.norms = table.column("norm").to_numpy()

    def see(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def result(self) -> pa.RecordBatch:
        raise NotImplementedError


def _parts(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([(v := batch.column(k).to_numpy())[1:] != v[:-1] for k in keys])
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield tuple(batch.column(k)[a].as_py() for k in keys), batch.slice(a, b - a)


def each_block(make: Callable[[pa.Table], Block], by: Sequence[str] = ()) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over the rows of ``in_blocks``: one ``Block`` per group sees its rows in small steps."""
    keys = [*by, "block", "stripe", "side"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, of, step = None, None, FIRST_ROWS
        for (*group, side), part in _parts(batches, keys):
            if group != of:
                if block is not None:
                    yield block.result()
                held, block, of, step = [], None, group, FIRST_ROWS
            if side == 0:
                held.append(part)
                continue
            if block is None and held:
                block, held = make(pa.Table.from_batches(held)), []
            at = 0
            while block is not None and at < part.num_rows:
                some = part.slice(at, step)
                at, step = at + step, min(2 * step, ROWS)
                block.see(some.column("id").to_numpy(), matrix(some.column("v")), some.column("norm").to_numpy(), some)
        if block is not None:
            yield block.result()

    return run


def keep_best(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each group, ties to the smaller id, groups ascending."""
    order = np.lexsort((ids, -scores, group))
    sorted_ = group[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]
