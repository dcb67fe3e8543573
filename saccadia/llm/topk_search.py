"""Exact top-k search by inner product over norm buckets.

Rows come by falling length and are cut into buckets of similar length. A query's k-th best score so far, over its own length
and the longest of the bucket, is the cosine that a row of the bucket must reach: its local threshold. Above 1 the bucket is
passed over. A high threshold prunes by coordinates: where two unit vectors have a cosine of t or more, every coordinate of
one lies in a short range around that of the other, and the bucket's sorted coordinate lists give the rows of that range. A
low one prunes by length: only rows of the bucket long enough for the threshold are multiplied. What is left is verified by
exact integer products.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .vectors import Block, each_block, in_blocks, integer_vectors, keep_best, products

#: Local cosine threshold from which coordinates prune better than lengths, and the coordinates looked at.
COORDINATES_FROM, FOCUS = 0.85, 4
#: Allowance for rounding: bounds are widened by this share.
SLACK = 1e-9


class _Bucket:
    """Rows of similar length; coordinate lists are sorted when first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        self.ids, self.vectors, self.norms = ids, vectors, norms
        self.unit = vectors / np.maximum(norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def near(self, unit: np.ndarray, focus: np.ndarray, t: float) -> np.ndarray:
        """Rows whose focus coordinates lie where a cosine of ``t`` with ``unit`` needs them."""
        rows = None
        for f in focus.tolist():
            if f >= self.unit.shape[1]:
                continue
            # the angles between the axis and the query, give or take the largest angle allowed
            middle, reach = unit[f] * t, np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-7
            low = -1.0 if unit[f] <= -t else middle - reach
            high = 1.0 + 1e-7 if unit[f] >= t else middle + reach
            if rows is None:
                values, order = self.list_of(f)
                rows = order[np.searchsorted(values, low - 1e-7):np.searchsorted(values, high, "right")]
            else:
                at = self.unit[rows, f]
                rows = rows[(at >= low - 1e-7) & (at <= high)]
        return np.arange(len(self.ids)) if rows is None else rows


class TopK(Block):
    """The k best rows of each query among those seen."""

    def __init__(self, table: pa.Table, k: int):
        super().__init__(table)
        self.k = k
        self.unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.threshold = np.full(len(self.ids), -np.inf)  # k-th best score so far
        self.query, self.found, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.looked_at = {"passed over": 0, "coordinates": 0, "length": 0}  # queries times buckets by way of pruning

    def see(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, batch: pa.RecordBatch) -> None:
        bucket, longest = _Bucket(ids, vectors, norms), float(norms[0])
        reachable = self.norms * longest * (1 + SLACK)
        live = np.flatnonzero(self.threshold <= reachable)
        self.looked_at["passed over"] += len(self.ids) - len(live)
        needed = self.threshold[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reachable[live] > 0, needed / reachable[live], -np.inf)
        by_coordinates = local >= COORDINATES_FROM
        hits = [*self._by_coordinates(bucket, live[by_coordinates], local[by_coordinates]), *self._by_length(bucket, live[~by_coordinates])]
        if hits:
            query, row, score = (np.concatenate(x) for x in zip(*hits))
            other = self.ids[query] != ids[row]
            self._keep(query[other], ids[row[other]], score[other])

    def _by_coordinates(self, bucket: _Bucket, queries: np.ndarray, local: np.ndarray):
        self.looked_at["coordinates"] += len(queries)
        for q, t in zip(queries.tolist(), np.minimum(local, 1.0).tolist()):
            rows = bucket.near(self.unit[q], self.focus[q], t)
            if len(rows):
                score = products(self.vectors[q:q + 1], bucket.vectors[rows], self.norms[q] * bucket.norms[0])[0]
                enough = score >= self.threshold[q]
                yield np.full(int(enough.sum()), q), rows[enough], score[enough].astype(np.int64)

    def _by_length(self, bucket: _Bucket, queries: np.ndarray):
        self.looked_at["length"] += len(queries)
        if not len(queries):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(self.norms[queries] > 0, self.threshold[queries] / self.norms[queries], -np.inf) * (1 - SLACK)
        n = int(np.searchsorted(-bucket.norms, -shortest.min(), "right"))
        if n:
            score = products(self.vectors[queries], bucket.vectors[:n], float(self.norms[queries].max() * bucket.norms[0]))
            q, row = np.nonzero(score >= self.threshold[queries][:, None])
            yield queries[q], row, score[q, row].astype(np.int64)

    def _keep(self, query: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        query, found, scores = (np.concatenate(x) for x in ((self.query, query), (self.found, found), (self.scores, scores)))
        best = keep_best(query, scores, found, self.k)
        self.query, self.found, self.scores = query[best], found[best], scores[best]
        full = np.bincount(self.query, minlength=len(self.ids)) >= self.k
        last = np.concatenate((self.query[1:] != self.query[:-1], [True])) if len(self.query) else np.empty(0, bool)
        self.threshold[self.query[last]] = self.scores[last]
        self.threshold[~full] = -np.inf

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.found), pa.array(self.scores)],
                                          ["query_id", "vec_id", "score"])


def search(queries: DataFrame, rows: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for every query, its own id left out.

    Both tables have the columns of ``vectors.integer_vectors``; with ``by`` only rows of equal values meet. Ties go to the
    smaller id, ranks begin at 1. A query with fewer other rows gets them all; empty tables give an empty result.
    """
    by = list(by)
    most = queries.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    met = in_blocks(queries, rows, by, [], most, 2 * queries.sparkSession.sparkContext.defaultParallelism)
    found = met.mapInArrow(each_block(lambda table: TopK(table, k), by), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` rows of highest integer inner product for every row whose id is divisible by ``every``."""
    rows = stage(integer_vectors(df, scale), "vectors")
    return search(rows.where(F.col("id") % every == 0), rows, k)
