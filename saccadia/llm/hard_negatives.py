"""Hard negatives by slots: the windows of all positives of an anchor are answered from one pass over the rows.

The upper limits of an anchor's positives cut the scores into disjoint slots. A pass over the rows keeps the k best negatives
of every slot, in each task and then over all tasks. The window of a positive is made of its own slot and those below, so
merging the slots downwards from it gives its k best, however much the windows overlap; its lower limit then cuts the end off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .topk_search import search
from .vectors import Block, each_block, in_blocks, integer_vectors, keep_best, matrix, products


class Slots(Block):
    """The k best rows of another label in each slot of each anchor, among those seen.

    Slot j takes scores from ``low`` to ``high``: up to its upper limit, above the next one, and no lower than a window that
    uses the slot allows. ``low`` rises to the k-th best of the slot.
    """

    def __init__(self, table: pa.Table, k: int):
        super().__init__(table)
        self.k, self.labels = k, table.column("label").to_numpy()
        limits, least = matrix(table.column("limits")), matrix(table.column("least"))
        used = np.arange(limits.shape[1]) < np.array([len(x) for x in table.column("limits")])[:, None]
        following = np.concatenate((limits[:, 1:], np.full((len(limits), 1), -1)), axis=1)
        following[:, :-1][~used[:, 1:]] = -1
        self.high = np.where(used, limits, -2)
        self.low = np.where(used, np.maximum(following + 1, least), np.iinfo(np.int64).max)
        self.slot, self.found, self.scores = (np.empty(0, np.int64) for _ in range(3))

    def see(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, batch: pa.RecordBatch) -> None:
        lowest = self.low.min(axis=1)
        live = np.flatnonzero(lowest <= self.norms * norms[0] * (1 + 1e-9))
        if not len(live):
            return
        score = products(self.vectors[live], vectors, float(self.norms[live].max() * norms[0]))
        anchor, row = np.nonzero((score >= lowest[live][:, None]) & (score <= self.high[live].max(axis=1)[:, None]))
        score = score[anchor, row].astype(np.int64)
        anchor = live[anchor]
        other = self.labels[anchor] != batch.column("label").to_numpy()[row]
        anchor, row, score = anchor[other], row[other], score[other]
        slot = (self.high[anchor] >= score[:, None]).sum(axis=1) - 1  # limits fall, so the last that is not exceeded
        enough = score >= self.low[anchor, slot]
        self._keep(anchor[enough] * self.high.shape[1] + slot[enough], ids[row[enough]], score[enough])

    def _keep(self, slot: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        if not len(slot):
            return
        slot, found, scores = (np.concatenate(x) for x in ((self.slot, slot), (self.found, found), (self.scores, scores)))
        best = keep_best(slot, scores, found, self.k)
        self.slot, self.found, self.scores = slot[best], found[best], scores[best]
        last = np.flatnonzero(np.concatenate((self.slot[1:] != self.slot[:-1], [True])))
        counts = np.diff(np.concatenate(([-1], last)))
        full = last[counts >= self.k]
        self.low.reshape(-1)[self.slot[full]] = self.scores[full]

    def result(self) -> pa.RecordBatch:
        n = max(self.high.shape[1], 1)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.slot // n]), pa.array((self.slot % n).astype(np.int32)), pa.array(self.found),
                                           pa.array(self.scores)], ["anchor_id", "slot", "negative_id", "score"])


def windows(positives: DataFrame, least_pct: int, most_pct: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, low, high): the whole scores allowed; positives of an empty window are left out.

    With 0 < least_pct <= most_pct a positive below zero has an empty window.
    """
    p = F.col("positive_score")
    return positives.where(p >= 0).withColumns({
        "low": F.expr(f"({least_pct} * positive_score + 99) div 100"), "high": F.expr(f"({most_pct} * positive_score) div 100")}).where("low <= high")


def mine(df: DataFrame, label, n_positives: int = 5, k: int = 3, least_pct: int = 50, most_pct: int = 95, every: int = 50,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor, a row whose id ``every`` divides.

    Positives are the ``n_positives`` best other rows of the anchor's label; negatives the ``k`` best rows of another label whose
    score is between ``least_pct`` and ``most_pct`` percent of the positive's. Higher scores come first, ties by smaller id.
    Which rows take part is told by ``vectors.integer_vectors``. An anchor without positives, a positive whose window is
    empty and a positive without negatives give no rows; nor does an empty table. Other columns may have any name.
    """
    rows = stage(integer_vectors(df, scale, id_col, vector_col, label), "vectors")
    anchors = rows.where(F.col("id") % every == 0)
    positives = search(anchors, rows, n_positives, by=["label"]).select(
        F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = stage(windows(positives, least_pct, most_pct), "windows")
    # at most n_positives limits in a list
    limits = wanted.groupBy("anchor_id", "high").agg(F.min("low").alias("low")).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("high", "low")), asc=False).alias("slots"))
    asked = anchors.join(limits, anchors["id"] == limits["anchor_id"]).select(
        "id", "label", "v", "norm", F.col("slots.high").alias("limits"), F.col("slots.low").alias("least"))
    met = in_blocks(asked, rows, [], ["label", "limits", "least"], wanted.select("anchor_id").distinct().count(),
                    2 * df.sparkSession.sparkContext.defaultParallelism)
    found = met.mapInArrow(each_block(lambda table: Slots(table, k)), "anchor_id long, slot int, negative_id long, score long")
    best = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "negative_id"))
    kept = found.withColumn("_rank", best).where(F.col("_rank") <= k)
    # at most k * n_positives negatives in a list, the highest slot first
    merged = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(
        F.struct("slot", (-F.col("score")).alias("down"), "negative_id"))).alias("negatives"))
    own = limits.select("anchor_id", F.posexplode("slots").alias("slot", "limit")).select("anchor_id", "slot", F.col("limit.high").alias("high"))
    asked_for = wanted.join(own, ["anchor_id", "high"]).join(merged, "anchor_id")
    suffix = F.slice(F.filter("negatives", lambda n: n["slot"] >= F.col("slot")), 1, k)
    window = F.filter(suffix, lambda n: -n["down"] >= F.col("low"))
    return asked_for.select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.negative_id").alias("negative_id"),
        "positive_score", (-F.col("n.down")).alias("negative_score"))
