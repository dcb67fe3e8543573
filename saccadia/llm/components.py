"""Connected components of an edge table, as alternating star contractions of one shuffle pair each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour: the larger ones, or the smaller ones and itself."""
    if large:
        seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = seen.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = seen.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component.

    ``edges`` has long columns ``a`` and ``b``; self loops and repeated edges do no harm, rows with NULL are left out.
    Large stars and small stars alternate until nothing moves; the minimum of a node's neighbours is pre-aggregated
    per task and joined back, so a hub is a skewed join that the runtime splits. Every round is written to the shared
    folder, which keeps the plan short and lets a lost executor re-read it.
    """
    edges = stage(edges.filter("a is not null and b is not null and a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = stage(_star(_star(edges, large=True), large=False), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
