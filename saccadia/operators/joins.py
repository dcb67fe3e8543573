"""Joins along time: as-of joins and assignment to trial intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import colour_name
from saccadia.operators.scan import DEFAULT_CHUNK, following, last, scan


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], columns: Sequence[str], on: str = "time",
         tie: str = "seq", direction: str = "backward", tolerance: float | None = None,
         width: int = DEFAULT_CHUNK, matched_on: str | None = None) -> DataFrame:
    """For every left row the nearest right row of the same key, one output row per left row.

    ``backward`` takes the last right row at or before the left one, ``nearest`` the closer of that row and the first
    later one (a distance tie goes backward). A match farther than ``tolerance`` is dropped; the limit itself counts.
    A left row without a time matches nothing.
    Both sides are put in one ordered scan, so the cost is one shuffle of the left side however many right rows match.
    """
    by, columns = list(by), list(columns)
    payload = F.struct(F.col(on).alias("_on"), *columns)
    rights = right.where(F.col(on).isNotNull()).select(*by, on, tie, F.lit(0).alias("_side"), payload.alias("_match"))
    lefts = left.withColumn("_side", F.lit(1))
    items = {"_back": last(F.col("_match"))}
    if direction == "nearest":
        items["_ahead"] = following(F.col("_match"))
    elif direction != "backward":
        raise ValueError(f"unknown direction {direction!r}")
    merged = scan(lefts.unionByName(rights, allowMissingColumns=True), by, on, ["_side", tie], items, width=width)
    found = merged.where(F.col("_side") == 1)
    match, gap = F.col("_back"), F.abs(F.col(on) - F.col("_back._on"))
    if direction == "nearest":
        ahead = F.col("_ahead._on") - F.col(on)
        use_back = F.col("_back").isNotNull() & (F.col("_ahead").isNull() | (gap <= ahead))
        match = F.when(use_back, F.col("_back")).otherwise(F.col("_ahead"))
    # Rows without a time stand behind all others in the scan, but are near to nothing.
    found = found.withColumn("_match", F.when(F.col(on).isNotNull(), match))
    if tolerance is not None:
        near = F.abs(F.col(on) - F.col("_match._on")) <= tolerance
        found = found.withColumn("_match", F.when(near, F.col("_match")))
    extra = [F.col("_match._on").alias(matched_on)] if matched_on else []
    keep = [c for c in left.columns if c not in columns]
    return found.select(*keep, *[F.col(f"_match.{c}").alias(c) for c in columns], *extra)


def with_fixpoints(samples: DataFrame, events: DataFrame, experiment: str, tolerance: float = 10,
                   width: int = DEFAULT_CHUNK) -> DataFrame:
    """Samples with the fixpoint shown: the latest one for FIXATIONS, the nearest within the tolerance elsewhere."""
    points = events.where(F.col("event") == "FIXPOINT").withColumn("fixpoint", colour_name(F.col("colour")))
    columns = ["event", "fixpoint", "stimulus_x", "stimulus_y"]
    by = S.trial_of(samples) if "experiment" in points.columns else S.TRIAL
    if experiment == "FIXATIONS":
        return asof(samples, points, by, columns, width=width)
    return asof(samples, points, by, columns, direction="nearest", tolerance=tolerance, width=width)


def trial_intervals(events: DataFrame, trial_key: str = "trial_id") -> DataFrame:
    """START and END time per trial; ``trial_key='ordinal'`` numbers the trials of a participant from 0."""
    event, time = F.col("event"), F.col("time")
    spans = (events.where(event.isin("START", "END") & F.col("trial_id").isNotNull()).groupBy(*S.trial_of(events))
             .agg(F.max(F.when(event == "START", time)).alias("start_time"),
                  F.max(F.when(event == "END", time)).alias("end_time")))
    if trial_key == "ordinal":
        rank = F.row_number().over(W.partitionBy(*S.trial_of(events)[:-1]).orderBy("trial_id"))
        spans = spans.withColumn("trial_id", (rank - 1).cast("bigint"))
    return spans


def assign_trials(points: DataFrame, intervals: DataFrame, width: int = 60_000, on: str = "time") -> DataFrame:
    """Put every point into the trial of its participant that contains it, both ends included.

    Points outside every trial are dropped; where trials overlap the highest trial wins. The intervals are listed per
    time bucket, so a point meets only the trials of its own bucket and a long recording spreads over its buckets.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("start_time") / width), F.floor(F.col("end_time") / width)))
    listed = (intervals.where("start_time <= end_time")
              .select("participant_id", bucket.alias("_bucket"),
                      F.struct(F.col("trial_id").alias("t"), F.col("start_time").alias("s"), F.col("end_time").alias("e"))
                      .alias("_i"))
              .groupBy(F.col("participant_id").alias("_p"), "_bucket")
              .agg(F.sort_array(F.collect_list("_i"), asc=False).alias("_trials")))
    at = F.col(on)
    joined = points.withColumn("_b", F.floor(at / width)).join(
        listed, (F.col("participant_id") == F.col("_p")) & (F.col("_b") == F.col("_bucket")))
    hit = F.get(F.filter("_trials", lambda i: (i["s"] <= at) & (at <= i["e"])), F.lit(0))["t"]
    keep = [c for c in points.columns if c != "trial_id"]
    return joined.select(*keep, hit.alias("trial_id")).where(F.col("trial_id").isNotNull())
