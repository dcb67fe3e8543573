"""Features per participant from preprocessed samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import distance, mean_of_eyes
from saccadia.operators.describe import five_stats
from saccadia.operators.scan import DEFAULT_CHUNK, dealt, previous, scan, time_chunk

PARTICIPANT = ["experiment", "participant_id"]
VELOCITIES = ["x_velocity_left", "y_velocity_left", "x_velocity_right", "y_velocity_right"]


def accelerations(samples: DataFrame, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Velocity change to the sample before of the same trial, times the sampling rate, per axis and eye."""
    lagged = scan(samples, [*PARTICIPANT, "trial_id"], "time", ["seq"], {"_v": previous(F.struct(*VELOCITIES))},
                  width=width)
    return lagged.withColumns({
        v.replace("velocity", "acceleration"): (F.col(v) - F.col(f"_v.{v}")) * S.SAMPLE_RATE for v in VELOCITIES
    }).drop("_v")


def acceleration(samples: DataFrame, per_eye: bool = False, width: int = DEFAULT_CHUNK) -> DataFrame:
    moved = accelerations(samples, width)
    ax = [F.col(f"x_acceleration_{e}") for e in ("left", "right")]
    ay = [F.col(f"y_acceleration_{e}") for e in ("left", "right")]
    if per_eye:
        return five_stats(moved, PARTICIPANT, {
            "total_acceleration_magnitude_left": distance(ax[0], ay[0]),
            "total_acceleration_magnitude_right": distance(ax[1], ay[1])})
    x, y = mean_of_eyes(*ax), mean_of_eyes(*ay)
    return five_stats(moved, PARTICIPANT, {"total_acceleration_magnitude": distance(x, y), "x_acceleration": x,
                                           "y_acceleration": y})


def moving_average(df: DataFrame, by: Sequence[str], axis: str, ties: Sequence[str], values: Sequence[str], rows: int = 5,
                   chunk: Column | None = None, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Mean of the row and up to ``rows - 1`` rows before it, as ``<value>_avg``; values must not be missing.

    Rows are windowed inside ``(key, chunk)``; the last ``rows - 1`` rows of a chunk are handed to the chunks after it.
    """
    by, ties, back = list(by), list(ties), rows - 1
    chunked = dealt(df.withColumn("_chunk", time_chunk(axis, width) if chunk is None else chunk), *by, "_chunk")
    key = [F.col(axis), *[F.col(t) for t in ties]]
    inside = W.partitionBy(*by, "_chunk").orderBy(*key)
    ending = W.partitionBy(*by, "_chunk").orderBy(*[k.desc() for k in key])

    tails = (chunked.withColumn("_r", F.row_number().over(ending)).where(F.col("_r") <= back)
             .groupBy(*by, "_chunk")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("_r"), *values))),
                              lambda r: F.struct(*[r[v].alias(v) for v in values])).alias("_tail")))
    earlier = W.partitionBy(*by).orderBy("_chunk").rowsBetween(-back, -1)
    halos = tails.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_chunk").alias("_k_chunk"),
                         F.flatten(F.collect_list("_tail").over(earlier)).alias("_halo"))
    same = F.col("_chunk") == F.col("_k_chunk")
    for b in by:
        same = same & (F.col(b) == F.col(f"_k_{b}"))
    frame = inside.rowsBetween(-back, 0)
    joined = chunked.join(halos, same, "left")
    counted = joined.withColumn("_n", F.count("*").over(frame))
    missing = F.greatest(F.least(F.lit(rows) - F.col("_n"), F.size(F.coalesce("_halo", F.array()))), F.lit(0)).cast("int")
    borrowed = F.when(missing > 0, F.slice("_halo", -missing, missing)).otherwise(F.slice("_halo", 1, 0))

    def averaged(value: str) -> Column:
        extra = F.coalesce(F.aggregate(borrowed, F.lit(0.0), lambda acc, r: acc + r[value]), F.lit(0.0))
        return (F.sum(value).over(frame) + extra) / (F.col("_n") + missing)

    return counted.select(*df.columns, *[averaged(v).alias(f"{v}_avg") for v in values])


def smoothed_differences(samples: DataFrame, rows: int = 5, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Differences of the eye positions where both are known, smoothed over all trials of a participant: dx_avg, dy_avg."""
    both = samples.dropna(subset=["x_left", "x_right", "y_left", "y_right"]).select(
        *PARTICIPANT, "trial_id", "time", "seq", (F.col("x_left") - F.col("x_right")).alias("dx"),
        (F.col("y_left") - F.col("y_right")).alias("dy"))
    return moving_average(both, PARTICIPANT, "trial_id", ["time", "seq"], ["dx", "dy"], rows,
                          chunk=F.struct("trial_id", time_chunk("time", width).alias("t")))


def disconjugacy(samples: DataFrame, rows: int = 5, keep_all: bool = True, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Mean squared difference of the smoothed eye positions; NULL without any sample that has both eyes.

    Smoothing runs over all trials of a participant. It is linear, so the differences are smoothed.
    """
    result = smoothed_differences(samples, rows, width).groupBy(*PARTICIPANT).agg(
        (F.avg(F.col("dx_avg") * F.col("dx_avg")) + F.avg(F.col("dy_avg") * F.col("dy_avg"))).alias("Var_total"))
    return samples.select(*PARTICIPANT).distinct().join(result, PARTICIPANT, "left") if keep_all else result


def stimulus_distance(combined: DataFrame, squared_only: bool = False) -> DataFrame:
    """Distance of the gaze to the shown stimulus; the ``_x`` and ``_y`` parts are squared differences."""
    def squared(eye: str, axis: str) -> Column:
        off = F.col(f"{axis}_{eye}") - F.col(f"stimulus_{axis}")
        return off * off

    parts = {(e, a): squared(e, a) for e in ("left", "right") for a in ("x", "y")}
    left, right = parts["left", "x"] + parts["left", "y"], parts["right", "x"] + parts["right", "y"]
    if squared_only:
        return five_stats(combined, PARTICIPANT, {"distance_to_fixpoint": mean_of_eyes(left, right)})
    return five_stats(combined, PARTICIPANT, {
        "distance_to_fixpoint": mean_of_eyes(F.sqrt(left), F.sqrt(right)),
        "distance_to_fixpoint_x": mean_of_eyes(parts["left", "x"], parts["right", "x"]),
        "distance_to_fixpoint_y": mean_of_eyes(parts["left", "y"], parts["right", "y"])})
