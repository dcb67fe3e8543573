"""Features per participant from preprocessed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import (centre_area, distance, saccade_direction_1d, saccade_direction_2d,
                                        saccade_end_area)
from saccadia.operators.describe import FIVE, five_stats
from saccadia.operators.scan import DEFAULT_CHUNK, attach, first_of_all, last, order_key, previous, scan, sum_before, \
    total

PARTICIPANT = ["experiment", "participant_id"]
TRIAL = [*PARTICIPANT, "trial_id"]


def _event(name: str) -> Column:
    return F.col("event") == name


def active_rows(events: DataFrame, eye: str | None = None) -> DataFrame:
    """Rows while the stimulus shows; with ``eye`` only that eye and the rows without one."""
    rows = events.where("stimulus_active")
    return rows if eye is None else rows.where(F.col("eye").isNull() | (F.col("eye") == eye))


def precalculated_metrics(events: DataFrame) -> DataFrame:
    """Recorder metrics of saccades and fixations."""
    sacc, fix = _event("ESACC"), _event("EFIX")
    return five_stats(events.where(sacc | fix), PARTICIPANT, {
        ("peak_velocity", "sacc"): F.when(sacc, F.col("peak_velocity")),
        ("amplitude", "sacc"): F.when(sacc, F.col("amplitude")),
        ("duration", "sacc"): F.when(sacc, F.col("duration")),
        ("duration", "fix"): F.when(fix, F.col("duration")),
        ("avg_pupil_size", "fix"): F.when(fix, F.col("avg_pupil_size")),
    })


def mean_metrics(events: DataFrame, eye: str | None = None) -> DataFrame:
    """Means only, one conditional aggregate."""
    sacc, fix = _event("ESACC"), _event("EFIX")
    rows = events if eye is None else events.where(F.col("eye").isNull() | (F.col("eye") == eye))
    return rows.groupBy(*PARTICIPANT).agg(
        F.avg(F.when(sacc, F.col("peak_velocity"))).alias("mean_peak_velocity_sacc"),
        F.avg(F.when(sacc, F.col("amplitude"))).alias("mean_amplitude_sacc"),
        F.avg(F.when(sacc, F.col("duration"))).alias("mean_duration_sacc"),
        F.avg(F.when(fix, F.col("duration"))).alias("mean_duration_fix"),
        F.avg(F.when(fix, F.col("avg_pupil_size"))).alias("mean_pupil_size_fix"))


def fixation_distance(events: DataFrame, active_only: bool = True, stats=FIVE, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Distance between consecutive fixations of the same trial and eye."""
    fixations = (events.where("stimulus_active") if active_only else events).where(_event("EFIX"))
    moved = scan(fixations, [*TRIAL, "eye"], "time", ["seq"], {"_before": previous(F.struct("x", "y"))}, width=width)
    known = F.col("eye").isNotNull()
    dx = F.when(known, F.col("x") - F.col("_before.x"))
    dy = F.when(known, F.col("y") - F.col("_before.y"))
    return five_stats(moved, PARTICIPANT, {"fixation_distance": distance(dx, dy), "x_fixation_dist": dx,
                                           "y_fixation_dist": dy}, stats)


def _mean_over_eyes(per_eye: DataFrame, value: str, name: str) -> DataFrame:
    """Per trial the sum over eyes divided by the number of eyes."""
    return (per_eye.groupBy(*TRIAL).agg(F.sum(value).alias("_total"), F.count("*").alias("_eyes"))
            .select(*TRIAL, (F.col("_total") / F.col("_eyes")).alias(name)))


def event_rate(events: DataFrame, event: str, name: str, eye: str | None = None,
               width: int = DEFAULT_CHUNK) -> DataFrame:
    """Events per second and trial: each event counts against the time from its latest stimulus to the trial's end.

    A zero duration gives no rate.
    """
    rows = active_rows(events, eye)
    timed = scan(rows, TRIAL, "time", ["seq"],
                 {"_shown": last(F.when(_event("FIXPOINT"), F.col("time"))), "_end": total(F.max, F.col("time"))},
                 width=width)
    seconds = (F.col("_end") - F.col("_shown")) / 1000
    counted = (timed.where(_event(event) & F.col("eye").isNotNull())
               .groupBy(*TRIAL, "eye", seconds.alias("_s")).agg(F.count("*").alias("_n"))
               .where(F.col("_s").isNotNull()))
    per_eye = counted.groupBy(*TRIAL, "eye").agg(F.sum(F.try_divide(F.col("_n"), F.col("_s"))).alias("_rate"))
    return _mean_over_eyes(per_eye, "_rate", name)


def fixations_per_second(events: DataFrame, width: int = DEFAULT_CHUNK) -> DataFrame:
    rates = event_rate(events, "EFIX", "fixations_per_second", width=width)
    return five_stats(rates, PARTICIPANT, {"fixations_per_second": F.col("fixations_per_second")})


def saccades_per_second(events: DataFrame, width: int = DEFAULT_CHUNK) -> DataFrame:
    rates = event_rate(events, "ESACC", "saccades_per_second", width=width)
    return five_stats(rates, PARTICIPANT, {"saccades_per_second": F.col("saccades_per_second")})


def one_eye_rate(events: DataFrame, event: str, name: str, eye: str = "R", width: int = DEFAULT_CHUNK) -> DataFrame:
    """Mean and std of the per-stimulus rates of one eye."""
    rows = active_rows(events, eye)
    timed = scan(rows, TRIAL, "time", ["seq"],
                 {"_shown": last(F.when(_event("FIXPOINT"), F.col("time"))), "_end": total(F.max, F.col("time"))},
                 width=width)
    seconds = (F.col("_end") - F.col("_shown")) / 1000
    rates = (timed.where(_event(event)).groupBy(*TRIAL, seconds.alias("_s")).agg(F.count("*").alias("_n"))
             .select(*PARTICIPANT, F.try_divide(F.col("_n"), F.col("_s")).alias("_rate")).where("_rate is not null"))
    return rates.groupBy(*PARTICIPANT).agg(F.avg("_rate").alias(f"avg_{name}"), F.stddev_samp("_rate").alias(f"std_{name}"))


# --- correctness of trials -------------------------------------------------------------------------------------------

def _judged(rows: DataFrame, correct: Column, extra: dict, width: int) -> DataFrame:
    rows = rows.withColumn("is_saccade_correct", correct)
    return scan(rows, TRIAL, "time", ["seq"], {
        **extra, "is_trial_correct": first_of_all(F.col("is_saccade_correct"))}, width=width)


def antisaccade_rows(events: DataFrame, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Active rows with the verdict on each saccade and on the trial: right means away from the stimulus side."""
    direction, area, side = F.col("saccade_direction"), F.col("saccade_end_area"), F.col("side")
    sacc = _event("ESACC")
    rows = events.where("stimulus_active").withColumns({
        "saccade_direction": F.when(sacc, saccade_direction_1d()),
        "saccade_end_area": F.when(sacc, saccade_end_area(F.col("end_x")))})
    correct = F.when((direction != "no_direction") & (area != "middle") & (direction == area), direction != side)
    return _judged(rows, correct, {"stimulus_time": last(F.when(_event("FIXPOINT"), F.col("time")))}, width)


def reaction_rows(events: DataFrame, vertical: str = "reference", width: int = DEFAULT_CHUNK) -> DataFrame:
    """Active rows with the verdict on each saccade and on the trial: right means towards the shown stimulus."""
    rows = events.where("stimulus_active")
    shown = F.when(_event("FIXPOINT"), centre_area(F.col("stimulus_x"), F.col("stimulus_y"), vertical))
    rows = scan(rows.withColumn("saccade_direction", F.when(_event("ESACC"), saccade_direction_2d())), TRIAL, "time",
                ["seq"], {"stimulus_direction": last(shown),
                          "stimulus_time": last(F.when(_event("FIXPOINT"), F.col("time")))}, width=width)
    direction = F.col("saccade_direction")
    correct = F.when(direction.isNotNull(),
                     (direction != "no_direction") & direction.eqNullSafe(F.col("stimulus_direction")))
    return _with_trial_verdict(rows.withColumn("is_saccade_correct", correct))


def _with_trial_verdict(rows: DataFrame) -> DataFrame:
    verdict = F.col("is_saccade_correct")
    return attach(rows, TRIAL,
                  is_trial_correct=F.min_by(verdict, F.when(verdict.isNotNull(), order_key("time", ["seq"]))))


def correct_trials(judged: DataFrame) -> DataFrame:
    """Number and share of correct trials; trials without a verdict do not count."""
    trials = judged.groupBy(*TRIAL).agg(F.min("is_trial_correct").alias("ok"))
    n, known = F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0)), F.count("ok")
    return trials.groupBy(*PARTICIPANT).agg(n.alias("n_correct_trials"), F.try_divide(n, known).alias("prop_correct_trials"))


def n_correct_trials(judged: DataFrame) -> DataFrame:
    return correct_trials(judged).drop("prop_correct_trials")


def prop_correct_trials(judged: DataFrame) -> DataFrame:
    return correct_trials(judged).drop("n_correct_trials")


def reaction_time(judged: DataFrame) -> DataFrame:
    """Time from stimulus to the first correct saccade of each trial."""
    delay = F.struct((F.col("start_time") - F.col("stimulus_time")).alias("v"))
    firsts = (judged.where("is_saccade_correct").groupBy(*TRIAL)
              .agg(F.min_by(delay, order_key("time", ["seq"]))["v"].alias("rt")))
    return firsts.groupBy(*PARTICIPANT).agg(F.avg("rt").alias("reaction_time_avg"),
                                            F.stddev_samp("rt").alias("reaction_time_std"))


# --- fitts' law ------------------------------------------------------------------------------------------------------

def first_two_targets(rows: DataFrame, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Coordinates of the first and second FIXPOINT of each trial."""
    points = rows.where(_event("FIXPOINT")).select(*TRIAL, "time", "seq", "stimulus_x", "stimulus_y")
    numbered = scan(points, TRIAL, "time", ["seq"], {"_n": sum_before(F.lit(1))}, width=width).where("_n < 2")
    at = F.struct("stimulus_x", "stimulus_y")
    return numbered.groupBy(*TRIAL).agg(F.max(F.when(F.col("_n") == 0, at)).alias("_one"),
                                          F.max(F.when(F.col("_n") == 1, at)).alias("_two"))


def nearest_target_distance(rows: DataFrame, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Distance to the closer of the first two targets, for the rows of trials that have a target."""
    def to(target: str) -> Column:
        return distance(F.col("x") - F.col(f"{target}.stimulus_x"), F.col("y") - F.col(f"{target}.stimulus_y"))

    return (rows.join(first_two_targets(rows, width), TRIAL)
            .withColumns({"distance_to_stimulus_1": to("_one"), "distance_to_stimulus_2": to("_two")})
            .withColumn("distance_to_nearest_stimulus", F.least("distance_to_stimulus_1", "distance_to_stimulus_2"))
            .drop("_one", "_two"))


def fixation_overshoot(events: DataFrame, eye: str | None = None, stats=FIVE, width: int = DEFAULT_CHUNK) -> DataFrame:
    rows = nearest_target_distance(active_rows(events, eye), width).where(_event("EFIX") & F.col("eye").isNotNull())
    per_eye = rows.groupBy(*TRIAL, "eye").agg(F.avg("distance_to_nearest_stimulus").alias("_d"))
    per_trial = _mean_over_eyes(per_eye.withColumn("_d", F.coalesce("_d", F.lit(0.0))), "_d", "fixation_overshoot")
    return five_stats(per_trial, PARTICIPANT, {"fixation_overshoot": F.col("fixation_overshoot")}, stats)


# --- king-devick -----------------------------------------------------------------------------------------------------

def mistakes_per_trial(events: DataFrame) -> DataFrame:
    return events.where(_event("TRIAL_VAR_DATA")).groupBy(*PARTICIPANT).agg(F.avg("marks").alias("avg_mistakes_pr_trial"))


def elapsed_per_trial(events: DataFrame) -> DataFrame:
    return (events.where(_event("TRIAL_VAR_DATA")).groupBy(*PARTICIPANT)
            .agg(F.avg("time_elapsed").alias("avg_time_elapsed_pr_trial")))


def _timed_saccades(events: DataFrame, eye: str | None = None) -> DataFrame:
    rows = events.where(_event("ESACC") & (F.col("time") / 1000 < F.col("time_elapsed")) & F.col("eye").isNotNull())
    return rows if eye is None else rows.where(F.col("eye") == eye)


def wrong_direction_share(events: DataFrame, eye: str | None = None, stats=FIVE) -> DataFrame:
    """Share of leftward saccades in percent; trials and eyes without any leftward saccade do not count."""
    left = F.when(F.col("end_x") < F.col("start_x"), 1).when(F.col("end_x") > F.col("start_x"), 0)
    per_eye = (_timed_saccades(events, eye).groupBy(*TRIAL, "eye")
               .agg(F.sum(left).alias("_left"), F.count(left).alias("_n")).where("_left > 0")
               .select(*TRIAL, (100 * F.col("_left") / F.col("_n")).alias("_pct")))
    name = "wrong_direction_saccade_pct"
    return five_stats(_mean_over_eyes(per_eye, "_pct", name), PARTICIPANT, {name: F.col(name)}, stats)


def timed_saccades_per_second(events: DataFrame, eye: str | None = None, stats=FIVE) -> DataFrame:
    """Saccades before the elapsed time, per second of it."""
    elapsed = F.col("time_elapsed")
    spent = events.groupBy(*TRIAL).agg(
        F.min_by(elapsed, F.when(elapsed.isNotNull(), order_key("time", ["seq"]))).alias("_s"))
    per_eye = (_timed_saccades(events, eye).groupBy(*TRIAL, "eye").agg(F.count("*").alias("_n"))
               .join(spent, TRIAL).select(*TRIAL, F.try_divide(F.col("_n"), F.col("_s")).alias("_rate")))
    return five_stats(_mean_over_eyes(per_eye, "_rate", "saccades_per_second"), PARTICIPANT,
                      {"saccades_per_second": F.col("saccades_per_second")}, stats)
