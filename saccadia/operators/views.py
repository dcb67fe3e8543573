"""Tables behind the exploratory reports: eye copies, scan paths, group counts, playback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import gaze_direction, scan_path_class
from saccadia.operators import joins
from saccadia.operators.fills import coalesce_time, relative_times
from saccadia.operators.scan import DEFAULT_CHUNK, first_of_all, following, last, scan, sum_before, total

FILLED = ("colour", "stimulus_x", "stimulus_y")


def eye_copies(events: DataFrame) -> DataFrame:
    """One row per eye; events without an eye appear for both."""
    both = F.array(F.lit("L"), F.lit("R"))
    return events.withColumn("eye", F.explode(F.when(F.col("eye").isNull(), both).otherwise(F.array("eye"))))


def per_eye_events(events: DataFrame, fallback: str = "start_time", two_way: tuple[str, ...] = (),
                   width: int = DEFAULT_CHUNK) -> DataFrame:
    """Eye copies without start events, on the trial clock of each eye, with colour and stimulus carried forward.

    ``two_way`` columns are filled from earlier rows, then from later ones.
    """
    rows = coalesce_time(eye_copies(events.where(~F.col("event").isin("SSACC", "SFIX"))), fallback)
    items = {f"_f_{c}": last(F.col(c)) for c in FILLED}
    items |= {f"_f_{c}": last(F.col(c)) for c in two_way} | {f"_b_{c}": following(F.col(c)) for c in two_way}
    items |= {"_t0": total(F.min, F.col("time")), "_side": first_of_all(F.col("side"))}
    done = scan(rows, [*S.trial_of(rows), "eye"], "time", ["seq"], items, width=width)
    return done.withColumns({
        **{c: F.col(f"_f_{c}") for c in FILLED}, **{c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in two_way},
        "side": F.col("_side"), **relative_times(F.col("_t0"), ["time", "start_time", "end_time"])}).drop(*items)


def scan_path(events: DataFrame, experiment: str, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Fixations and stimuli of every trial in order, with class label and number within eye and class."""
    rows = per_eye_events(events, two_way=("time_elapsed",) if experiment == "KING_DEVICK" else (), width=width)
    if experiment == "KING_DEVICK":
        rows = rows.where((F.col("event") == "EFIX") & (F.col("time") < F.col("time_elapsed") * 1000))
    else:
        rows = rows.where(F.col("event").isin("EFIX", "FIXPOINT"))
    if experiment in ("ANTI_SACCADE", "REACTION"):
        rows = rows.where(F.col("colour").isin(S.WHITE, S.RED))
    rows = rows.withColumns({"plot_x": F.coalesce("x", "stimulus_x"), "plot_y": F.coalesce("y", "stimulus_y"),
                             "plot_class": F.coalesce(scan_path_class(experiment), F.lit(""))})
    numbered = scan(rows, [*S.trial_of(rows), "eye", "plot_class"], "time", ["seq"], {"_n": sum_before(F.lit(1))}, width=width)
    return numbered.select(*S.TRIAL, "eye", "time", "seq", "event", "plot_x", "plot_y",
                           F.when(F.col("plot_class") != "", F.col("plot_class")).alias("plot_class"),
                           (F.col("_n") + 1).alias("event_nr"))


def incorrect_trials(events: DataFrame, people: DataFrame, eye: str = "L", width: int = DEFAULT_CHUNK) -> DataFrame:
    """Trials per group with and without a fixation on the stimulus side while the red stimulus shows."""
    rows = per_eye_events(events.where(F.col("eye").isNull() | (F.col("eye") == eye)), "end_time", width=width)
    kinds = ("FIXPOINT", "EFIX", "START", "END", "TRIALID", "TRIAL_VAR_DATA")
    rows = rows.where((F.col("eye") == eye) & F.col("event").isin(*kinds))
    wrong = F.coalesce(gaze_direction() == F.col("side"), F.lit(False))
    trials = rows.groupBy(*S.trial_of(rows)).agg(F.bool_or(wrong).alias("is_trial_incorrect"))
    return (trials.join(people.select("participant_id", "group"), "participant_id", "left")
            .groupBy("group", "is_trial_incorrect").agg(F.count("*").alias("n")))


def fixations_by_group(events: DataFrame, people: DataFrame, eye: str = "R") -> DataFrame:
    """Mean over participants of their mean number of fixations per trial, by group."""
    fixations = events.where((F.col("event") == "EFIX") & (F.col("eye").isNull() | (F.col("eye") == eye)))
    per_trial = fixations.groupBy(*S.trial_of(fixations)).agg(F.count("*").alias("n"))
    per_person = per_trial.groupBy("participant_id").agg(F.avg("n").alias("avg_fix_pr_trial"))
    return (per_person.join(people.select("participant_id", "group"), "participant_id", "left")
            .groupBy("group").agg(F.avg("avg_fix_pr_trial").alias("avg_fix_pr_trial")))


def every_nth(rows: DataFrame, n: int = 100, by=None, axis: str = "time", tie: str = "seq",
              width: int = DEFAULT_CHUNK) -> DataFrame:
    """Rows 0, n, 2n, ... of each series."""
    return (scan(rows, S.trial_of(rows) if by is None else by, axis, [tie], {"_n": sum_before(F.lit(1))}, width=width)
            .where(F.col("_n") % n == 0).drop("_n"))


def playback(samples: DataFrame, events: DataFrame, n: int = 100, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Every n-th sample with the stimulus last shown."""
    return every_nth(joins.with_fixpoints(samples, events, "FIXATIONS", width=width), n, width=width)
