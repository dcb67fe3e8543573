"""Row filters and trial validity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S

# How many FIXPOINT events a valid trial has, as (smallest, largest or None).
FIXPOINT_COUNT = {
    "ANTI_SACCADE": (2, 2), "REACTION": (2, 2), "FITTS_LAW": (2, 2), "FIXATIONS": (1, 1),
    "EVIL_BASTARD": (1, None), "SMOOTH_PURSUITS": (1, None), "SHAPES": (1, None),
}
TWO_STEP = ("ANTI_SACCADE", "REACTION")
ONCE_PER_TRIAL = ("TRIALID", "TRIAL_VAR_DATA", "START", "END")


def keep_rows(events: DataFrame, experiment: str, excluded: list[int] | None = None) -> DataFrame:
    """Rows of known, not excluded participants; blue fixpoints of EVIL_BASTARD are dropped, unknown colours kept."""
    excluded = S.EXCLUDED_PARTICIPANTS if excluded is None else excluded
    kept = events.where(F.col("participant_id").isNotNull())
    if excluded:
        kept = kept.where(~F.col("participant_id").isin(excluded))
    if experiment == "EVIL_BASTARD":
        kept = kept.where(~F.col("colour").eqNullSafe(S.BLUE))
    return kept


def trial_rules(experiment: str) -> dict[str, tuple[Column, int, int | None]]:
    """Validity rules as name -> (row condition, smallest, largest count per trial)."""
    event, colour = F.col("event"), F.col("colour")
    rules: dict[str, tuple[Column, int, int | None]] = {name: (event == name, 1, 1) for name in ONCE_PER_TRIAL}
    if experiment in FIXPOINT_COUNT:
        rules["FIXPOINT"] = (event == "FIXPOINT", *FIXPOINT_COUNT[experiment])
    if experiment in TWO_STEP:
        rules["RED"] = ((event == "FIXPOINT") & (colour == S.RED), 1, 1)
        rules["WHITE"] = ((event == "FIXPOINT") & (colour == S.WHITE), 1, 1)
    if experiment == "KING_DEVICK":
        rules["MARKS"] = ((event == "TRIAL_VAR_DATA") & F.col("marks").cast("string").rlike("^[0-9]+$"), 1, None)
    return rules


def as_count(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def rule_holds(count: Column, smallest: int, largest: int | None) -> Column:
    return count >= smallest if largest is None else count.between(smallest, largest)


def trial_checks(events: DataFrame, experiment: str) -> DataFrame:
    """One row per trial with the count of every rule and the verdict ``is_valid``: one conditional aggregate."""
    rules = trial_rules(experiment)
    counts = events.groupBy(*S.trial_of(events)).agg(*[F.sum(as_count(c)).alias(f"n_{n.lower()}") for n, (c, _, _) in rules.items()])
    verdict = F.lit(True)
    for name, (_, low, high) in rules.items():
        verdict = verdict & rule_holds(F.col(f"n_{name.lower()}"), low, high)
    return counts.withColumn("is_valid", verdict)


def clean_events(events: DataFrame, experiment: str, excluded: list[int] | None = None) -> DataFrame:
    """Rows of valid trials. Every rule looks only at its own trial, so all rules share one aggregate and semi join."""
    kept = keep_rows(events, experiment, excluded)
    by = S.trial_of(kept)
    valid = trial_checks(kept, experiment).where("is_valid").select(*by)
    return kept.join(valid, by, "left_semi")


def removed_trials(before: DataFrame, after: DataFrame) -> DataFrame:
    """Trials that lost all their rows."""
    by = S.trial_of(before)
    return before.select(*by).distinct().join(after.select(*by).distinct(), by, "left_anti")
