"""Event and sample preparation per experiment.

Each pipeline collects what it needs from the ordered trial - fills, clock origin, stimulus state, validity counts and
saccade segments - into one scan, whose rows are shuffled once; the change of the onset takes a second one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import cast_columns
from saccadia.operators import clean, fills
from saccadia.operators.blinks import drop_blink_saccades, drop_blinked_spans, saccade_segments
from saccadia.operators.scan import DEFAULT_CHUNK, following, last, scan, total


@dataclass(frozen=True)
class Recipe:
    """What differs between experiments."""
    forward: tuple[str, ...] = ()       # fill from earlier rows
    both: tuple[str, ...] = ()          # fill from later rows, then from earlier ones
    stimulus_from_position: bool = False
    elapsed_from_delay: bool = False
    move_onset: bool = False
    fill_side: bool = False
    has_stimulus: bool = True


RECIPES = {
    "ANTI_SACCADE": Recipe(forward=("colour", "stimulus_x", "stimulus_y"), elapsed_from_delay=True, move_onset=True,
                           fill_side=True),
    "EVIL_BASTARD": Recipe(forward=("colour", "stimulus_x", "stimulus_y")),
    "REACTION": Recipe(forward=("colour", "stimulus_x", "stimulus_y"), stimulus_from_position=True),
    "FITTS_LAW": Recipe(forward=("distance", "target_width")),
    "KING_DEVICK": Recipe(both=("marks", "time_elapsed"), has_stimulus=False),
    "SHAPES": Recipe(both=("shape",)),
    "SMOOTH_PURSUITS": Recipe(both=("shape", "speed")),
    "FIXATIONS": Recipe(forward=("target_shape", "stimulus_x", "stimulus_y"), stimulus_from_position=True),
}


def preprocess_events(events: DataFrame, experiment: str, tie: str = "seq", width: int = DEFAULT_CHUNK,
                      validate: bool = False, fill_scope: str = "trial", blink_mode: str = "scan") -> DataFrame:
    """Preprocessed events of one experiment; an unknown name gets the common steps only.

    With ``validate`` raw events are accepted: invalid trials are found in the same scan that prepares the valid ones.
    """
    recipe = RECIPES.get(experiment, Recipe(has_stimulus=False))
    rules = clean.trial_rules(experiment) if validate else {}
    df = clean.keep_rows(events, experiment) if validate else events
    df = df.withColumns({f"_r_{n}": clean.as_count(c) for n, (c, _, _) in rules.items()})
    df = fills.coalesce_time(df)
    df = df.select(*cast_columns(df.columns, S.EVENT_TYPES))
    if recipe.elapsed_from_delay:
        df = fills.coalesce_columns(df, "time_elapsed", "time_elapsed", "delay", ["delay"])
    if recipe.stimulus_from_position:
        df = fills.coalesce_columns(df, "stimulus_x", "pos_x", "stimulus_x", ["pos_x"])
        df = fills.coalesce_columns(df, "stimulus_y", "pos_y", "stimulus_y", ["pos_y"])
    if recipe.fill_side or recipe.move_onset:
        df = _settle_onset(df, recipe, tie, width)
    if fill_scope == "global" and recipe.both:
        df = fills.fill(df, list(recipe.both), "backward_forward", tie=tie, width=width, scope="global")

    items = {}
    for c in recipe.forward:
        items[f"_f_{c}"] = last(F.col(c))
    for c in recipe.both:
        items[f"_b_{c}"] = following(F.col(c))
        items[f"_f_{c}"] = last(F.col(c))
    if recipe.has_stimulus:
        items |= fills.active_item(experiment, tie=tie)
    items["_t0"] = total(F.min, F.when(F.col("event") != "TRIALID", F.col("time")))
    items |= {f"_n_{n}": total(F.sum, F.col(f"_r_{n}")) for n in rules}

    df = scan(df, S.trial_of(df), "time", [tie], items, width=width,
              segments=saccade_segments("time", tie) if blink_mode == "scan" else None)
    for n, (_, low, high) in rules.items():
        df = df.where(clean.rule_holds(F.col(f"_n_{n}"), low, high))
    if recipe.has_stimulus:
        df = df.withColumn("stimulus_active", fills.is_active(tie=tie))
    df = df.where(F.col("event") != "TRIALID")
    if blink_mode == "scan":
        df = drop_blinked_spans(df, "time", tie)
        df = df.where(~F.col("event").isin("SBLINK", "EBLINK", "SFIX", "SSACC"))
    filled = {c: F.col(f"_f_{c}") for c in recipe.forward}
    filled |= {c: F.coalesce(F.col(f"_b_{c}"), F.col(f"_f_{c}")) for c in recipe.both}
    df = df.withColumns({**filled, **fills.relative_times(F.col("_t0"), ["time", "start_time", "end_time"])})
    df = fills.limit_to_screen(df.drop(*[c for c in df.columns if c.startswith("_")]))
    if blink_mode != "scan":
        df = drop_blink_saccades(df, "time", tie, mode=blink_mode, width=width)
    return df


def _settle_onset(df: DataFrame, recipe: Recipe, tie: str, width: int) -> DataFrame:
    items = {}
    if recipe.fill_side:
        items |= {"_f_side": last(F.col("side")), "_b_side": following(F.col("side"))}
    if recipe.move_onset:
        items |= fills.onset_items(F.col("time"), F.col("time_elapsed"))
    df = scan(df, S.trial_of(df), "time", [tie], items, width=width)
    if recipe.fill_side:
        df = df.withColumn("side", F.coalesce("_f_side", "_b_side"))
    if recipe.move_onset:
        df = df.withColumn("time", fills.onset_time())
    return df.drop(*items)


def preprocess_samples(samples: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """Samples on the trial clock, limited to the screen.

    ``origin`` (participant_id, trial_id, start_time) sets the clock to the START event instead of the first sample.
    """
    if origin is None:
        timed = fills.trial_clock(samples, ["time"])
    else:
        starts = origin.select(*S.TRIAL, F.col("start_time").alias("_t0"))
        timed = samples.join(starts, S.TRIAL, "left").withColumn("time", F.col("time") - F.col("_t0")).drop("_t0")
    return fills.limit_to_screen(timed, ["x_left", "x_right"], ["y_left", "y_right"])
