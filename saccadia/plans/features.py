"""Which features belong to which experiment, and their evaluation together.

A feature names the rows that count, the numbers that such a row has, and what is computed of them per participant. Features
that look at the same rows share a frame: all event features of an experiment come from one ordered scan of its events, row by
row or summed up per trial first, all features of the samples from one scan and one smoothing. The frames are put together as
one table of numbers, written once, and a single aggregate describes all of them, medians included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import centre_area, distance, mean_of_eyes, saccade_direction_1d, saccade_direction_2d, saccade_end_area
from saccadia.operators import sample_features as P
from saccadia.operators.describe import FIVE, exact_medians
from saccadia.operators.event_features import PARTICIPANT, TRIAL, nearest_target_distance
from saccadia.operators.scan import DEFAULT_CHUNK, following, last, last_before, order_key, scan, total
from saccadia.session import stage

_SIMPLE = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


@dataclass(frozen=True)
class Feature:
    """``values``: numbers of a row where ``present`` holds. ``outputs``: result column -> aggregate of them, by name;
    ``medians``: result column -> name."""
    present: Column
    values: dict[str, Column]
    outputs: dict[str, Callable[[dict[str, Column]], Column]]
    medians: dict[str, str] = field(default_factory=dict)


def five(present: Column, metrics: dict[str | tuple[str, str], Column]) -> Feature:
    """``<metric>_<stat>``, or ``<metric>_<stat>_<suffix>`` for a (metric, suffix) key, of the five statistics."""
    values, outputs, medians = {}, {}, {}
    for key, column in metrics.items():
        name, suffix = key if isinstance(key, tuple) else (key, "")
        label, tail = f"{name}|{suffix}", f"_{suffix}" if suffix else ""
        values[label] = column
        for stat in FIVE:
            if stat == "median":
                medians[f"{name}_median{tail}"] = label
            else:
                outputs[f"{name}_{stat}{tail}"] = lambda v, label=label, fn=_SIMPLE[stat]: fn(v[label])
    return Feature(present, values, outputs, medians)


def measure(frames: Sequence[tuple[DataFrame, dict[str, Feature]]], how: str = "inner", first: str | None = None) -> DataFrame:
    """One row per participant with the outputs of all features of all frames.

    ``inner`` keeps participants that every feature has rows of, ``left`` those of the feature ``first``, ``full`` all.
    """
    features = {n: f for _, own in frames for n, f in own.items()}
    spot = {(n, v): f"v{i}" for i, (n, v) in enumerate((n, v) for n, f in features.items() for v in f.values)}
    here = {n: f"p{i}" for i, n in enumerate(features)}
    tables = []
    for rows, own in frames:
        present = {n: F.coalesce(f.present, F.lit(False)) for n, f in own.items()}
        numbers = [F.when(present[n], c.cast("double")).alias(spot[n, v]) for n, f in own.items() for v, c in f.values.items()]
        marks = [F.when(p, 1).alias(here[n]) for n, p in present.items()]
        tables.append(rows.where(reduce(Column.__or__, present.values())).select(*PARTICIPANT, *marks, *numbers))
    table = stage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), "measures")
    columns = {**{c: F.col(c) for c in here.values()}, **{c: F.col(c) for c in spot.values()}}
    at = {c: F.col(f"_m{i}") for i, c in enumerate(columns)}
    extra = [F.max(at[c]).alias(c) for c in here.values()]
    for n, f in features.items():
        extra += [fn({v: at[spot[n, v]] for v in f.values}).alias(out) for out, fn in f.outputs.items()]
    medians = {spot[n, v]: out for n, f in features.items() for out, v in f.medians.items()}
    done = exact_medians(table, PARTICIPANT, columns, medians, extra)
    needed = list(here.values()) if how == "inner" else [here[first or next(iter(here))]] if how == "left" else []
    if how not in ("inner", "left", "full"):
        raise ValueError(f"unknown join {how!r}")
    for c in needed:
        done = done.where(F.col(c).isNotNull())
    return done.drop(*here.values())


# --- events ----------------------------------------------------------------------------------------------------------

def _event(name: str) -> Column:
    return F.col("event") == name


MOVING, RATED = ("EVIL_BASTARD", "SHAPES", "SMOOTH_PURSUITS"), ("EVIL_BASTARD", "SHAPES", "SMOOTH_PURSUITS", "FIXATIONS", "FITTS_LAW")
JUDGED = ("ANTI_SACCADE", "REACTION")
COMBINED_EXPERIMENTS = (*MOVING, "FIXATIONS")


def scanned_events(events: DataFrame, experiment: str, width: int = DEFAULT_CHUNK) -> DataFrame:
    """Events with what the features of the experiment need from the rows before and behind them, in one scan."""
    active = F.coalesce(F.col("stimulus_active"), F.lit(False)) if "stimulus_active" in events.columns else F.lit(False)
    rows = events.withColumn("_active", active)
    on, shown = F.col("_active"), F.col("_active") & _event("FIXPOINT")
    items = {"_shown": last(F.when(shown, F.col("time"))), "_fin": total(F.max, F.when(on, F.col("time")))}
    if experiment in MOVING:
        for eye in ("L", "R"):
            items[f"_before_{eye}"] = last_before(F.when(on & _event("EFIX") & (F.col("eye") == eye), F.struct("x", "y")))
    if experiment == "REACTION":
        items["_towards"] = last(F.when(shown, centre_area(F.col("stimulus_x"), F.col("stimulus_y"))))
    return scan(rows, TRIAL, "time", ["seq"], items, width=width)


def precalculated(rows: DataFrame) -> Feature:
    sacc, fix = _event("ESACC"), _event("EFIX")
    return five(sacc | fix, {
        ("peak_velocity", "sacc"): F.when(sacc, F.col("peak_velocity")), ("amplitude", "sacc"): F.when(sacc, F.col("amplitude")),
        ("duration", "sacc"): F.when(sacc, F.col("duration")), ("duration", "fix"): F.when(fix, F.col("duration")),
        ("avg_pupil_size", "fix"): F.when(fix, F.col("avg_pupil_size"))})


def fixation_moves() -> Feature:
    """Distance to the fixation before of the same trial and eye."""
    before = F.when(F.col("eye") == "L", F.col("_before_L")).when(F.col("eye") == "R", F.col("_before_R"))
    dx, dy = F.col("x") - before["x"], F.col("y") - before["y"]
    return five(F.col("_active") & _event("EFIX"), {"fixation_distance": distance(dx, dy), "x_fixation_dist": dx, "y_fixation_dist": dy})


def rates(rows: DataFrame) -> tuple[DataFrame, dict[str, Feature]]:
    """Per trial the events per second: each counts against the time from its latest stimulus, the eyes are averaged."""
    seconds = (F.col("_fin") - F.col("_shown")) / 1000
    found = {"fix": "EFIX", "sacc": "ESACC"}
    counted = rows.where(F.col("_active") & F.col("event").isin(*found.values()) & F.col("eye").isNotNull()).groupBy(
        *TRIAL, "eye", seconds.alias("_s")).agg(*[F.count_if(_event(e)).alias(n) for n, e in found.items()]).where("_s is not null")
    eyes = counted.groupBy(*TRIAL, "eye").agg(*[c for n in found for c in (
        F.sum(F.when(F.col(n) > 0, F.try_divide(F.col(n), F.col("_s")))).alias(f"{n}_rate"), F.max(F.when(F.col(n) > 0, 1)).alias(f"{n}_eye"))])
    trials = eyes.groupBy(*TRIAL).agg(*[c for n in found for c in (
        F.try_divide(F.sum(f"{n}_rate"), F.count(f"{n}_eye")).alias(f"{n}_rate"), F.count(f"{n}_eye").alias(f"{n}_eyes"))])
    return trials, {name: five(F.col(f"{n}_eyes") > 0, {name: F.col(f"{n}_rate")})
                    for n, name in (("fix", "fixations_per_second"), ("sacc", "saccades_per_second"))}


def verdicts(rows: DataFrame, experiment: str) -> tuple[DataFrame, dict[str, Feature]]:
    """Per trial the first verdict and the delay of the first correct saccade."""
    sacc = _event("ESACC")
    if experiment == "ANTI_SACCADE":
        direction, area = F.when(sacc, saccade_direction_1d()), F.when(sacc, saccade_end_area(F.col("end_x")))
        correct = F.when((direction != "no_direction") & (area != "middle") & (direction == area), direction != F.col("side"))
    else:
        direction = F.when(sacc, saccade_direction_2d())
        correct = F.when(direction.isNotNull(), (direction != "no_direction") & direction.eqNullSafe(F.col("_towards")))
    key, judged = order_key("time", ["seq"]), rows.where("_active").withColumn("_correct", correct)
    delay = F.struct((F.col("start_time") - F.col("_shown")).alias("v"))
    trials = judged.groupBy(*TRIAL).agg(F.min_by("_correct", F.when(F.col("_correct").isNotNull(), key)).alias("ok"),
                                        F.min_by(delay, F.when(F.col("_correct"), key)).alias("rt"))
    n = lambda v: F.coalesce(F.sum(v["ok"]).cast("bigint"), F.lit(0).cast("bigint"))
    every = F.lit(True)
    return trials, {
        "n_correct_trials": Feature(every, {"ok": F.col("ok")}, {"n_correct_trials": n}),
        "prop_correct_trials": Feature(every, {"ok": F.col("ok")}, {"prop_correct_trials": lambda v: F.try_divide(n(v), F.count(v["ok"]))}),
        "reaction_time": Feature(F.col("rt").isNotNull(), {"rt": F.col("rt.v")}, {
            "reaction_time_avg": lambda v: F.avg(v["rt"]), "reaction_time_std": lambda v: F.stddev_samp(v["rt"])})}


def overshoots(rows: DataFrame, width: int) -> tuple[DataFrame, dict[str, Feature]]:
    """Per trial the distance of the fixations to the closer target, averaged over fixations, then eyes."""
    fixed = nearest_target_distance(rows.where("_active"), width).where(_event("EFIX") & F.col("eye").isNotNull())
    eyes = fixed.groupBy(*TRIAL, "eye").agg(F.coalesce(F.avg("distance_to_nearest_stimulus"), F.lit(0.0)).alias("_d"))
    trials = eyes.groupBy(*TRIAL).agg((F.sum("_d") / F.count("*")).alias("fixation_overshoot"))
    return trials, {"fixation_overshoot": five(F.lit(True), {"fixation_overshoot": F.col("fixation_overshoot")})}


def timed_reading(events: DataFrame) -> tuple[DataFrame, dict[str, Feature]]:
    """Per trial the share of leftward saccades and the saccades per second, before the elapsed time; eyes are averaged."""
    timed = _event("ESACC") & (F.col("time") / 1000 < F.col("time_elapsed")) & F.col("eye").isNotNull()
    left = F.when(timed & (F.col("end_x") < F.col("start_x")), 1).when(timed & (F.col("end_x") > F.col("start_x")), 0)
    first = F.struct(order_key("time", ["seq"]).alias("k"), F.col("time_elapsed").alias("v"))
    eyes = events.groupBy(*TRIAL, "eye").agg(F.sum(left).alias("_left"), F.count(left).alias("_sides"), F.count_if(timed).alias("_n"),
                                             F.min(F.when(F.col("time_elapsed").isNotNull(), first)).alias("_first"))
    trials = eyes.groupBy(*TRIAL).agg(
        F.sum(F.when(F.col("_left") > 0, 100 * F.col("_left") / F.col("_sides"))).alias("_pct"), F.count_if(F.col("_left") > 0).alias("_lefts"),
        F.sum("_n").alias("_n"), F.count_if(F.col("_n") > 0).alias("_eyes"), F.min("_first")["v"].alias("_spent"))
    pct, rate = "wrong_direction_saccade_pct", "saccades_per_second"
    return trials, {
        "wrong_direction": five(F.col("_lefts") > 0, {pct: F.try_divide(F.col("_pct"), F.col("_lefts"))}),
        "saccades_per_second": five(F.col("_eyes") > 0, {rate: F.try_divide(F.try_divide(F.col("_n"), F.col("_spent")), F.col("_eyes"))})}


def event_frames(experiment: str, events: DataFrame, width: int = DEFAULT_CHUNK) -> list[tuple[DataFrame, dict[str, Feature]]]:
    """The event features of an experiment by name, with the rows they are taken from."""
    if experiment == "KING_DEVICK":
        data = _event("TRIAL_VAR_DATA")
        mean = lambda out, column: Feature(data, {column: F.col(column)}, {out: lambda v: F.avg(v[column])})
        return [(events, {"precalculated": precalculated(events), "mistakes": mean("avg_mistakes_pr_trial", "marks"),
                          "elapsed": mean("avg_time_elapsed_pr_trial", "time_elapsed")}), timed_reading(events)]
    rows = scanned_events(events, experiment, width)
    frames = [(rows, {"precalculated": precalculated(rows)} | ({"fixation_distance": fixation_moves()} if experiment in MOVING else {}))]
    trials, rated = rates(rows)
    if experiment in JUDGED:
        frames += [verdicts(rows, experiment), (trials, {"saccades_per_second": rated["saccades_per_second"]})]
    if experiment == "FITTS_LAW":
        frames.append(overshoots(rows, width))
    if experiment in RATED:
        frames.append((trials, rated))
    return frames


# --- samples ---------------------------------------------------------------------------------------------------------

def sample_frames(experiment: str, samples: DataFrame, events: DataFrame | None = None, width: int = DEFAULT_CHUNK,
                  tolerance: float = 10) -> list[tuple[DataFrame, dict[str, Feature]]]:
    """The sample features of an experiment; with ``events`` also the distance to the shown fixpoint.

    The fixpoints stand between the samples in one scan, which also hands on the velocities of the sample before.
    """
    features: dict[str, Feature] = {}
    by, ties, items = TRIAL, ["seq"], {"_v": last_before(F.struct(*P.VELOCITIES))}
    rows, is_sample = samples, F.lit(True)
    if events is not None and experiment in COMBINED_EXPERIMENTS:
        point = F.struct(F.col("time").alias("at"), "stimulus_x", "stimulus_y")
        points = events.where(_event("FIXPOINT") & F.col("time").isNotNull()).select(*TRIAL, "time", "seq", F.lit(0).alias("_side"), point.alias("_point"))
        rows = samples.withColumn("_side", F.lit(1)).unionByName(points, allowMissingColumns=True)
        is_sample = F.col("_side") == 1
        ties, items = ["_side", "seq"], {"_v": last_before(F.when(is_sample, F.struct(*P.VELOCITIES))), "_back": last(F.col("_point"))}
        if experiment != "FIXATIONS":
            items["_ahead"] = following(F.col("_point"))
    rows = scan(rows, by, "time", ties, items, width=width).where(is_sample)
    change = {v: (F.col(v) - F.col(f"_v.{v}")) * S.SAMPLE_RATE for v in P.VELOCITIES}
    ax = mean_of_eyes(change["x_velocity_left"], change["x_velocity_right"])
    ay = mean_of_eyes(change["y_velocity_left"], change["y_velocity_right"])
    features["acceleration"] = five(F.lit(True), {"total_acceleration_magnitude": distance(ax, ay), "x_acceleration": ax, "y_acceleration": ay})
    if "_back" in items:
        match, gap = F.col("_back"), F.col("time") - F.col("_back.at")
        if experiment != "FIXATIONS":
            ahead = F.col("_ahead.at") - F.col("time")
            match = F.when(match.isNotNull() & (F.col("_ahead").isNull() | (gap <= ahead)), match).otherwise(F.col("_ahead"))
            match = F.when(F.abs(F.col("time") - match["at"]) <= tolerance, match)
        match = F.when(F.col("time").isNotNull(), match)
        off = {(e, a): (F.col(f"{a}_{e}") - match[f"stimulus_{a}"]) for e in ("left", "right") for a in "xy"}
        square = {k: v * v for k, v in off.items()}
        far = [F.sqrt(square[e, "x"] + square[e, "y"]) for e in ("left", "right")]
        features["stimulus_distance"] = five(F.lit(True), {
            "distance_to_fixpoint": mean_of_eyes(*far), "distance_to_fixpoint_x": mean_of_eyes(square["left", "x"], square["right", "x"]),
            "distance_to_fixpoint_y": mean_of_eyes(square["left", "y"], square["right", "y"])})
    smooth = P.smoothed_differences(samples, width=width)
    # every participant of the samples has the feature, with NULL where no sample has both eyes
    bare = samples.select(*PARTICIPANT).distinct().select("*", *[F.lit(None).cast("double").alias(c) for c in ("dx_avg", "dy_avg")])
    pairs = smooth.select(*PARTICIPANT, "dx_avg", "dy_avg").unionByName(bare)
    spread = {"x": F.col("dx_avg") * F.col("dx_avg"), "y": F.col("dy_avg") * F.col("dy_avg")}
    return [(rows, features), (pairs, {"disconjugacy": Feature(F.lit(True), spread, {"Var_total": lambda v: F.avg(v["x"]) + F.avg(v["y"])})})]


def experiment_features(experiment: str, events: DataFrame | None, samples: DataFrame | None = None,
                        names: Sequence[str] | None = None, how: str = "inner", width: int = DEFAULT_CHUNK,
                        tolerance: float = 10) -> DataFrame:
    """Features of all participants of one experiment, evaluated together.

    Event features need ``events``, sample features ``samples``, the distance to the stimulus both. ``names`` picks a
    subset. ``how`` says which participants stay, see ``measure``.
    """
    frames = event_frames(experiment, events, width) if events is not None else []
    if samples is not None:
        frames += sample_frames(experiment, samples, events, width, tolerance)
    known = [n for _, own in frames for n in own]
    if names is not None:
        if missing := set(names) - set(known):
            raise KeyError(f"no such features of {experiment}: {sorted(missing)}")
        frames = [(rows, kept) for rows, own in frames if (kept := {n: f for n, f in own.items() if n in names})]
    return measure(frames, how, names[0] if names else None)


# Feature lists of the older single-experiment reports.
REPORT_FEATURES = {
    "ANTI_SACCADE": ["precalculated", "n_correct_trials", "prop_correct_trials", "reaction_time", "acceleration",
                     "disconjugacy"],
    "REACTION": ["precalculated", "n_correct_trials", "prop_correct_trials", "reaction_time", "acceleration",
                 "disconjugacy"],
    "FITTS_LAW": ["precalculated", "fixations_per_second", "fixation_overshoot", "acceleration", "disconjugacy"],
    "KING_DEVICK": ["precalculated", "mistakes", "elapsed", "acceleration", "disconjugacy"],
    "EVIL_BASTARD": ["precalculated", "fixation_distance", "acceleration", "disconjugacy", "stimulus_distance"],
}


def report_features(experiment: str, events: DataFrame, samples: DataFrame, **options) -> DataFrame:
    return experiment_features(experiment, events, samples, REPORT_FEATURES[experiment], **options)
