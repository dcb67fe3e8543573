"""Feature tables of all experiments, events and samples together, and their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.plans.features import experiment_features
from workload import ctes, event_queries, inputs, sample_queries
from workload.event_queries import PER_TRIAL, UPTO, rounded_doubles
from workload.sqltools import KEYS, five, query

SPARK: dict = {}
SQL: dict[str, str] = {}

#: Rates per second are tiny on the clock of these tables, so they are shown per day.
PER_DAY = " * 86400"
TOLERANCE = inputs.DAY
#: Large sums of squares stand beside small rates here; three digits are the same in any order of summation.
DIGITS = 3


def _rate(experiment: str, event: str, name: str) -> str:
    return query(event_queries._rate_ctes(experiment, event) + "," + PER_TRIAL, f"select {KEYS}, {five(name, 'rate', '', PER_DAY)} from rates group by all")


def _distance(experiment: str) -> str:
    return event_queries.distance_sql(" and stimulus_active", experiment)


def _of_samples(name: str, experiment: str) -> str:
    return sample_queries.SQL[name].replace("'SHAPES' as experiment", f"'{experiment}' as experiment")


def _stimulus_distance(experiment: str) -> str:
    """Samples against the FIXPOINT events of their trial: the latest one for FIXATIONS, else the nearest within the tolerance."""
    match = "b" if experiment == "FIXATIONS" else f"""case when abs(time - (case when b is not null and (f is null or time - b.hit <= f.hit - time)
  then b else f end).hit) <= {TOLERANCE} then (case when b is not null and (f is null or time - b.hit <= f.hit - time) then b else f end) end"""
    lx, ly, rx, ry = (f"({a}_{e} - m.{a}) ** 2" for e in ("left", "right") for a in "xy")
    eyes = sample_queries._eyes
    return query(ctes.prepared(experiment) + "," + sample_queries.PREPARED.replace("\nprep as (", "\ngaze_prep as (", 1).replace("'SHAPES'", f"'{experiment}'") + """,
merged as (select experiment, participant_id, trial_id, seq, time, 1 as side, null as hit, null as px, null as py, x_left, y_left, x_right, y_right
  from gaze_prep
 union all select experiment, participant_id, trial_id, seq, time, 0, time, stimulus_x, stimulus_y, null, null, null, null from prep
  where event = 'FIXPOINT'),
near as (select *, last_value(case when side = 0 then struct_pack(hit := hit, x := px, y := py) end ignore nulls) over (
  partition by participant_id, trial_id order by time, side, seq rows between unbounded preceding and current row) as b,
 first_value(case when side = 0 then struct_pack(hit := hit, x := px, y := py) end ignore nulls) over (
  partition by participant_id, trial_id order by time, side, seq rows between current row and unbounded following) as f from merged),
""" + f"""met as (select *, {match} as m from near where side = 1),
far as (select *, {lx} as lx, {ly} as ly, {rx} as rx, {ry} as ry from met)""", f"""
select {KEYS}, {five('distance_to_fixpoint', eyes('sqrt(lx + ly)', 'sqrt(rx + ry)'))}, {five('distance_to_fixpoint_x', eyes('lx', 'rx'))},
 {five('distance_to_fixpoint_y', eyes('ly', 'ry'))} from far group by all""")


def _precalculated(experiment: str) -> str:
    return event_queries.precalculated_sql(experiment)


def _verdicts(experiment: str) -> list[str]:
    prefix = "antisacc" if experiment == "ANTI_SACCADE" else "reaction"
    return [event_queries.SQL[f"{prefix}_{name}"] for name in ("n_correct", "prop_correct", "reaction_time")]


def parts(experiment: str) -> Sequence[str]:
    """One query per feature of the experiment."""
    fixations = _rate(experiment, "EFIX", "fixations_per_second") if experiment != "KING_DEVICK" else ""
    saccades = _rate(experiment, "ESACC", "saccades_per_second") if experiment != "KING_DEVICK" else ""
    moving = [_precalculated(experiment), _distance(experiment) if experiment in ("EVIL_BASTARD", "SHAPES", "SMOOTH_PURSUITS") else "", fixations, saccades]
    of_events = {"ANTI_SACCADE": lambda: [_precalculated(experiment), *_verdicts(experiment), saccades],
                 "REACTION": lambda: [_precalculated(experiment), *_verdicts(experiment), saccades],
                 "FITTS_LAW": lambda: [_precalculated(experiment), event_queries.SQL["fitts_overshoot"], fixations, saccades],
                 "KING_DEVICK": lambda: [_precalculated(experiment), *[event_queries.SQL[n] for n in ("kd_mistakes_elapsed", "kd_wrong_dir", "kd_sacc_per_s")]]}
    found = of_events.get(experiment, lambda: moving)() + [_of_samples(n, experiment) for n in ("acceleration", "disconjugacy")]
    if experiment in ("EVIL_BASTARD", "SHAPES", "SMOOTH_PURSUITS", "FIXATIONS"):
        found.append(_stimulus_distance(experiment))
    return [sql for sql in found if sql]


def columns(sql: str) -> list[str]:
    """Names that the last select of a query gives, without the keys."""
    return [c for c in re.findall(r"\bas (\w+)", sql[sql.rindex("\nselect"):].split(" from ")[0]) if c not in ("bigint", "double", "int")]


def shown(column: str) -> str:
    return column if column == "n_correct_trials" else f"round({column}, {DIGITS}) + 0.0::double as {column}"


def per_day(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) * 86400 for c in df.columns if c.startswith(("fixations_per_second", "saccades_per_second"))})


def _register(experiment: str) -> None:
    name = f"{experiment.lower()}_features"

    def run(spark, sf) -> DataFrame:
        """All features side by side, of the participants both tables have."""
        samples = sample_queries.samples(spark, sf).withColumn("experiment", F.lit(experiment))
        found = experiment_features(experiment, inputs.prepared_events(spark, sf, experiment), samples, width=inputs.CHUNK, tolerance=TOLERANCE)
        return rounded_doubles(rounded_doubles(per_day(found), settle=True), digits=DIGITS, settle=True)

    SPARK[name] = run
    SQL[name] = f"select {KEYS}, {', '.join(shown(c) for sql in parts(experiment) for c in columns(sql))} from " + " join ".join(
        f"({sql}) t{i}" + (f" using ({KEYS})" if i else "") for i, sql in enumerate(parts(experiment)))


for _e in S.EXPERIMENTS:
    _register(_e)
