"""Queries over the sample table and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.operators import joins, sample_features, views
from saccadia.operators.scan import time_chunk
from saccadia.plans.features import experiment_features
from saccadia.plans.preprocess import preprocess_samples
from workload import ctes, inputs
from workload.event_queries import SQL as EVENT_SQL
from workload.event_queries import rounded_doubles
from workload.sqltools import KEYS, five, query, rounded

SPARK: dict = {}
SQL: dict[str, str] = {}
WIDTH = 10_000  # the samples carry day numbers times ten, about 25,000 in all


def register(name: str, sql: str | None = None):
    def keep(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


POSITIONS = ["x_left", "y_left", "x_right", "y_right"]
PREPARED = ctes.SAMPLES + """,
prep as (select * replace (time - min(time) over (partition by participant_id, trial_id) as time,
 case when x_left is not null then greatest(0.0::double, least(1920.0::double, x_left)) end as x_left,
 case when x_right is not null then greatest(0.0::double, least(1920.0::double, x_right)) end as x_right,
 case when y_left is not null then greatest(0.0::double, least(1080.0::double, y_left)) end as y_left,
 case when y_right is not null then greatest(0.0::double, least(1080.0::double, y_right)) end as y_right),
 'SHAPES' as experiment from samples)"""


def samples(spark, sf) -> DataFrame:
    return preprocess_samples(inputs.gaze_samples(spark, sf))


@register("prep_samples", query(PREPARED, f"select seq, participant_id, trial_id, time, {rounded(*POSITIONS)} from prep"))
def prep_samples(spark, sf):
    return rounded_doubles(samples(spark, sf).select("seq", *S.TRIAL, "time", *POSITIONS))


@register("prep_samples_from_start", query(ctes.SAMPLES, """
select seq, participant_id, trial_id, time - (min(time) over (partition by participant_id, trial_id) - 5) as time
 from samples"""))
def prep_samples_from_start(spark, sf):
    rows = inputs.gaze_samples(spark, sf)
    starts = rows.groupBy(*S.TRIAL).agg((F.min("time") - 5).alias("start_time"))
    return preprocess_samples(rows, starts).select("seq", *S.TRIAL, "time")


ACCELERATION = PREPARED + """,
moved as (select experiment, participant_id, (x_velocity_left - lag(x_velocity_left) over w) * 2000 as xl,
 (y_velocity_left - lag(y_velocity_left) over w) * 2000 as yl,
 (x_velocity_right - lag(x_velocity_right) over w) * 2000 as xr,
 (y_velocity_right - lag(y_velocity_right) over w) * 2000 as yr from prep
 window w as (partition by participant_id, trial_id order by time, seq))"""


@register("acceleration", query(ACCELERATION + """,
eyes as (select *, case when xl is not null and xr is not null then (xl + xr) / 2 else coalesce(xl, xr) end as x,
 case when yl is not null and yr is not null then (yl + yr) / 2 else coalesce(yl, yr) end as y from moved)""", f"""
select {KEYS}, {five('total_acceleration_magnitude', 'sqrt(x * x + y * y)')}, {five('x_acceleration', 'x')},
 {five('y_acceleration', 'y')} from eyes group by all"""))
def acceleration(spark, sf):
    return rounded_doubles(sample_features.acceleration(samples(spark, sf), width=WIDTH))


@register("acceleration_per_eye", query(ACCELERATION, f"""
select {KEYS}, {five('total_acceleration_magnitude_left', 'sqrt(xl * xl + yl * yl)')},
 {five('total_acceleration_magnitude_right', 'sqrt(xr * xr + yr * yr)')} from moved group by all"""))
def acceleration_per_eye(spark, sf):
    return rounded_doubles(sample_features.acceleration(samples(spark, sf), per_eye=True, width=WIDTH))


SMOOTH = PREPARED + """,
smooth as (select *, avg(x_left) over w - avg(x_right) over w as dx, avg(y_left) over w - avg(y_right) over w as dy
 from prep where x_left is not null and x_right is not null and y_left is not null and y_right is not null
 window w as (partition by participant_id order by trial_id, time, seq rows between 4 preceding and current row))"""


@register("moving_average", query(SMOOTH, f"""
select seq, participant_id, trial_id, {rounded('dx', 'dy')} from smooth"""))
def moving_average(spark, sf):
    both = samples(spark, sf).dropna(subset=POSITIONS).withColumns(
        {"dx": F.col("x_left") - F.col("x_right"), "dy": F.col("y_left") - F.col("y_right")})
    smooth = sample_features.moving_average(both.select("seq", *S.TRIAL, "time", "dx", "dy"), ["participant_id"],
                                            "trial_id", ["time", "seq"], ["dx", "dy"],
                                            chunk=F.struct("trial_id", time_chunk("time", WIDTH).alias("t")))
    return rounded_doubles(smooth.select("seq", *S.TRIAL, F.col("dx_avg").alias("dx"), F.col("dy_avg").alias("dy")))


@register("disconjugacy", query(SMOOTH, f"""
select {KEYS}, round(any_value(v), 6) as Var_total from prep left join (
 select participant_id, avg(dx * dx) + avg(dy * dy) as v from smooth group by all) s using (participant_id) group by all"""))
def disconjugacy(spark, sf):
    return rounded_doubles(sample_features.disconjugacy(samples(spark, sf), width=WIDTH))


# Stimuli for the samples: the parts of the trial's lines that were returned stand for shown points.
POINTS = """,
points as (select l_orderkey * 1000003 + l_partkey as seq, l_suppkey as participant_id,
 cast(l_linenumber as bigint) as trial_id,
 cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) * 10 + 3 as time, 'FIXPOINT' as event,
 case when l_partkey % 3 = 0 then '255 0 0' else '255 255 255' end as colour,
 cast(l_partkey % 1920 as double) as stimulus_x, cast(l_partkey % 1080 as double) as stimulus_y
 from lineitem where l_returnflag = 'R')"""


def points(spark, sf) -> DataFrame:
    part = F.col("l_partkey")
    return inputs.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") * 1000003 + part).alias("seq"), F.col("l_suppkey").alias("participant_id"),
        F.col("l_linenumber").cast("bigint").alias("trial_id"),
        (F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 10 + 3).alias("time"),
        F.lit("FIXPOINT").alias("event"),
        F.when(part % 3 == 0, S.RED).otherwise(S.WHITE).alias("colour"),
        (part % 1920).cast("double").alias("stimulus_x"), (part % 1080).cast("double").alias("stimulus_y"))


JOINED = ctes.SAMPLES + POINTS + """,
merged as (select seq, participant_id, trial_id, time, 1 as side, null as hit, null as colour, null as px, null as py,
  x_left, y_left, x_right, y_right from samples
 union all select seq, participant_id, trial_id, time, 0, time, colour, stimulus_x, stimulus_y, null, null, null, null
  from points),
near as (select *, last_value(case when side = 0 then struct_pack(hit := hit, c := colour, x := px, y := py) end
  ignore nulls) over (partition by participant_id, trial_id order by time, side, seq
  rows between unbounded preceding and current row) as b,
 first_value(case when side = 0 then struct_pack(hit := hit, c := colour, x := px, y := py) end ignore nulls) over (
  partition by participant_id, trial_id order by time, side, seq rows between current row and unbounded following) as f
 from merged),
nearest as (select * exclude (b, f, m), case when abs(time - m.hit) <= 50 then m end as m from (
 select *, case when b is not null and (f is null or time - b.hit <= f.hit - time) then b else f end as m
 from near where side = 1) n),
latest as (select *, b as m from near where side = 1)"""


def _shown(source: str) -> str:
    return query(JOINED, f"""
select seq, participant_id, trial_id, time, case m.c when '255 0 0' then 'red' when '255 255 255' then 'white' end
 as fixpoint, m.x as stimulus_x, m.y as stimulus_y from {source}""")


def _with_points(spark, sf, experiment: str) -> DataFrame:
    return joins.with_fixpoints(inputs.gaze_samples(spark, sf, experiment), points(spark, sf), experiment, 50, WIDTH)


@register("samples_with_latest_fixpoint", _shown("latest"))
def samples_with_latest_fixpoint(spark, sf):
    return _with_points(spark, sf, "FIXATIONS").select("seq", *S.TRIAL, "time", "fixpoint", "stimulus_x", "stimulus_y")


@register("samples_with_nearest_fixpoint", _shown("nearest"))
def samples_with_nearest_fixpoint(spark, sf):
    return _with_points(spark, sf, "SHAPES").select("seq", *S.TRIAL, "time", "fixpoint", "stimulus_x", "stimulus_y")


DISTANCES = JOINED + """,
far as (select 'SHAPES' as experiment, participant_id, (x_left - m.x) ** 2 as lx, (y_left - m.y) ** 2 as ly,
 (x_right - m.x) ** 2 as rx, (y_right - m.y) ** 2 as ry from nearest)"""


def _eyes(left: str, right: str) -> str:
    return (f"case when {left} is not null and {right} is not null then ({left} + {right}) / 2 "
            f"else coalesce({left}, {right}) end")


@register("distance_to_stimulus", query(DISTANCES, f"""
select {KEYS}, {five('distance_to_fixpoint', _eyes('sqrt(lx + ly)', 'sqrt(rx + ry)'))},
 {five('distance_to_fixpoint_x', _eyes('lx', 'rx'))}, {five('distance_to_fixpoint_y', _eyes('ly', 'ry'))}
 from far group by all"""))
def distance_to_stimulus(spark, sf):
    return rounded_doubles(sample_features.stimulus_distance(_with_points(spark, sf, "SHAPES")))


@register("distance_to_stimulus_squared", query(DISTANCES, f"""
select {KEYS}, {five('distance_to_fixpoint', _eyes('(lx + ly)', '(rx + ry)'))} from far group by all"""))
def distance_to_stimulus_squared(spark, sf):
    return rounded_doubles(sample_features.stimulus_distance(_with_points(spark, sf, "SHAPES"), squared_only=True))


@register("playback", query(JOINED, """
select seq, participant_id, trial_id, time, case m.c when '255 0 0' then 'red' when '255 255 255' then 'white' end
 as fixpoint, m.x as stimulus_x, m.y as stimulus_y from (select *, row_number() over (
 partition by participant_id, trial_id order by time, seq) - 1 as i from latest) p where i % 100 = 0"""))
def playback(spark, sf):
    rows = inputs.gaze_samples(spark, sf, "FIXATIONS")
    return views.playback(rows, points(spark, sf), 100, WIDTH).select(
        "seq", *S.TRIAL, "time", "fixpoint", "stimulus_x", "stimulus_y")


INTERVALS = ctes.SAMPLES + """,
spans as (select participant_id, trial_id, min(time) as start_time, min(time) + 4000 as end_time from samples group by all)"""


@register("assign_trials_overlap", query(INTERVALS, """
select s.seq, s.participant_id, max(i.trial_id) as trial_id from samples s join spans i
 on s.participant_id = i.participant_id and s.time between i.start_time and i.end_time
 group by s.seq, s.participant_id, s.time, s.trial_id"""))
def assign_trials_overlap(spark, sf):
    rows = inputs.gaze_samples(spark, sf)
    spans = rows.groupBy(*S.TRIAL).agg(F.min("time").alias("start_time"), (F.min("time") + 4000).alias("end_time"))
    return joins.assign_trials(rows.select("seq", "participant_id", "time"), spans, width=2000).drop("time")


PARTS = ["precalc_metrics", "fix_distance", "acceleration", "disconjugacy"]


@register("shapes_feature_table", "select * from " + " join ".join(
    f"({(EVENT_SQL | SQL)[name]}) {name}" + (f" using ({KEYS})" if i else "") for i, name in enumerate(PARTS)))
def shapes_feature_table(spark, sf):
    names = ["precalculated", "fixation_distance", "acceleration", "disconjugacy"]
    return rounded_doubles(experiment_features("SHAPES", inputs.prepared_events(spark, sf, "SHAPES"), samples(spark, sf), names,
                                               width=inputs.CHUNK), settle=True)
