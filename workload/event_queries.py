"""Queries over the event table and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions import scalars as C
from saccadia.operators import blinks, clean, event_features, fills, joins, views
from saccadia.operators.scan import first_of_all, last, previous, scan, sum_before, total
from saccadia.plans.preprocess import preprocess_events
from saccadia.sources.logs import parse_events
from workload import ctes, inputs
from workload.inputs import CHUNK, DAY
from workload.sqltools import KEYS, five, query

SPARK: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def rounded_doubles(df: DataFrame, factor: float | None = None, digits: int = 6, settle: bool = False) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns a negative zero into zero.

    ``settle`` rounds off first what the order of a sum adds, for means that lie at a half.
    """
    kinds = dict(df.dtypes)

    def shown(c: str):
        value = F.col(c) * factor if factor else F.col(c)
        return (F.round(F.round(value, digits + 5) if settle else value, digits) + F.lit(0.0)).alias(c)

    return df.select(*[shown(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def raw(spark: SparkSession, sf: str, experiment: str = "SHAPES") -> DataFrame:
    return inputs.gaze_events(spark, sf, experiment)


def timed(spark: SparkSession, sf: str, experiment: str = "SHAPES") -> DataFrame:
    return fills.coalesce_time(raw(spark, sf, experiment))


def prep(spark: SparkSession, sf: str, experiment: str) -> DataFrame:
    return preprocess_events(raw(spark, sf, experiment), experiment, width=CHUNK, validate=True)


def ready(spark: SparkSession, sf: str, experiment: str) -> DataFrame:
    return inputs.prepared_events(spark, sf, experiment)


TIMED = ctes.GAZE + """,
timed as (select * replace (coalesce(time, cast(start_time as bigint)) as time) from gaze)"""
UPTO = f"({ctes.TRIAL_ORDER} rows between unbounded preceding and current row)"
ONWARDS = f"({ctes.TRIAL_ORDER} rows between current row and unbounded following)"
ID = "participant_id, trial_id, seq"
ROW = ["participant_id", "trial_id", "seq"]

# --- validity --------------------------------------------------------------------------------------------------------

CHECKS = """
 cast(count(*) filter (where event = 'TRIALID') as bigint) as n_trialid,
 cast(count(*) filter (where event = 'TRIAL_VAR_DATA') as bigint) as n_trial_var_data,
 cast(count(*) filter (where event = 'START') as bigint) as n_start,
 cast(count(*) filter (where event = 'END') as bigint) as n_end,
 cast(count(*) filter (where event = 'FIXPOINT') as bigint) as n_fixpoint,
 cast(count(*) filter (where event = 'FIXPOINT' and colour = '255 0 0') as bigint) as n_red,
 cast(count(*) filter (where event = 'FIXPOINT' and colour = '255 255 255') as bigint) as n_white"""


@register("trial_checks", query(ctes.cleaned("REACTION"), f"""
select participant_id, trial_id,{CHECKS}, ({ctes.rules('REACTION')}) as is_valid from kept group by all"""))
def trial_checks(spark, sf):
    return clean.trial_checks(clean.keep_rows(raw(spark, sf, "REACTION"), "REACTION"), "REACTION").drop("experiment")


def _register_clean(experiment: str):
    @register(f"clean_{experiment.lower()}", query(ctes.cleaned(experiment), "select * from clean"))
    def run(spark, sf):
        return clean.clean_events(raw(spark, sf, experiment), experiment)


for _e in S.EXPERIMENTS:
    _register_clean(_e)


@register("removed_trials", query(ctes.cleaned("EVIL_BASTARD"), """
select distinct participant_id, trial_id from gaze where (participant_id, trial_id) not in (
 select participant_id, trial_id from clean)"""))
def removed_trials(spark, sf):
    events = raw(spark, sf, "EVIL_BASTARD")
    return clean.removed_trials(events, clean.clean_events(events, "EVIL_BASTARD")).drop("experiment")


# --- fills, clocks, stimulus state -----------------------------------------------------------------------------------

@register("coalesce_time", query(TIMED, f"select {ID}, event, time from timed"))
def coalesce_time(spark, sf):
    return timed(spark, sf).select(*ROW, "event", "time")


@register("std_time", query(TIMED, f"""
select {ID}, time - min(time) over t as time, start_time - min(time) over t as start_time,
 end_time - min(time) over t as end_time from timed window t as (partition by participant_id, trial_id)"""))
def std_time(spark, sf):
    return fills.trial_clock(timed(spark, sf)).select(*ROW, "time", "start_time", "end_time")


@register("std_time_from_start", query(TIMED, f"""
select {ID}, time - min(case when event = 'START' then time end) over t as time from timed
 window t as (partition by participant_id, trial_id)"""))
def std_time_from_start(spark, sf):
    return fills.trial_clock(timed(spark, sf), ["time"], origin="trial_start").select(*ROW, "time")


@register("ffill", query(TIMED, f"""
select {ID}, last_value(colour ignore nulls) over w as colour, last_value(stimulus_x ignore nulls) over w as stimulus_x,
 last_value(distance ignore nulls) over w as distance from timed window w as {UPTO}"""))
def ffill(spark, sf):
    return fills.fill(timed(spark, sf), ["colour", "stimulus_x", "distance"], width=CHUNK).select(
        *ROW, "colour", "stimulus_x", "distance")


@register("bfill", query(TIMED, f"""
select {ID}, first_value(target_width ignore nulls) over w as target_width from timed window w as {ONWARDS}"""))
def bfill(spark, sf):
    return fills.fill(timed(spark, sf), ["target_width"], "backward", width=CHUNK).select(*ROW, "target_width")


@register("bffill", query(TIMED, f"""
select {ID}, coalesce(first_value(distance ignore nulls) over b, last_value(distance ignore nulls) over f) as distance,
 coalesce(first_value(shape ignore nulls) over b, last_value(shape ignore nulls) over f) as shape
 from timed window f as {UPTO}, b as {ONWARDS}"""))
def bffill(spark, sf):
    return fills.fill(timed(spark, sf), ["distance", "shape"], "backward_forward", width=CHUNK).select(
        *ROW, "distance", "shape")


@register("bffill_across_trials", query(TIMED + f""",
once as (select {ID}, time, coalesce(first_value(distance ignore nulls) over b,
  last_value(distance ignore nulls) over f) as distance from timed window f as {UPTO}, b as {ONWARDS})""", f"""
select {ID}, coalesce(distance, last_value(distance ignore nulls) over (order by participant_id, trial_id,
 time nulls last, seq rows between unbounded preceding and current row)) as distance from once"""))
def bffill_across_trials(spark, sf):
    return fills.fill(timed(spark, sf), ["distance"], "backward_forward", width=CHUNK, scope="global").select(
        *ROW, "distance")


@register("side_fill", query(TIMED, f"""
select {ID}, coalesce(last_value(side ignore nulls) over f, first_value(side ignore nulls) over b) as side
 from timed window f as {UPTO}, b as {ONWARDS}"""))
def side_fill(spark, sf):
    return fills.fill(timed(spark, sf), ["side"], "forward_backward", width=CHUNK).select(*ROW, "side")


@register("stimulus_active", query(TIMED, f"""
select {ID}, coalesce(bool_or(event = 'FIXPOINT' and colour = '255 0 0') over w, false) as stimulus_active
 from timed window w as {UPTO}"""))
def stimulus_active(spark, sf):
    return fills.stimulus_active(timed(spark, sf, "REACTION"), "REACTION").select(*ROW, "stimulus_active")


@register("stimulus_onset", query(TIMED + """,
onset as (select participant_id, trial_id, arg_min(time, (time, seq)) filter (where colour = '255 255 255') as white,
 min(time_elapsed) filter (where event = 'TRIAL_VAR_DATA') as elapsed from timed group by all)""", """
select participant_id, trial_id, seq, case when colour = '255 0 0'
 then coalesce(cast(trunc(white + 1000 * elapsed) as bigint), time) else time end as time
 from timed join onset using (participant_id, trial_id)"""))
def stimulus_onset(spark, sf):
    return fills.stimulus_onset(timed(spark, sf, "ANTI_SACCADE")).select(*ROW, "time")


@register("trial_windows", query(TIMED, f"""
select {ID}, lag(event) over o as event_before, last_value(case when event = 'FIXPOINT' then time end ignore nulls) over w
 as shown_at, max(time) over t as last_time, first_value(time_elapsed ignore nulls) over f as time_elapsed,
 cast(count(*) over t as bigint) as n_rows, row_number() over o as position from timed
 window o as ({ctes.TRIAL_ORDER}), w as {UPTO}, t as (partition by participant_id, trial_id),
 f as ({ctes.TRIAL_ORDER} rows between unbounded preceding and unbounded following)"""))
def trial_windows(spark, sf):
    shown = F.when(F.col("event") == "FIXPOINT", F.col("time"))
    return scan(timed(spark, sf), S.TRIAL, "time", ["seq"], {
        "event_before": previous(F.col("event")), "shown_at": last(shown), "last_time": total(F.max, F.col("time")),
        "_elapsed": first_of_all(F.col("time_elapsed")), "n_rows": total(F.sum, F.lit(1)), "_n": sum_before(F.lit(1))},
        width=CHUNK).select(*ROW, "event_before", "shown_at", "last_time", F.col("_elapsed").alias("time_elapsed"),
                            "n_rows", (F.col("_n") + 1).alias("position"))


# --- scalar functions ------------------------------------------------------------------------------------------------

@register("clip_points", query(ctes.GAZE, """
select seq, participant_id, case when x is not null then greatest(0.0::double, least(1920.0::double, x)) end as x,
 case when y is not null then greatest(0.0::double, least(1080.0::double, y)) end as y,
 case when stimulus_x is not null then greatest(0.0::double, least(1920.0::double, stimulus_x)) end as stimulus_x,
 coalesce(stimulus_x between 0 and 1920 and stimulus_y between 0 and 1080, false) as on_screen
 from gaze where event in ('EFIX', 'FIXPOINT')"""))
def clip_points(spark, sf):
    rows = raw(spark, sf).where(F.col("event").isin("EFIX", "FIXPOINT")).withColumn(
        "on_screen", F.coalesce(C.on_screen(F.col("stimulus_x"), F.col("stimulus_y")), F.lit(False)))
    return fills.limit_to_screen(rows).select("seq", "participant_id", "x", "y", "stimulus_x", "on_screen")


@register("typed_cast", query(ctes.GAZE, """
select seq, participant_id, trial_id, try_cast(marks as bigint) as marks, coalesce(time_elapsed, delay) as time_elapsed,
 coalesce(pos_x, stimulus_x) as stimulus_x from gaze"""))
def typed_cast(spark, sf):
    rows = raw(spark, sf)
    rows = rows.select(*C.cast_columns(rows.columns, S.EVENT_TYPES))
    rows = fills.coalesce_columns(rows, "time_elapsed", "time_elapsed", "delay", ["delay"])
    rows = fills.coalesce_columns(rows, "stimulus_x", "pos_x", "stimulus_x", ["pos_x"])
    return rows.select("seq", "participant_id", "trial_id", "marks", "time_elapsed", "stimulus_x")


@register("guarded_parse", """
with t as (select event_id as seq, unnest([cast(value as varchar), '-' || cast(value as varchar), '.', '12.',
 cast(event_id as varchar), user_id || 'e2']) as token from events)
select seq, token, case when regexp_matches(token, '^[0-9]+$') then try_cast(token as double) end as whole,
 case when regexp_matches(token, '^[0-9]*[.]?[0-9]*$') and regexp_matches(token, '[0-9]') then try_cast(token as double)
 end as plain from t""")
def guarded_parse(spark, sf):
    value, event, user = F.col("value").cast("string"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    tokens = F.array(value, F.concat(F.lit("-"), value), F.lit("."), F.lit("12."), event, F.concat(user, F.lit("e2")))
    rows = inputs.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.explode(tokens).alias("token"))
    token = F.col("token")
    return rows.select("seq", "token", C.whole_number(token).alias("whole"), C.plain_decimal(token).alias("plain"))


@register("colour_name", query(ctes.GAZE, """
select seq, case colour when '255 0 0' then 'red' when '0 255 0' then 'green' when '0 0 255' then 'blue'
 when '255 255 255' then 'white' end as colour from gaze where event = 'FIXPOINT'"""))
def colour_name(spark, sf):
    return raw(spark, sf).where(F.col("event") == "FIXPOINT").select("seq", C.colour_name(F.col("colour")).alias("colour"))


def _move(a: str, b: str, low: str, high: str) -> str:
    return (f"case when abs({b} - {a}) < 50 then 'no_direction' when {b} > {a} then '{high}' "
            f"when {b} < {a} then '{low}' end")


def _area(value: str, centre: int, low: str, high: str) -> str:
    return (f"case when abs({value} - {centre}) < 50 then 'middle' when {value} > {centre} then '{high}' "
            f"when {value} < {centre} then '{low}' end")


DIR_2D = """case when dx in ('left', 'right') and dy in ('up', 'down') then dx || '_' || dy
 when dx in ('left', 'right') and dy = 'no_direction' then dx when dx = 'no_direction' and dy in ('up', 'down') then dy
 when dx = 'no_direction' and dy = 'no_direction' then 'no_direction' end"""
AREA_2D = """case when ax in ('left', 'right') and ay in ('up', 'down') then ax || '_' || ay
 when ax in ('left', 'right') and ay = 'middle' then ax when ax = 'middle' and ay = 'middle' then 'middle' end"""
END_AREA = "case when 840 < end_x and end_x < 1080 then 'middle' when end_x >= 1080 then 'right' when end_x <= 840 then 'left' end"


@register("saccade_labels", query(ctes.GAZE, f"""
select seq, dx as direction_1d, {DIR_2D} as direction_2d, {END_AREA} as end_area from (
 select *, {_move('start_x', 'end_x', 'left', 'right')} as dx, {_move('start_y', 'end_y', 'down', 'up')} as dy
 from gaze where event = 'ESACC') s"""))
def saccade_labels(spark, sf):
    return raw(spark, sf).where(F.col("event") == "ESACC").select(
        "seq", C.saccade_direction_1d().alias("direction_1d"), C.saccade_direction_2d().alias("direction_2d"),
        C.saccade_end_area(F.col("end_x")).alias("end_area"))


@register("stimulus_dir", query(ctes.GAZE, f"""
select seq, {AREA_2D} as direction, case when ax = 'middle' and ay <> 'middle' then ay else {AREA_2D} end as direction_fixed
 from (select *, {_area('stimulus_x', 960, 'left', 'right')} as ax, {_area('stimulus_y', 540, 'down', 'up')} as ay
 from gaze where event = 'FIXPOINT') s"""))
def stimulus_dir(spark, sf):
    x, y = F.col("stimulus_x"), F.col("stimulus_y")
    return raw(spark, sf).where(F.col("event") == "FIXPOINT").select(
        "seq", C.centre_area(x, y).alias("direction"), C.centre_area(x, y, "fixed").alias("direction_fixed"))


@register("fixation_area", query(ctes.GAZE, f"""
select seq, {AREA_2D} as area from (
 select *, {_area('x', 960, 'left', 'right')} as ax, {_area('y', 540, 'down', 'up')} as ay
 from gaze where event = 'EFIX') s"""))
def fixation_area(spark, sf):
    return raw(spark, sf).where(F.col("event") == "EFIX").select(
        "seq", C.centre_area(F.col("x"), F.col("y")).alias("area"))


@register("gaze_dir", query(TIMED, f"""
select participant_id, trial_id, seq, case when colour = '255 0 0' and x > 1100 then 'right'
 when colour = '255 0 0' and x < 820 then 'left' when colour = '255 0 0' then 'middle' end as gaze from (
 select * replace (last_value(colour ignore nulls) over w as colour) from timed window w as {UPTO}) f
 where event = 'EFIX'"""))
def gaze_dir(spark, sf):
    filled = fills.fill(timed(spark, sf), ["colour"], width=CHUNK).where(F.col("event") == "EFIX")
    return filled.select(*ROW, C.gaze_direction().alias("gaze"))


# --- blinks and preparation ------------------------------------------------------------------------------------------

@register("drop_blink_saccades", query(TIMED + f""",
numbered as (select *, coalesce(sum(case when event = 'ESACC' then 1 else 0 end) over ({ctes.TRIAL_ORDER}
  rows between unbounded preceding and 1 preceding), 0) as segment, row_number() over ({ctes.TRIAL_ORDER}) as pos from timed),
segments as (select participant_id, trial_id, segment, bool_or(event = 'ESACC') as closed,
 min(pos) filter (where event = 'SSACC') as a, max(pos) filter (where event = 'SBLINK') as s,
 max(pos) filter (where event = 'EBLINK') as e from numbered group by all)""", """
select participant_id, trial_id, seq, event from numbered join segments using (participant_id, trial_id, segment)
 where event not in ('SBLINK', 'EBLINK', 'SFIX', 'SSACC')
 and not (closed and coalesce(pos >= a and s > a and e > a, false))"""))
def drop_blink_saccades(spark, sf):
    return blinks.drop_blink_saccades(timed(spark, sf), width=CHUNK).select(*ROW, "event")


@register("drop_blink_overlap", query(ctes.GAZE, """
select participant_id, trial_id, seq, event from gaze g where event not in ('SBLINK', 'EBLINK', 'SFIX', 'SSACC')
 and not (event = 'ESACC' and exists (select 1 from gaze b where b.event = 'EBLINK'
 and b.participant_id = g.participant_id and b.trial_id = g.trial_id and b.eye = g.eye
 and b.start_time <= g.end_time and b.end_time >= g.start_time))"""))
def drop_blink_overlap(spark, sf):
    return blinks.drop_blink_saccades(raw(spark, sf), mode="overlap", width=CHUNK).select(*ROW, "event")


def _register_prep(experiment: str):
    @register(f"prep_{experiment.lower()}", query(ctes.prepared(experiment), "select * from prep"))
    def run(spark, sf):
        return prep(spark, sf, experiment)


for _e in S.EXPERIMENTS:
    _register_prep(_e)


# --- joins -----------------------------------------------------------------------------------------------------------

@register("trial_intervals", query(ctes.GAZE, """
select participant_id, row_number() over (partition by participant_id order by trial_id) - 1 as trial_id,
 max(case when event = 'START' then time end) as start_time, max(case when event = 'END' then time end) as end_time
 from gaze where event in ('START', 'END') group by participant_id, gaze.trial_id"""))
def trial_intervals(spark, sf):
    return joins.trial_intervals(raw(spark, sf), "ordinal").drop("experiment")


@register("assign_trials", query(ctes.GAZE + """,
spans as (select participant_id, trial_id, max(case when event = 'START' then time end) as s,
 max(case when event = 'END' then time end) as e from gaze where event in ('START', 'END') group by all)""", """
select p.participant_id, p.seq, max(spans.trial_id) as trial_id from gaze p join spans
 on p.participant_id = spans.participant_id and p.time between spans.s and spans.e group by p.participant_id, p.seq,
 p.trial_id"""))
def assign_trials(spark, sf):
    events = raw(spark, sf)
    points = events.where(F.col("time").isNotNull()).select("participant_id", "seq", "time")
    return joins.assign_trials(points, joins.trial_intervals(events), width=DAY).drop("time")


ASOF = TIMED + f""",
merged as (select participant_id, trial_id, time, seq, 1 as side, null as hit, null as px, null as py from timed
  where event = 'EFIX'
 union all select participant_id, trial_id, time, seq, 0, time, stimulus_x, stimulus_y from timed
  where event = 'FIXPOINT'),
near as (select *, last_value(case when side = 0 then struct_pack(hit := hit, x := px, y := py) end ignore nulls) over (
  partition by participant_id, trial_id order by time, side, seq rows between unbounded preceding and current row) as b,
 first_value(case when side = 0 then struct_pack(hit := hit, x := px, y := py) end ignore nulls) over (
  partition by participant_id, trial_id order by time, side, seq rows between current row and unbounded following) as f
 from merged)"""


def _points_and_fixations(spark, sf):
    events = timed(spark, sf)
    columns = ["participant_id", "trial_id", "time", "seq"]
    return (events.where(F.col("event") == "EFIX").select(*columns),
            events.where(F.col("event") == "FIXPOINT").select(*columns, "stimulus_x", "stimulus_y"))


@register("asof_backward", query(ASOF, """
select participant_id, trial_id, time, seq, b.hit as shown_at, b.x as stimulus_x, b.y as stimulus_y from near
 where side = 1"""))
def asof_backward(spark, sf):
    return joins.asof(*_points_and_fixations(spark, sf), S.TRIAL, ["stimulus_x", "stimulus_y"], width=CHUNK,
                      matched_on="shown_at")


@register("asof_nearest", query(ASOF, """
select participant_id, trial_id, time, seq, case when abs(time - m.hit) <= 43200000 then m.hit end as shown_at,
 case when abs(time - m.hit) <= 43200000 then m.x end as stimulus_x,
 case when abs(time - m.hit) <= 43200000 then m.y end as stimulus_y from (
 select *, case when b is not null and (f is null or time - b.hit <= f.hit - time) then b else f end as m
 from near where side = 1) n"""))
def asof_nearest(spark, sf):
    return joins.asof(*_points_and_fixations(spark, sf), S.TRIAL, ["stimulus_x", "stimulus_y"], direction="nearest",
                      tolerance=DAY // 2, width=CHUNK, matched_on="shown_at")


# --- features --------------------------------------------------------------------------------------------------------

def per_day(df: DataFrame) -> DataFrame:
    """Rates per second are tiny on the clock of these tables."""
    return rounded_doubles(df, 86400)


def precalculated_sql(experiment: str) -> str:
    return query(ctes.prepared(experiment), f"""
select {KEYS}, {five('peak_velocity', "case when event = 'ESACC' then peak_velocity end", 'sacc')},
 {five('amplitude', "case when event = 'ESACC' then amplitude end", 'sacc')},
 {five('duration', "case when event = 'ESACC' then duration end", 'sacc')},
 {five('duration', "case when event = 'EFIX' then duration end", 'fix')},
 {five('avg_pupil_size', "case when event = 'EFIX' then avg_pupil_size end", 'fix')}
 from prep where event in ('ESACC', 'EFIX') group by all""")


@register("precalc_metrics", precalculated_sql("SHAPES"))
def precalc_metrics(spark, sf):
    return rounded_doubles(event_features.precalculated_metrics(ready(spark, sf, "SHAPES")), settle=True)


@register("mean_metrics_right", query(ctes.prepared("SHAPES"), f"""
select {KEYS}, round(avg(case when event = 'ESACC' then peak_velocity end), 6) as mean_peak_velocity_sacc,
 round(avg(case when event = 'ESACC' then amplitude end), 6) as mean_amplitude_sacc,
 round(avg(case when event = 'ESACC' then duration end), 6) as mean_duration_sacc,
 round(avg(case when event = 'EFIX' then duration end), 6) as mean_duration_fix,
 round(avg(case when event = 'EFIX' then avg_pupil_size end), 6) as mean_pupil_size_fix
 from prep where eye is null or eye = 'R' group by all"""))
def mean_metrics_right(spark, sf):
    return rounded_doubles(event_features.mean_metrics(ready(spark, sf, "SHAPES"), "R"))


def distance_sql(active: str, experiment: str = "SHAPES") -> str:
    return query(ctes.prepared(experiment) + f""",
moves as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from prep where event = 'EFIX'{active}
 window w as (partition by participant_id, trial_id, eye order by time, seq))""", f"""
select {KEYS}, {five('fixation_distance', 'sqrt(dx * dx + dy * dy)')}, {five('x_fixation_dist', 'dx')},
 {five('y_fixation_dist', 'dy')} from moves group by all""")


@register("fix_distance", distance_sql(" and stimulus_active"))
def fix_distance(spark, sf):
    return rounded_doubles(event_features.fixation_distance(ready(spark, sf, "SHAPES"), width=CHUNK))


@register("fix_distance_all", distance_sql(""))
def fix_distance_all(spark, sf):
    return rounded_doubles(event_features.fixation_distance(ready(spark, sf, "SHAPES"), False, width=CHUNK))


def _rate_ctes(experiment: str, event: str, where: str = "") -> str:
    return ctes.prepared(experiment) + f""",
act as (select *, last_value(case when event = 'FIXPOINT' then time end ignore nulls) over {UPTO} as shown,
 max(time) over (partition by participant_id, trial_id) as fin from prep where stimulus_active{where}),
counted as (select {KEYS}, trial_id, eye, (fin - shown) / 1000 as s, count(*) as n from act
 where event = '{event}' and eye is not null group by all having s is not null)"""


PER_TRIAL = f"""
eyes as (select {KEYS}, trial_id, eye, sum(n / nullif(s, 0)) as rate from counted group by all),
rates as (select {KEYS}, trial_id, sum(rate) / count(*) as rate from eyes group by all)"""


@register("fix_per_s", query(_rate_ctes("SHAPES", "EFIX") + "," + PER_TRIAL, f"""
select {KEYS}, {five('fixations_per_second', 'rate', '', ' * 86400')} from rates group by all"""))
def fix_per_s(spark, sf):
    return per_day(event_features.fixations_per_second(ready(spark, sf, "SHAPES"), CHUNK))


@register("sacc_per_s", query(_rate_ctes("FITTS_LAW", "ESACC") + "," + PER_TRIAL, f"""
select {KEYS}, {five('saccades_per_second', 'rate', '', ' * 86400')} from rates group by all"""))
def sacc_per_s(spark, sf):
    return per_day(event_features.saccades_per_second(ready(spark, sf, "FITTS_LAW"), CHUNK))


@register("fix_per_s_right", query(_rate_ctes("FITTS_LAW", "EFIX", " and (eye is null or eye = 'R')"), f"""
select {KEYS}, round(avg(n / nullif(s, 0)) * 86400, 6) as avg_fixations_pr_second,
 round(stddev_samp(n / nullif(s, 0)) * 86400, 6) as std_fixations_pr_second from counted where s <> 0 group by all"""))
def fix_per_s_right(spark, sf):
    return per_day(event_features.one_eye_rate(ready(spark, sf, "FITTS_LAW"), "EFIX", "fixations_pr_second", "R", CHUNK))


def _verdict(experiment: str) -> str:
    if experiment == "ANTI_SACCADE":
        inner = f"""select *, {_move('start_x', 'end_x', 'left', 'right')} as d, {END_AREA} as a from prep
 where stimulus_active"""
        correct = """case when event <> 'ESACC' or d = 'no_direction' or a = 'middle' then null
 when d = a and d <> side then true when d = a and d = side then false end"""
    else:
        inner = f"""select *, case when event = 'ESACC' then {DIR_2D} end as d,
 last_value(case when event = 'FIXPOINT' then {AREA_2D} end ignore nulls) over {UPTO} as a from (
 select *, {_move('start_x', 'end_x', 'left', 'right')} as dx, {_move('start_y', 'end_y', 'down', 'up')} as dy,
 {_area('stimulus_x', 960, 'left', 'right')} as ax, {_area('stimulus_y', 540, 'down', 'up')} as ay from prep
 where stimulus_active) i"""
        correct = """case when d is null then null when d = 'no_direction' then false else coalesce(d = a, false) end"""
    return ctes.prepared(experiment) + f""",
judged as (select *, last_value(case when event = 'FIXPOINT' then time end ignore nulls) over {UPTO} as stimulus_time,
 first_value(correct ignore nulls) over ({ctes.TRIAL_ORDER} rows between unbounded preceding and unbounded following)
  as trial_correct from (select *, {correct} as correct from ({inner}) d) j),
verdicts as (select {KEYS}, trial_id, bool_and(trial_correct) as ok from judged group by all),
firsts as (select {KEYS}, trial_id, arg_min(start_time - stimulus_time, (time, seq)) as rt from judged
 where correct group by all)"""


def _register_verdicts(experiment: str, prefix: str, rows):
    @register(f"{prefix}_correct", query(_verdict(experiment), f"""
select {ID}, event, stimulus_time, cast(correct as int) as is_saccade_correct, cast(trial_correct as int) as is_trial_correct from judged"""))
    def correct(spark, sf):
        return rows(ready(spark, sf, experiment), width=CHUNK).select(
            *ROW, "event", "stimulus_time", F.col("is_saccade_correct").cast("int").alias("is_saccade_correct"),
            F.col("is_trial_correct").cast("int").alias("is_trial_correct"))

    @register(f"{prefix}_n_correct", query(_verdict(experiment), f"""
select {KEYS}, cast(count(*) filter (where ok) as bigint) as n_correct_trials from verdicts group by all"""))
    def n_correct(spark, sf):
        return event_features.n_correct_trials(rows(ready(spark, sf, experiment), width=CHUNK))

    @register(f"{prefix}_prop_correct", query(_verdict(experiment), f"""
select {KEYS}, round(count(*) filter (where ok) / nullif(count(ok), 0), 6) as prop_correct_trials from verdicts
 group by all"""))
    def prop_correct(spark, sf):
        return rounded_doubles(event_features.prop_correct_trials(rows(ready(spark, sf, experiment), width=CHUNK)))

    @register(f"{prefix}_reaction_time", query(_verdict(experiment), f"""
select {KEYS}, round(avg(rt), 6) as reaction_time_avg, round(stddev_samp(rt), 6) as reaction_time_std from firsts
 group by all"""))
    def reaction_time(spark, sf):
        return rounded_doubles(event_features.reaction_time(rows(ready(spark, sf, experiment), width=CHUNK)))


_register_verdicts("ANTI_SACCADE", "antisacc", event_features.antisaccade_rows)
_register_verdicts("REACTION", "reaction", event_features.reaction_rows)


@register("fitts_overshoot", query(ctes.prepared("FITTS_LAW") + f""",
act as (select * from prep where stimulus_active),
points as (select *, row_number() over (partition by participant_id, trial_id order by time, seq) as i from act
 where event = 'FIXPOINT'),
targets as (select participant_id, trial_id, max(stimulus_x) filter (where i = 1) as x1,
 max(stimulus_y) filter (where i = 1) as y1, max(stimulus_x) filter (where i = 2) as x2,
 max(stimulus_y) filter (where i = 2) as y2 from points group by all),
eyes as (select {KEYS}, trial_id, eye, avg(least(sqrt((x - x1) ** 2 + (y - y1) ** 2),
 sqrt((x - x2) ** 2 + (y - y2) ** 2))) as d from act join targets using (participant_id, trial_id)
 where event = 'EFIX' group by all),
rates as (select {KEYS}, trial_id, sum(d) / count(*) as rate from eyes group by all)""", f"""
select {KEYS}, {five('fixation_overshoot', 'rate')} from rates group by all"""))
def fitts_overshoot(spark, sf):
    return rounded_doubles(event_features.fixation_overshoot(ready(spark, sf, "FITTS_LAW"), width=CHUNK))


@register("kd_mistakes_elapsed", query(ctes.prepared("KING_DEVICK"), f"""
select {KEYS}, round(avg(marks), 6) as avg_mistakes_pr_trial, round(avg(time_elapsed), 6) as avg_time_elapsed_pr_trial
 from prep where event = 'TRIAL_VAR_DATA' group by all"""))
def kd_mistakes_elapsed(spark, sf):
    events = ready(spark, sf, "KING_DEVICK")
    return rounded_doubles(event_features.mistakes_per_trial(events).join(
        event_features.elapsed_per_trial(events), ["experiment", "participant_id"]))


KD_SACCADES = ctes.prepared("KING_DEVICK") + """,
sacc as (select * from prep where event = 'ESACC' and eye is not null and time / 1000 < time_elapsed)"""


@register("kd_wrong_dir", query(KD_SACCADES + f""",
eyes as (select {KEYS}, trial_id, eye, 100 * count(*) filter (where end_x < start_x)
  / count(*) filter (where end_x <> start_x) as rate from sacc group by all having count(*) filter (where end_x < start_x) > 0),
rates as (select {KEYS}, trial_id, sum(rate) / count(*) as rate from eyes group by all)""", f"""
select {KEYS}, {five('wrong_direction_saccade_pct', 'rate')} from rates group by all"""))
def kd_wrong_dir(spark, sf):
    return rounded_doubles(event_features.wrong_direction_share(ready(spark, sf, "KING_DEVICK")))


@register("kd_sacc_per_s", query(KD_SACCADES + f""",
eyes as (select {KEYS}, trial_id, eye, count(*) / nullif(any_value(time_elapsed), 0) as rate from sacc group by all),
rates as (select {KEYS}, trial_id, sum(rate) / count(*) as rate from eyes group by all)""", f"""
select {KEYS}, {five('saccades_per_second', 'rate', '', ' * 86400')} from rates group by all"""))
def kd_sacc_per_s(spark, sf):
    return per_day(event_features.timed_saccades_per_second(ready(spark, sf, "KING_DEVICK")))


# --- exploratory tables ----------------------------------------------------------------------------------------------

@register("eye_copies", query(ctes.GAZE, """
select seq, participant_id, trial_id, event, 'L' as eye from gaze where eye is null or eye = 'L'
union all select seq, participant_id, trial_id, event, 'R' from gaze where eye is null or eye = 'R'"""))
def eye_copies(spark, sf):
    return views.eye_copies(raw(spark, sf)).select("seq", "participant_id", "trial_id", "event", "eye")


def _copies(fallback: str = "start_time") -> str:
    order = "partition by participant_id, trial_id, eye order by time nulls last, seq"
    return ctes.GAZE + f""",
copies as (select * replace (coalesce(time, cast({fallback} as bigint)) as time) from (
 select * replace ('L' as eye) from gaze where eye is null or eye = 'L'
 union all select * replace ('R' as eye) from gaze where eye is null or eye = 'R') c where event not in ('SSACC', 'SFIX')),
paths as (select * replace (last_value(colour ignore nulls) over u as colour,
  last_value(stimulus_x ignore nulls) over u as stimulus_x, last_value(stimulus_y ignore nulls) over u as stimulus_y,
  first_value(side ignore nulls) over a as side, time - min(time) over a as time,
  coalesce(last_value(time_elapsed ignore nulls) over u, first_value(time_elapsed ignore nulls) over d) as time_elapsed)
 from copies window u as ({order} rows between unbounded preceding and current row),
  d as ({order} rows between current row and unbounded following),
  a as ({order} rows between unbounded preceding and unbounded following))"""


PATH_CLASS = {
    "ANTI_SACCADE": """case when event = 'FIXPOINT' and colour = '255 0 0' then 'Stimulus'
 when event = 'FIXPOINT' and colour = '255 255 255' then 'Middle stimulus'
 when event = 'EFIX' and colour = '255 0 0' then 'Fixations - Post stimulus'
 when event = 'EFIX' and colour = '255 255 255' then 'Fixations - Pre stimulus' end""",
    "EVIL_BASTARD": """case when event = 'EFIX' then 'Fixations' when colour = '0 0 255' then 'Stimulus - Blue'
 when colour = '255 0 0' then 'Stimulus - Red' else 'Stimulus' end""",
    "FITTS_LAW": "case when event = 'FIXPOINT' and colour = '255 0 0' then 'Stimulus' when event = 'EFIX' then 'Fixations' end",
    "SHAPES": "case when event = 'EFIX' then 'Fixations' when colour = '255 255 255' then 'Stimulus' end",
}
PATH_CLASS |= {"REACTION": PATH_CLASS["ANTI_SACCADE"], "SMOOTH_PURSUITS": PATH_CLASS["SHAPES"]}
PATH_ROWS = {"ANTI_SACCADE": "event in ('EFIX', 'FIXPOINT') and colour in ('255 255 255', '255 0 0')",
             "EVIL_BASTARD": "event in ('EFIX', 'FIXPOINT')",
             "KING_DEVICK": "event = 'EFIX' and time < time_elapsed * 1000"}
PATH_ROWS |= {"REACTION": PATH_ROWS["ANTI_SACCADE"]} | dict.fromkeys(("FITTS_LAW", "SMOOTH_PURSUITS", "SHAPES"), PATH_ROWS["EVIL_BASTARD"])


def _register_path(experiment: str):
    label = PATH_CLASS.get(experiment, "cast(null as varchar)")

    @register(f"scan_path_{experiment.lower()}", query(_copies(), f"""
select participant_id, trial_id, eye, time, seq, event, coalesce(x, stimulus_x) as plot_x, coalesce(y, stimulus_y) as plot_y,
 plot_class, row_number() over (partition by participant_id, trial_id, eye, plot_class order by time, seq) as event_nr
 from (select *, {label} as plot_class from paths where {PATH_ROWS[experiment]}) p"""))
    def run(spark, sf):
        return views.scan_path(raw(spark, sf, experiment), experiment, CHUNK)


for _e in PATH_ROWS:
    _register_path(_e)


def people(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.demographics(spark, sf).select(F.col("ID").alias("participant_id"), F.col("Group").alias("group"))


@register("incorrect_by_group", query(_copies("end_time") + "," + ctes.USERS, """
select u.grp as "group", is_trial_incorrect, count(*) as n from (
 select participant_id, trial_id, bool_or(coalesce(colour = '255 0 0' and event = 'EFIX' and side =
  case when x > 1100 then 'right' when x < 820 then 'left' else 'middle' end, false)) as is_trial_incorrect from paths
 where eye = 'L' and event in ('FIXPOINT', 'EFIX', 'START', 'END', 'TRIALID', 'TRIAL_VAR_DATA') group by all) t
 left join users u using (participant_id) group by all"""))
def incorrect_by_group(spark, sf):
    return views.incorrect_trials(raw(spark, sf, "ANTI_SACCADE"), people(spark, sf), "L", CHUNK)


@register("fix_per_trial_by_group", query(ctes.GAZE + "," + ctes.USERS, """
select grp as "group", round(avg(m), 6) as avg_fix_pr_trial from (
 select participant_id, avg(n) as m from (select participant_id, trial_id, count(*) as n from gaze
  where event = 'EFIX' and eye = 'R' group by all) t group by all) p left join users using (participant_id)
 group by all"""))
def fix_per_trial_by_group(spark, sf):
    return rounded_doubles(views.fixations_by_group(raw(spark, sf), people(spark, sf)))


@register("every_nth", query(TIMED, f"""
select {ID}, event from (select *, row_number() over ({ctes.TRIAL_ORDER}) - 1 as i from timed) n where i % 10 = 0"""))
def every_nth(spark, sf):
    return views.every_nth(timed(spark, sf), 10, width=CHUNK).select(*ROW, "event")


@register("event_counts", query(ctes.GAZE, """
select colour, event, cast(count(*) as bigint) as n, count(distinct eye) as n_eyes, count(distinct participant_id)
 as n_participants from gaze group by all"""))
def event_counts(spark, sf):
    return raw(spark, sf).groupBy("colour", "event").agg(
        F.count("*").alias("n"), F.countDistinct("eye").alias("n_eyes"),
        F.countDistinct("participant_id").alias("n_participants"))


# --- recorder logs ---------------------------------------------------------------------------------------------------

LABELS = ["side", "time_elapsed", "delay", "marks", "shape", "speed"]


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The raw events rendered as recorder lines, one recording per participant."""
    rows = timed(spark, sf).withColumn("original", F.col("time"))

    def whole(c: str):
        return F.col(c).cast("bigint").cast("string")

    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("."))

    event, time = F.col("event"), F.col("time").cast("string")
    line = (F.when(event == "TRIALID", F.concat_ws(" ", F.lit("MSG"), time, event, F.col("trial_id").cast("string")))
            .when(event.isin("START", "END"), F.concat_ws("\t", event, time, F.lit("EVENTS")))
            .when(event == "TRIAL_VAR_DATA", F.concat_ws(" ", F.lit("MSG"), time, F.lit("!V TRIAL_VAR_DATA"),
                                                         *[text(c) for c in LABELS]))
            .when(event == "FIXPOINT", F.concat_ws(" ", F.lit("MSG"), time, F.lit("!V FIXPOINT"), F.col("colour"),
                                                   F.lit("0 0 0"), whole("stimulus_x"), whole("stimulus_y")))
            .when(event == "EFIX", F.concat_ws("  ", event, "eye", whole("start_time"), whole("end_time"), whole("duration"),
                                               whole("x"), whole("y"), text("avg_pupil_size")))
            .when(event == "ESACC", F.concat_ws(" ", event, "eye", whole("start_time"), whole("end_time"),
                                                whole("duration"), whole("start_x"), whole("start_y"), whole("end_x"),
                                                whole("end_y"), text("amplitude"), text("peak_velocity")))
            .when(event == "EBLINK", F.concat_ws(" ", event, "eye", whole("start_time"), whole("end_time"),
                                                 whole("duration")))
            .otherwise(F.concat_ws(" ", event, "eye", time)))
    header = F.lit("MSG 0 TRIAL_VAR_LABELS " + " ".join(LABELS))
    noise = F.lit("INPUT 0 0")
    lines = F.when(event == "TRIALID", F.array(header, line)).otherwise(F.array(line, noise))
    return rows.select(F.concat(F.lit("Shapes_"), F.col("participant_id").cast("string"), F.lit("_x.asc")).alias("recording"),
                       "participant_id", F.col("trial_id").alias("part"), F.col("time").alias("at"), F.col("seq").alias("place"),
                       F.posexplode(lines).alias("line_no", "line"))


@register("asc_roundtrip", query(ctes.GAZE, """
select participant_id, trial_id, time, event, eye, colour, stimulus_x, stimulus_y, start_time, end_time, duration,
 case when x >= 0 then x end as x, case when y >= 0 then y end as y, round(avg_pupil_size, 6) as avg_pupil_size, start_x,
 start_y, end_x, end_y, round(amplitude, 6) as amplitude, round(peak_velocity, 6) as peak_velocity, side,
 round(time_elapsed, 6) as time_elapsed, marks,
 case when event = 'TRIAL_VAR_DATA' then coalesce(shape, '.') end as shape from gaze"""))
def asc_roundtrip(spark, sf):
    parsed = parse_events(log_lines(spark, sf), "SHAPES", "part", ["at", "place", "line_no"],
                          F.struct("part", F.floor(F.col("at") / CHUNK).alias("c")))
    return rounded_doubles(parsed.select(
        "participant_id", "trial_id", "time", "event", "eye", "colour", "stimulus_x", "stimulus_y", "start_time", "end_time",
        "duration", "x", "y", "avg_pupil_size", "start_x", "start_y", "end_x", "end_y", "amplitude", "peak_velocity", "side",
        F.col("time_elapsed").try_cast("double").alias("time_elapsed"), "marks", "shape"))
