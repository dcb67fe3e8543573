"""The tables of ``workload.inputs`` as DuckDB common table expressions."""

EV = """
ev as (select event_id as seq, user_id as participant_id, cast((day(ts) - 1) // 6 as bigint) as trial_id,
 epoch_us(ts) // 1000 - 1704067200000 as t, event_type, value,
 cast(json_extract_string(props, '$.k') as int) as k from events)"""

GAZE = EV + """,
ev2 as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (
  partition by participant_id, trial_id order by t, seq rows between unbounded preceding and current row)
  - (case when event_type = 'signup' then 1 else 0 end) as n from ev),
ev3 as (select *, case event_type when 'signup' then 'FIXPOINT' when 'click' then 'ESACC' when 'view' then 'EFIX'
  when 'purchase' then (case when k % 2 = 0 then 'SFIX' else 'SSACC' end)
  else (case when k % 2 = 0 then 'SBLINK' else 'EBLINK' end) end as event from ev2),
body as (select seq, participant_id, trial_id,
 case when event in ('EFIX', 'ESACC', 'EBLINK') then null else t end as time, event,
 case when event = 'FIXPOINT' then null when k % 2 = 0 then 'L' else 'R' end as eye,
 case when event <> 'FIXPOINT' then null when n % 3 = 0 then '255 255 255' when n % 3 = 1 then '255 0 0'
  else '0 0 255' end as colour,
 case when event = 'FIXPOINT' then cast(seq * 7919 % 2200 - 100 as double) end as stimulus_x,
 case when event = 'FIXPOINT' then cast(seq * 104729 % 1300 - 100 as double) end as stimulus_y,
 case when event in ('EFIX', 'ESACC', 'EBLINK') then cast(t as double) end as start_time,
 case when event in ('EFIX', 'ESACC', 'EBLINK') then cast(t + 20 + k as double) end as end_time,
 case when event in ('EFIX', 'ESACC', 'EBLINK') then cast(20 + k as double) end as duration,
 case when event = 'EFIX' then cast(seq * 7907 % 2100 - 90 as double) end as x,
 case when event = 'EFIX' then cast(seq * 7901 % 1200 - 60 as double) end as y,
 case when event = 'EFIX' then value * 10 end as avg_pupil_size,
 case when event = 'ESACC' then cast(seq * 7883 % 1921 as double) end as start_x,
 case when event = 'ESACC' then cast(seq * 7879 % 1081 as double) end as start_y,
 case when event = 'ESACC' then cast(seq * 7877 % 1921 as double) end as end_x,
 case when event = 'ESACC' then cast(seq * 7873 % 1081 as double) end as end_y,
 case when event = 'ESACC' then value / 10 end as amplitude,
 case when event = 'ESACC' then value * 3 end as peak_velocity,
 case when event = 'FIXPOINT' and seq % 3 = 0 then cast(seq * 7919 % 2200 - 93 as double) end as pos_x,
 case when event = 'FIXPOINT' and seq % 3 = 0 then cast(seq * 104729 % 1300 - 93 as double) end as pos_y,
 case when event = 'FIXPOINT' and seq % 2 = 0 then cast(seq * 31 % 500 + 100 as double) end as distance,
 case when event = 'FIXPOINT' and seq % 2 = 0 then cast(seq * 17 % 90 + 10 as double) end as target_width,
 case when event = 'FIXPOINT' and seq % 5 = 0 then 'cross' end as target_shape from ev3),
span as (select participant_id, trial_id, min(t) as t0, max(t) as t1, participant_id * 5 + trial_id as j,
 participant_id + trial_id as s, participant_id * 3 + trial_id as e, participant_id * 7 + trial_id as v
 from ev group by all),
mark as (
 select -4 as seq, participant_id, trial_id, t0 - 2 as time, 'TRIALID' as event, * exclude (participant_id, trial_id)
  from span
 union all select -3, participant_id, trial_id, t0 - 1, 'START', * exclude (participant_id, trial_id) from span
  where j % 11 <> 0
 union all select 900000001, participant_id, trial_id, t1 + 200, 'END', * exclude (participant_id, trial_id) from span
  where j % 13 <> 0
 union all select 900000002, participant_id, trial_id, t1 + 201, 'TRIAL_VAR_DATA',
  * exclude (participant_id, trial_id) from span where j % 19 <> 0
 union all select 900000003, participant_id, trial_id, t1 + 200, 'END', * exclude (participant_id, trial_id) from span
  where j % 7 = 0),
marked as (select seq, participant_id, trial_id, time, event,
 case when event = 'TRIAL_VAR_DATA' then (case when s % 2 = 0 then 'left' else 'right' end) end as side,
 case when event = 'TRIAL_VAR_DATA' and e % 7 <> 0 then (t1 - t0) / 1000.0::double * 0.7::double end as time_elapsed,
 case when event = 'TRIAL_VAR_DATA' then (t1 - t0) / 1000.0::double * 0.7::double * 0.9::double end as delay,
 case when event = 'TRIAL_VAR_DATA' then (case when s % 17 = 0 then 'x' else cast(s % 5 as varchar) end) end as marks,
 case when event = 'TRIAL_VAR_DATA' and s % 6 <> 0 then (case when s % 3 = 0 then 'circle' else 'square' end) end
  as shape,
 case when event = 'TRIAL_VAR_DATA' then (v % 5) * 1.5::double end as speed from mark),
gaze as (select * from marked union all by name select * from body)"""

SAMPLES = """
samples as (select l_orderkey * 1000003 + l_partkey as seq, l_suppkey as participant_id,
 cast(l_linenumber as bigint) as trial_id,
 cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) * 10 as time,
 case when l_partkey % 7 <> 0 then l_extendedprice % 2000 - 40 end as x_left,
 case when l_partkey % 7 <> 0 then (l_extendedprice * 3) % 1180 - 50 end as y_left,
 case when l_partkey % 11 <> 0 then l_extendedprice % 2000 - 40 + (l_quantity - 25) / 10 end as x_right,
 case when l_partkey % 11 <> 0 then (l_extendedprice * 3) % 1180 - 50 + l_discount * 10 end as y_right,
 case when l_partkey % 7 <> 0 then l_discount * 100 end as x_velocity_left,
 case when l_partkey % 7 <> 0 then l_tax * 100 end as y_velocity_left,
 case when l_partkey % 11 <> 0 then l_discount * 90 + 1 end as x_velocity_right,
 case when l_partkey % 11 <> 0 then l_tax * 90 + 1 end as y_velocity_right from lineitem)"""

USERS = """
users as (select user_id as participant_id, case when user_id % 2 = 0 then 'PATIENT' else 'CONTROL' end as grp,
 case when user_id % 9 <> 0 then 45000 + user_id end as visit from (select distinct user_id from events) u)"""

USER_FEATURES = """
uf as (select *, value_mean * 2 + (participant_id % 3) * 0.1::double as value_twin, 1.0::double as constant from (
 select user_id as participant_id, cast(user_id % 2 as int) as y,
 avg(case when event_type = 'click' then value end) as click_mean,
 max(case when event_type = 'click' then value end) as click_max,
 avg(case when event_type = 'view' then value end) as view_mean,
 stddev_samp(case when event_type = 'view' then value end) as view_std,
 min(case when event_type = 'error' then value end) as error_min,
 coalesce(sum(case when event_type = 'purchase' then value end), 0) as purchase_sum,
 avg(value) as value_mean, cast(count(*) as double) as n_events from events group by user_id) g),
lf as (select participant_id, y, feature, value from (unpivot uf on click_mean, click_max, view_mean, view_std,
 error_min, purchase_sum, value_mean, value_twin, n_events, constant into name feature value value)
 where value is not null)"""

SURVEY = """
survey as (select o_custkey as id, o_orderkey as seq, o_orderdate as date,
 case when o_custkey % 2 = 0 then 'PATIENT' else 'CONTROL' end as category,
 case when o_orderkey % 3 <> 0 then o_orderpriority end as q0_a,
 case when o_orderkey % 3 = 0 then o_orderstatus end as q0_b,
 case when o_orderkey % 10 >= 7 then o_totalprice end as q1_sparse,
 case when o_orderkey % 13 <> 0 then o_totalprice end as q2,
 '[''' || (o_orderkey % 7) || ''', ''' || ((o_orderkey + 3) % 7) || ''']' as pain from orders)"""

EXCLUDED = "(87, 89, 93, 96, 103, 105, 109, 117, 118, 119, 120, 127, 128, 141)"
TRIAL_ORDER = "partition by participant_id, trial_id order by time nulls last, seq"


def rules(experiment: str) -> str:
    """HAVING clause of a valid trial."""
    def n(condition: str) -> str:
        return f"count(*) filter (where {condition})"

    parts = [f"{n(f'event = {e!r}')} = 1" for e in ("TRIALID", "TRIAL_VAR_DATA", "START", "END")]
    fixpoints = {"ANTI_SACCADE": "= 2", "REACTION": "= 2", "FITTS_LAW": "= 2", "FIXATIONS": "= 1",
                 "EVIL_BASTARD": "> 0", "SMOOTH_PURSUITS": "> 0", "SHAPES": "> 0"}
    event = "event = 'FIXPOINT'"
    if experiment in fixpoints:
        parts.append(f"{n(event)} {fixpoints[experiment]}")
    if experiment in ("ANTI_SACCADE", "REACTION"):
        parts.append(n(event + " and colour = '255 0 0'") + " = 1")
        parts.append(n(event + " and colour = '255 255 255'") + " = 1")
    if experiment == "KING_DEVICK":
        parts.append(n("event = 'TRIAL_VAR_DATA' and regexp_matches(marks, '^[0-9]+$')") + " >= 1")
    return " and ".join(parts)


def cleaned(experiment: str) -> str:
    """CTEs ``kept`` (row filters) and ``clean`` (rows of valid trials)."""
    blue = " and colour is distinct from '0 0 255'" if experiment == "EVIL_BASTARD" else ""
    return GAZE + f""",
kept as (select *, '{experiment}' as experiment from gaze where participant_id is not null
 and participant_id not in {EXCLUDED}{blue}),
valid as (select participant_id, trial_id from kept group by all having {rules(experiment)}),
clean as (select k.* from kept k join valid v using (participant_id, trial_id))"""


def _ffill(column: str) -> str:
    return f"last_value({column} ignore nulls) over upto"


def _bffill(column: str) -> str:
    return (f"coalesce(first_value({column} ignore nulls) over onwards, last_value({column} ignore nulls) over upto)")


FILLS = {
    "ANTI_SACCADE": (["colour", "stimulus_x", "stimulus_y"], []),
    "EVIL_BASTARD": (["colour", "stimulus_x", "stimulus_y"], []),
    "REACTION": (["colour", "stimulus_x", "stimulus_y"], []),
    "FITTS_LAW": (["distance", "target_width"], []),
    "KING_DEVICK": ([], ["marks", "time_elapsed"]),
    "SHAPES": ([], ["shape"]),
    "SMOOTH_PURSUITS": ([], ["shape", "speed"]),
    "FIXATIONS": (["target_shape", "stimulus_x", "stimulus_y"], []),
}


def prepared(experiment: str) -> str:
    """CTE ``prep``: preprocessed events of one experiment, built with plain windows."""
    sql = cleaned(experiment)
    sql += """,
typed as (select * replace (coalesce(time, cast(start_time as bigint)) as time, try_cast(marks as bigint) as marks)
 from clean)"""
    source = "typed"
    if experiment == "ANTI_SACCADE":
        sql += f""",
sided as (select * exclude (delay) replace (
  coalesce(last_value(side ignore nulls) over upto, first_value(side ignore nulls) over onwards) as side,
  coalesce(time_elapsed, delay) as time_elapsed) from typed
 window upto as ({TRIAL_ORDER} rows between unbounded preceding and current row),
  onwards as ({TRIAL_ORDER} rows between current row and unbounded following)),
onset as (select participant_id, trial_id, arg_min(time, (time, seq)) filter (where colour = '255 255 255') as white,
  min(time_elapsed) filter (where event = 'TRIAL_VAR_DATA') as elapsed from sided group by all),
moved as (select s.* replace (case when colour = '255 0 0'
   then coalesce(cast(trunc(white + 1000 * elapsed) as bigint), time) else time end as time)
  from sided s join onset o using (participant_id, trial_id))"""
        source = "moved"
    if experiment in ("REACTION", "FIXATIONS"):
        sql += """,
placed as (select * exclude (pos_x, pos_y) replace (coalesce(pos_x, stimulus_x) as stimulus_x,
 coalesce(pos_y, stimulus_y) as stimulus_y) from typed)"""
        source = "placed"
    forward, both = FILLS[experiment]
    filled = [f"{_ffill(c)} as {c}" for c in forward] + [f"{_bffill(c)} as {c}" for c in both]
    on = "event = 'FIXPOINT'" + (" and colour = '255 0 0'" if experiment in ("ANTI_SACCADE", "REACTION") else "")
    active = "" if experiment == "KING_DEVICK" else f""",
 coalesce(bool_or({on}) over upto, false) as stimulus_active"""
    sql += f""",
numbered as (select *{active},
 min(case when event <> 'TRIALID' then time end) over (partition by participant_id, trial_id) as t0,
 coalesce(sum(case when event = 'ESACC' then 1 else 0 end) over ({TRIAL_ORDER}
   rows between unbounded preceding and 1 preceding), 0) as segment,
 row_number() over ({TRIAL_ORDER}) as pos
 from (select * replace ({', '.join(filled)}) from {source}
  window upto as ({TRIAL_ORDER} rows between unbounded preceding and current row),
   onwards as ({TRIAL_ORDER} rows between current row and unbounded following)) f
 window upto as ({TRIAL_ORDER} rows between unbounded preceding and current row)),
segments as (select participant_id, trial_id, segment, bool_or(event = 'ESACC') as closed,
 min(pos) filter (where event = 'SSACC') as first_ss, max(pos) filter (where event = 'SBLINK') as s,
 max(pos) filter (where event = 'EBLINK') as e from numbered where event <> 'TRIALID' group by all),
prep as (select n.* exclude (t0, segment, pos) replace (
  time - t0 as time, start_time - t0 as start_time, end_time - t0 as end_time, {_clips(experiment)})
 from numbered n join segments g using (participant_id, trial_id, segment)
 where event not in ('TRIALID', 'SBLINK', 'EBLINK', 'SFIX', 'SSACC')
 and not (closed and coalesce(pos >= first_ss and s > first_ss and e > first_ss, false)))"""
    return sql


def _clips(experiment: str) -> str:
    xs = ["stimulus_x", "x", "start_x", "end_x"]
    ys = ["stimulus_y", "y", "start_y", "end_y"]
    if experiment not in ("REACTION", "FIXATIONS"):
        xs.append("pos_x")
        ys.append("pos_y")
    parts = [f"case when {c} is not null then greatest(0.0::double, least(1920.0::double, {c})) end as {c}" for c in xs]
    parts += [f"case when {c} is not null then greatest(0.0::double, least(1080.0::double, {c})) end as {c}" for c in ys]
    return ", ".join(parts)
