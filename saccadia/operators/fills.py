"""Fills, clocks and stimulus state inside a trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import clip
from saccadia.operators.scan import (DEFAULT_CHUNK, attach, first_of_all, following, last, order_key, scan)
from saccadia.operators.stats import value_chunks

X_COLUMNS = ["stimulus_x", "pos_x", "x", "start_x", "end_x"]
Y_COLUMNS = ["stimulus_y", "pos_y", "y", "start_y", "end_y"]


def fill(events: DataFrame, columns: list[str], how: str = "forward", by: list[str] | None = None,
         axis: str = "time", tie: str = "seq", width: int = DEFAULT_CHUNK, scope: str = "trial") -> DataFrame:
    """Fill missing values in row order.

    ``how``: ``forward``, ``backward``, ``backward_forward`` or ``forward_backward``. With ``scope='global'`` the second
    pass of a two-way fill also crosses trial borders: a trial without any value takes the value of a trial before it.
    """
    by = S.trial_of(events) if by is None else by
    items = {}
    for c in columns:
        if how in ("forward", "forward_backward", "backward_forward"):
            items[f"_f_{c}"] = last(F.col(c))
        if how in ("backward", "forward_backward", "backward_forward"):
            items[f"_b_{c}"] = following(F.col(c))
    done = scan(events, by, axis, [tie], items, width=width)
    order = {"forward": ["_f_"], "backward": ["_b_"], "forward_backward": ["_f_", "_b_"],
             "backward_forward": ["_b_", "_f_"]}[how]
    done = done.withColumns({c: F.coalesce(*[F.col(p + c) for p in order]) for c in columns}).drop(*items)
    if scope == "global" and len(order) == 2:
        done = _borrow_from_earlier_trial(done, columns, by, axis, tie, width, how)
    return done


def _borrow_from_earlier_trial(filled: DataFrame, columns: list[str], by: list[str], axis: str, tie: str, width: int,
                               how: str) -> DataFrame:
    # One row per trial: the value its last row holds after the first pass of the fill.
    key = order_key(axis, [tie])
    ends = filled.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns])
    # Trials follow each other inside an experiment, in ranges of participants: a range is a task, and only one row per
    # range meets the others.
    person = by.index("participant_id") if "participant_id" in by else 0
    outer, axis, ties = by[:person], by[person], by[person + 1:]
    if not outer:
        ends, outer = ends.withColumn("_all", F.lit(0)), ["_all"]
    pick = last if how == "backward_forward" else following
    items = {f"_e_{c}": pick(F.col(c)) for c in columns}
    carried = scan(value_chunks(ends, outer, axis), outer, axis, ties, items, chunk=F.col("_part")).select(*by, *items)
    out = filled.join(carried, by, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_e_{c}")) for c in columns}).drop(*items)


def coalesce_time(events: DataFrame, fallback: str = "start_time") -> DataFrame:
    return events.withColumn("time", F.coalesce("time", F.col(fallback).cast("bigint")))


def coalesce_columns(events: DataFrame, target: str, first: str, second: str, drop: list[str]) -> DataFrame:
    return events.withColumn(target, F.coalesce(F.col(first), F.col(second))).drop(*drop)


def limit_to_screen(frame: DataFrame, x: list[str] | None = None, y: list[str] | None = None) -> DataFrame:
    xs = [c for c in (X_COLUMNS if x is None else x) if c in frame.columns]
    ys = [c for c in (Y_COLUMNS if y is None else y) if c in frame.columns]
    return frame.withColumns({**{c: clip(F.col(c), 0, S.SCREEN_WIDTH) for c in xs},
                              **{c: clip(F.col(c), 0, S.SCREEN_HEIGHT) for c in ys}})


def relative_times(origin: Column, columns: list[str]) -> dict[str, Column]:
    return {c: F.col(c) - origin for c in columns}


def trial_clock(frame: DataFrame, columns: list[str] | None = None, origin: str = "trial_min") -> DataFrame:
    """Times relative to the first time of the trial, or to its START event with ``origin='trial_start'``."""
    columns = [c for c in ("time", "start_time", "end_time") if c in frame.columns] if columns is None else columns
    at = F.col("time") if origin == "trial_min" else F.when(F.col("event") == "START", F.col("time"))
    return attach(frame, S.trial_of(frame), _t0=F.min(at)).withColumns(relative_times(F.col("_t0"), columns)).drop("_t0")


def activation(experiment: str) -> Column | None:
    """Event that switches the stimulus on, None where the experiment has no such event."""
    fixpoint = F.col("event") == "FIXPOINT"
    if experiment in ("ANTI_SACCADE", "REACTION"):
        return fixpoint & (F.col("colour") == S.RED)
    if experiment == "KING_DEVICK":
        return None
    return fixpoint


def active_item(experiment: str, axis: str = "time", tie: str = "seq") -> dict:
    """Scan item with the order key of the first activating event of the trial."""
    return {"_on": first_of_all(F.when(activation(experiment), order_key(axis, [tie])))}


def is_active(axis: str = "time", tie: str = "seq") -> Column:
    return F.coalesce(order_key(axis, [tie]) >= F.col("_on"), F.lit(False))


def stimulus_active(events: DataFrame, experiment: str, axis: str = "time", tie: str = "seq") -> DataFrame:
    """False before the first activating event of the trial, true from it on."""
    key = order_key(axis, [tie])
    return (attach(events, S.trial_of(events), _on=F.min(F.when(activation(experiment), key)))
            .withColumn("stimulus_active", is_active(axis, tie)).drop("_on"))


def onset_items(time: Column, elapsed: Column) -> dict:
    """Scan items for the onset time: the first white event, the first variable-data event."""
    return {"_white": first_of_all(F.when(F.col("colour") == S.WHITE, F.struct(time.alias("t")))),
            "_elapsed": first_of_all(F.when(F.col("event") == "TRIAL_VAR_DATA", F.struct(elapsed.alias("s"))))}


def onset_time() -> Column:
    """Red events move to white time + elapsed seconds, when both are known."""
    onset = (F.col("_white.t") + 1000 * F.col("_elapsed.s")).cast("bigint")
    return F.when(F.col("colour") == S.RED, F.coalesce(onset, F.col("time"))).otherwise(F.col("time"))


def stimulus_onset(events: DataFrame, axis: str = "time", tie: str = "seq") -> DataFrame:
    key = order_key(axis, [tie])
    data = F.col("event") == "TRIAL_VAR_DATA"
    return (attach(events, S.trial_of(events),
                   _white=F.min_by(F.struct(F.col("time").alias("t")), F.when(F.col("colour") == S.WHITE, key)),
                   _elapsed=F.min_by(F.struct(F.col("time_elapsed").alias("s")), F.when(data, key)))
            .withColumn("time", onset_time()).drop("_white", "_elapsed"))
