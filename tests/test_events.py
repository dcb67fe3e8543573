"""Validity rules, blink removal, joins and label rules on hand-made and random trials."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions import scalars as C
from saccadia.operators import blinks, clean, event_features, fills, joins
from saccadia.plans.preprocess import preprocess_events


def event_rows(spark, rows):
    columns = ["seq", "participant_id", "trial_id", "time", "event", "eye", "colour", "start_time", "end_time"]
    full = [tuple(r) + (None,) * (len(columns) - len(r)) for r in rows]
    return spark.createDataFrame(full, "seq long, participant_id long, trial_id long, time long, event string, eye string, "
                                       "colour string, start_time double, end_time double")


def trial(p, t, extra=(), drop=()):
    rows = [(0, "TRIALID", None), (1, "START", None), *extra, (90, "END", None), (91, "TRIAL_VAR_DATA", None)]
    return [(p * 1000 + t * 100 + i, p, t, at, event, None, colour) for i, (at, event, colour) in enumerate(rows) if event not in drop]


def test_clean_rules(spark):
    pair = [(10, "FIXPOINT", S.WHITE), (20, "FIXPOINT", S.RED)]
    rows = (trial(1, 1, pair) + trial(1, 2, pair, drop=("START",)) + trial(1, 3, pair + [(30, "FIXPOINT", S.RED)])
            + trial(1, 4, pair + [(95, "END", None)]) + trial(87, 1, pair))
    events = event_rows(spark, rows).withColumn("marks", F.lit(None).cast("string"))
    kept = {(r[0], r[1]) for r in clean.clean_events(events, "REACTION").select(*S.TRIAL).distinct().collect()}
    assert kept == {(1, 1)}
    gone = {(r[0], r[1]) for r in clean.removed_trials(events, clean.clean_events(events, "REACTION")).collect()}
    assert gone == {(1, 2), (1, 3), (1, 4), (87, 1)}


def test_blue_filter_keeps_unknown_colour(spark):
    events = event_rows(spark, [(1, 1, 1, 1, "FIXPOINT", None, None), (2, 1, 1, 2, "FIXPOINT", None, S.BLUE)])
    assert [r["seq"] for r in clean.keep_rows(events, "EVIL_BASTARD").collect()] == [1]
    assert clean.keep_rows(events, "SHAPES").count() == 2


def sequential_blinks(events):
    """The same removal as a walk over the trial."""
    kept, i = [], 0
    while i < len(events):
        if events[i] != "SSACC":
            kept.append(i)
            i += 1
            continue
        close = next((j for j in range(i + 1, len(events)) if events[j] == "ESACC"), None)
        if close is None:
            i += 1
            continue
        inside = events[i + 1:close]
        if not ("SBLINK" in inside and "EBLINK" in inside):
            kept.extend(range(i, close + 1))
        i = close + 1
    return [i for i in kept if events[i] not in ("SBLINK", "EBLINK", "SFIX", "SSACC")]


@pytest.mark.parametrize("width", [3, 1000])
def test_blink_removal_matches_a_walk(spark, width):
    rng = np.random.default_rng(5)
    kinds = ["SSACC", "ESACC", "SBLINK", "EBLINK", "EFIX", "SFIX"]
    rows, want = [], set()
    for t in range(300):
        events = list(rng.choice(kinds, rng.integers(1, 15)))
        rows += [(t * 100 + i, 1, t, i, e) for i, e in enumerate(events)]
        want |= {t * 100 + i for i in sequential_blinks(events)}
    got = blinks.drop_blink_saccades(event_rows(spark, rows), width=width)
    assert {r["seq"] for r in got.select("seq").collect()} == want


def test_blink_overlap_mode(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        start = int(rng.integers(0, 500))
        rows.append((i, 1, i % 4, None, ["ESACC", "EBLINK", "EFIX"][i % 3], "LR"[i % 2], None, float(start),
                     float(start + rng.integers(0, 8))))
    blinked = {r[0] for r in rows if r[4] == "ESACC" and any(
        b[4] == "EBLINK" and b[2] == r[2] and b[5] == r[5] and b[7] <= r[8] and b[8] >= r[7] for b in rows)}
    got = {r["seq"] for r in blinks.drop_blink_saccades(event_rows(spark, rows), mode="overlap", width=10).select("seq").collect()}
    assert blinked and got == {r[0] for r in rows if r[4] != "EBLINK"} - blinked


@pytest.mark.parametrize("direction,tolerance", [("backward", None), ("nearest", 10), ("nearest", None)])
def test_asof_matches_pandas(spark, direction, tolerance):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"participant_id": rng.integers(0, 4, 500), "time": rng.integers(0, 400, 500), "seq": np.arange(500)})
    right = pd.DataFrame({"participant_id": rng.integers(0, 4, 60), "time": rng.integers(0, 400, 60), "seq": np.arange(60)})
    right = right.drop_duplicates(["participant_id", "time"]).assign(v=lambda d: d["seq"] * 1.5)
    got = joins.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["participant_id"], ["v"],
                     direction=direction, tolerance=tolerance, width=13).toPandas().sort_values("seq")
    want = pd.merge_asof(left.sort_values("time", kind="stable"), right.drop(columns="seq").sort_values("time", kind="stable"),
                         on="time", by="participant_id", direction=direction, tolerance=tolerance).sort_values("seq")
    np.testing.assert_allclose(got["v"], want["v"])


def test_asof_tie_goes_backward(spark):
    left = spark.createDataFrame([(1, 5, 0)], "participant_id long, time long, seq long")
    right = spark.createDataFrame([(1, 0, 0, 0.0), (1, 10, 1, 10.0)], "participant_id long, time long, seq long, v double")
    assert joins.asof(left, right, ["participant_id"], ["v"], direction="nearest", tolerance=10).first()["v"] == 0.0


def test_assign_trials_with_overlap(spark):
    rng = np.random.default_rng(4)
    spans = [(1, t, int(s), int(s + rng.integers(0, 200))) for t, s in enumerate(rng.integers(0, 1000, 12))]
    points = [(1, i, int(x)) for i, x in enumerate(rng.integers(-50, 1300, 300))]
    got = joins.assign_trials(spark.createDataFrame(points, "participant_id long, seq long, time long"),
                              spark.createDataFrame(spans, "participant_id long, trial_id long, start_time long, end_time long"),
                              width=50)
    want = {}
    for _, i, x in points:
        hits = [t for _, t, s, e in spans if s <= x <= e]
        if hits:
            want[i] = max(hits)
    assert {r["seq"]: r["trial_id"] for r in got.collect()} == want


def test_ordinal_trials(spark):
    events = event_rows(spark, [(1, 1, 5, 10, "START"), (2, 1, 5, 20, "END"), (3, 1, 9, 30, "START"), (4, 1, 9, 40, "END")])
    assert sorted(tuple(r) for r in joins.trial_intervals(events, "ordinal").select("trial_id", "start_time", "end_time").collect()) == [
        (0, 10, 20), (1, 30, 40)]


def test_guarded_numbers_and_clip(spark):
    tokens = spark.createDataFrame([(t,) for t in ("-12.3", "1e5", ".", "12.", "7")], "t string")
    assert [r[0] for r in tokens.select(C.plain_decimal(F.col("t"))).collect()] == [None, None, None, 12.0, 7.0]
    assert [r[0] for r in tokens.select(C.whole_number(F.col("t"))).collect()] == [None, None, None, None, 7.0]
    values = spark.createDataFrame([(None,), (-5.0,), (2000.0,)], "x double")
    assert [r[0] for r in values.select(C.clip(F.col("x"), 0, 1920)).collect()] == [None, 0.0, 1920.0]


def test_zero_duration_gives_no_rate(spark):
    rows = event_rows(spark, [(1, 1, 1, 100, "FIXPOINT"), (2, 1, 1, 100, "EFIX", "L")]).withColumns(
        {"stimulus_active": F.lit(True), "experiment": F.lit("SHAPES")})
    assert event_features.event_rate(rows, "EFIX", "rate").first()["rate"] is None


def test_overshoot_needs_a_target(spark):
    columns = ["seq", "trial_id", "time", "event", "eye", "x", "y", "stimulus_x", "stimulus_y"]
    rows = [(1, 1, 10, "FIXPOINT", None, None, None, 0.0, 0.0), (2, 1, 20, "FIXPOINT", None, None, None, 100.0, 0.0),
            (3, 1, 30, "EFIX", "L", 3.0, 4.0, None, None), (4, 1, 40, "EFIX", "R", 100.0, 9.0, None, None),
            (5, 2, 30, "EFIX", "L", 3.0, 4.0, None, None)]
    df = spark.createDataFrame(rows, "seq long, trial_id long, time long, event string, eye string, x double, y double, "
                                     "stimulus_x double, stimulus_y double").select(*columns).withColumns(
        {"stimulus_active": F.lit(True), "experiment": F.lit("FITTS_LAW"), "participant_id": F.lit(1)})
    r = event_features.fixation_overshoot(df).first()
    assert r["fixation_overshoot_mean"] == 7.0 and r["fixation_overshoot_std"] is None


def test_stimulus_onset_reorders_antisaccade(spark):
    rows = [(0, "TRIALID"), (5, "START"), (10, "FIXPOINT"), (12, "FIXPOINT"), (500, "ESACC"), (1500, "ESACC"), (3000, "END"),
            (3001, "TRIAL_VAR_DATA")]
    data = []
    for i, (at, e) in enumerate(rows):
        colour = {10: S.WHITE, 12: S.RED}.get(at)
        data.append((i, 1, 1, None if e == "ESACC" else at, e, "L" if e == "ESACC" else None, colour,
                     float(at) if e == "ESACC" else None, float(at + 10) if e == "ESACC" else None))
    events = event_rows(spark, data).withColumns({
        "experiment": F.lit("ANTI_SACCADE"), "side": F.when(F.col("event") == "TRIAL_VAR_DATA", "left"),
        "time_elapsed": F.when(F.col("event") == "TRIAL_VAR_DATA", F.lit(1.0)), "delay": F.lit(None).cast("double"),
        "stimulus_x": F.lit(None).cast("double"), "stimulus_y": F.lit(None).cast("double"),
        "marks": F.lit(None).cast("string")})
    done = {r["seq"]: r for r in preprocess_events(events, "ANTI_SACCADE", validate=True).collect()}
    assert 0 not in done and done[3]["time"] == 1005 and done[1]["time"] == 0  # red moved to 10 + 1000, clock starts at START
    assert done[4]["stimulus_active"] is False and done[5]["stimulus_active"] is True
    assert {r["side"] for r in done.values()} == {"left"}
    assert done[4]["colour"] == S.WHITE and done[5]["colour"] == S.RED


def test_preprocessing_after_cleaning_equals_the_fused_form(spark, sf):
    from workload import inputs

    raw = inputs.gaze_events(spark, sf, "SMOOTH_PURSUITS")
    one = preprocess_events(raw, "SMOOTH_PURSUITS", width=inputs.CHUNK, validate=True)
    two = preprocess_events(clean.clean_events(raw, "SMOOTH_PURSUITS"), "SMOOTH_PURSUITS", width=inputs.CHUNK)
    columns = one.columns
    assert one.exceptAll(two.select(*columns)).count() == 0 and one.count() == two.count()


def test_asof_without_a_time_matches_nothing(spark):
    right = spark.createDataFrame([(1, 100, 1, "r")], "k long, time long, seq long, v string")
    left = spark.createDataFrame([(1, None, 2), (1, 150, 3)], "k long, time long, seq long")
    for direction in ("backward", "nearest"):
        got = {r["seq"]: r["v"] for r in joins.asof(left, right, ["k"], ["v"], direction=direction).collect()}
        assert got == {2: None, 3: "r"}


def test_equal_trial_ids_of_two_experiments_stay_apart(spark):
    rows = [(e, 1, 1, t, s, "FIXPOINT" if c else "START", c) for e, t, s, c in
            (("SHAPES", 1, 1, "255 0 0"), ("SHAPES", 2, 2, None), ("REACTION", 1, 3, None), ("REACTION", 3, 4, "0 0 255"), ("REACTION", 9, 5, None))]
    events = spark.createDataFrame(rows, "experiment string, participant_id long, trial_id long, time long, seq long, event string, colour string")
    got = {r["seq"]: r["colour"] for r in fills.fill(events, ["colour"]).collect()}
    assert got == {1: "255 0 0", 2: "255 0 0", 3: None, 4: "0 0 255", 5: "0 0 255"}
