"""Chunked scans against pandas on random series, with chunks far smaller than a series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saccadia.operators import scan as sc
from saccadia.operators.describe import exact_medians, five_stats
from saccadia.operators.fills import fill
from saccadia.operators.sample_features import moving_average


def series(seed: int, n: int = 600) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "time": rng.integers(0, 300, n).astype(float), "seq": np.arange(n),
        "v": np.where(rng.random(n) < 0.3, rng.integers(0, 50, n), np.nan)})
    df.loc[rng.random(n) < 0.03, "time"] = np.nan
    return df


def to_spark(spark, df: pd.DataFrame):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, time double, seq long, v double")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_items_match_pandas(spark, width):
    pdf = series(width)
    items = {
        "f": sc.last(F.col("v")), "b": sc.following(F.col("v")), "p": sc.previous(F.col("v")),
        "n": sc.sum_before(F.lit(1)), "s": sc.sum_before(F.coalesce("v", F.lit(0.0))),
        "m": sc.running_max(F.col("v")), "t": sc.total(F.min, F.col("v")),
        "first": sc.first_of_all(F.col("v")), "final": sc.last_of_all(F.col("v"))}
    got = sc.scan(to_spark(spark, pdf), ["k"], "time", ["seq"], items, width=width).toPandas()
    want = pdf.sort_values(["k", "time", "seq"], na_position="last")
    g = want.groupby("k")["v"]
    want = want.assign(f=g.ffill(), b=g.bfill(), p=g.shift(1), n=want.groupby("k").cumcount(),
                       s=g.transform(lambda x: x.fillna(0).cumsum().shift(1).fillna(0)),
                       m=g.transform(lambda x: x.cummax().ffill()), t=g.transform("min"), first=g.transform("first"),
                       final=g.transform("last"))
    got = got.sort_values("seq").reset_index(drop=True)
    want = want.sort_values("seq").reset_index(drop=True)
    for c in items:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_one_key_spreads_over_chunks(spark, broadcast):
    key = F.when(F.col("id") >= 0, "hot").alias("k")
    df = spark.range(10_000).select(key, F.col("id").alias("time"), F.col("id").alias("seq"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        done = sc.scan(df, ["k"], "time", ["seq"], {"n": sc.sum_before(F.lit(1)), "t": sc.total(F.max, F.col("time"))}, width=100)
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 10_000 and max(sizes) < 6_000


def test_fill_does_not_leak_into_an_empty_trial(spark):
    rows = [(1, 1, 10, 1, "a"), (1, 1, 20, 2, None), (1, 2, 10, 3, None), (1, 2, 20, 4, None), (1, 3, 10, 5, None),
            (1, 3, 20, 6, "b")]
    df = spark.createDataFrame(rows, "participant_id long, trial_id long, time long, seq long, shape string")
    own = {r["seq"]: r["shape"] for r in fill(df, ["shape"], "backward_forward").collect()}
    assert own == {1: "a", 2: "a", 3: None, 4: None, 5: "b", 6: "b"}
    across = {r["seq"]: r["shape"] for r in fill(df, ["shape"], "backward_forward", scope="global").collect()}
    assert across == {1: "a", 2: "a", 3: "a", 4: "a", 5: "b", 6: "b"}


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_moving_average_crosses_chunks(spark, width):
    pdf = series(3).dropna(subset=["time"]).assign(v=lambda d: np.arange(len(d)) % 17.0)
    got = moving_average(to_spark(spark, pdf), ["k"], "time", ["seq"], ["v"], 5, width=width).toPandas().sort_values("seq")
    want = pdf.sort_values(["k", "time", "seq"])
    want["v_avg"] = want.groupby("k")["v"].transform(lambda x: x.rolling(5, min_periods=1).mean())
    np.testing.assert_allclose(got["v_avg"], want.sort_values("seq")["v_avg"])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 4999, 30_000])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.gamma(2.0, 10.0, n), 3)
    values[: n // 3] = values[0]
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(n) % 5 == 0, "b", "a"), "v": values}))
    got = {r["k"]: r["v_median"] for r in exact_medians(df, ["k"], {"v": F.col("v")}).collect()}
    want = pd.DataFrame({"k": np.where(np.arange(n) % 5 == 0, "b", "a"), "v": values}).groupby("k")["v"].median()
    assert got == pytest.approx(want.to_dict())


def test_five_stats_names_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    rows = {r["k"]: r.asDict() for r in five_stats(df, ["k"], {("v", "fix"): F.col("v")}).collect()}
    assert rows["a"] == {"k": "a", "v_mean_fix": 1.0, "v_min_fix": 1.0, "v_max_fix": 1.0, "v_median_fix": 1.0, "v_std_fix": None}
    assert all(v is None for k, v in rows["b"].items() if k != "k")


@pytest.mark.parametrize("name,times", [("ffill", 1), ("drop_blink_saccades", 1), ("stimulus_onset", 0), *[
    (f"prep_{e}", 2 if e == "anti_saccade" else 1) for e in
    ("anti_saccade", "evil_bastard", "reaction", "fitts_law", "king_devick", "shapes", "smooth_pursuits", "fixations")]])
def test_rows_are_shuffled_once(spark, sf, name, times):
    from workload import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.SPARK[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [line for line in plan if "Exchange hashpartitioning(_scan_hash" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == times
    assert sum("ReusedExchange" in line for line in dealt) == times
    assert sum("FileScan" in line for line in plan) <= 1 or not times


@pytest.mark.parametrize("width", [2, 9, 1000])
def test_segments_match_a_walk(spark, width):
    rng = np.random.default_rng(6)
    rows = [(k, float(t), t, bool(rng.random() < 0.15), None if rng.random() < 0.3 else int(rng.integers(0, 99))) for k in "ab" for t in range(200)]
    df = spark.createDataFrame(rows, "k string, time double, seq long, ends boolean, v int")
    segments = sc.Segments(F.col("ends"), {"low": (F.min, F.col("v")), "high": (F.max, F.col("v")), "closed": (F.max, F.when(F.col("ends"), 1))})
    got = {(r["k"], r["seq"]): (r["low"], r["high"], r["closed"]) for r in sc.scan(df, ["k"], "time", ["seq"], {}, width=width, segments=segments).collect()}
    want, stretch = {}, []
    for i, (k, _, t, ends, v) in enumerate(rows):
        stretch.append((k, t, v))
        if ends or i + 1 == len(rows) or rows[i + 1][0] != k:
            known = [x for _, _, x in stretch if x is not None]
            for a, b, _ in stretch:
                want[a, b] = (min(known, default=None), max(known, default=None), 1 if ends else None)
            stretch = []
    assert got == want


def test_scan_rows_stay_in_all_partitions_of_the_session(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(200).select(F.col("id").alias("seq"), (F.col("id") % 40).alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    assert sc.scan(rows, ["k"], "t", ["seq"], {"a": sc.last(F.col("v"))}).rdd.getNumPartitions() == n
    assert moving_average(rows, ["k"], "t", ["seq"], ["v"]).rdd.getNumPartitions() == n


def test_values_of_a_median_do_not_carry_the_other_statistics(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("a"))
    plan = five_stats(rows, ["k"], {"a": F.col("a")})._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counted = [line for line in plan if "Aggregate" in line and "_count" in line]
    assert counted and not any("a_mean" in line for line in counted)
