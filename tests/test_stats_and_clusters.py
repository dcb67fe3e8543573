"""Tests and scores against brute force on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saccadia.operators import cluster, mixtures, matrix, stats
from saccadia.plans import selection
from workload import inputs, model_queries


def feature_frame(seed=0, n=80):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"participant_id": np.arange(n), "y": np.arange(n) % 2})
    df["a"] = rng.normal(0, 1, n) + df["y"]
    df["b"] = df["a"] * 2 + rng.normal(0, 0.05, n)
    df["c"] = np.round(rng.normal(0, 1, n), 1)
    df["d"] = rng.exponential(1, n)
    df.loc[rng.random(n) < 0.1, "c"] = np.nan
    df["e"] = 3.0
    return df


FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def frame(spark):
    pdf = feature_frame()
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "participant_id long, y long, a double, b double, c double, d double, e double")


def test_mann_whitney_counts_pairs(frame):
    pdf, df = frame
    got = {r["feature"]: r for r in stats.mann_whitney(matrix.long_view(df, FEATURES), parts=8).collect()}
    for f in FEATURES:
        x = pdf.loc[pdf["y"] == 0, f].dropna().to_numpy()
        y = pdf.loc[pdf["y"] == 1, f].dropna().to_numpy()
        u = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
        assert got[f]["U_value"] == pytest.approx(u)
        assert got[f]["std_control"] == pytest.approx(x.std())
    assert got["e"]["p_value"] is None or math.isnan(got["e"]["p_value"])
    assert 0 < got["a"]["p_value"] < 0.01


def test_t_test_p_values(spark):
    # Two samples with t = -2 and 8 degrees of freedom; two-sided p = 0.080516...
    x = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    rows = [(i, 0, "f", float(v)) for i, v in enumerate(x)] + [(i + 10, 1, "f", float(v + 2)) for i, v in enumerate(x)]
    r = stats.t_test(spark.createDataFrame(rows, "participant_id long, y long, feature string, value double")).first()
    assert (r["t_value"], r["df"]) == (pytest.approx(-2.0), 8) and r["p_value"] == pytest.approx(0.0805161, abs=1e-6)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r["feature"]: r["p_value_corrected"] for r in stats.benjamini_hochberg(df).collect()}
    assert [got[str(i)] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.8])


def test_correlation_and_greedy_drop(frame):
    pdf, df = frame
    got = {(r["f1"], r["f2"]): r["corr"] for r in stats.pairwise_correlation(df, FEATURES).collect()}
    want = pdf[FEATURES].corr()
    for (a, b), r in got.items():
        assert (r is None) == bool(np.isnan(want.loc[a, b])) and (r is None or r == pytest.approx(want.loc[a, b]))
    assert len(got) == 10
    # "b" comes after "a": it is dropped only when "a" is the stronger one; either way one of the pair may stay.
    strength = pdf[["a", "b"]].corrwith(pdf["y"]).abs()
    assert stats.collinear_features(df, FEATURES) == ["a"] and strength.notna().all()


def test_variance_and_outliers(frame):
    pdf, df = frame
    reduced, kept = stats.remove_low_variance(df, FEATURES)
    scaled = pdf[FEATURES].apply(lambda s: (s - s.min()) / (s.max() - s.min()))
    assert kept == [f for f in FEATURES if scaled[f].var(ddof=0) > 0.01]
    got = reduced.orderBy("participant_id").toPandas()
    np.testing.assert_allclose(got["d"], scaled["d"])
    marked = stats.remove_outliers(df, FEATURES, 3.0).orderBy("participant_id").toPandas()
    for f in FEATURES:
        med = pdf[f].median()
        mad = (pdf[f] - med).abs().median()
        out = ((pdf[f] - med).abs() > 3 * mad) & (mad > 0)
        np.testing.assert_allclose(marked[f].astype(float), pdf[f].mask(out))


def test_matrix_joins_and_filters(spark):
    a = spark.createDataFrame([("X", 1, 1.0), ("X", 2, 2.0)], "experiment string, participant_id long, f double")
    b = spark.createDataFrame([("Y", 2, 3.0), ("Y", 3, 4.0)], "experiment string, participant_id long, f double")
    rows = {r["participant_id"]: (r["X_f"], r["Y_f"]) for r in matrix.feature_matrix({"X": a, "Y": b}).collect()}
    assert rows == {1: (1.0, None), 2: (2.0, 3.0), 3: (None, 4.0)}
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, 5.0, 2.0)], "id long, p double, q double")
    assert matrix.drop_sparse_columns(df, 0.5).columns == ["id", "p", "q"]  # limit round(1.5) = 2
    assert matrix.drop_sparse_columns(df, 0.3).columns == ["id", "q"]
    assert matrix.drop_incomplete_columns(df).columns == ["id"]
    assert matrix.drop_sparse_rows(df, 0.34).count() == 2
    assert matrix.drop_empty_rows(df, ["p", "q"]).count() == 2


def cloud(n=70, d=3, seed=1):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 3, n)
    labels[0] = 3  # a cluster of one point
    return labels, rng.normal(0, 1, (n, d)) + labels[:, None]


@pytest.fixture(scope="module")
def points(spark):
    labels, x = cloud()
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(labels, x))]
    return labels, x, spark.createDataFrame(rows, "id long, cluster int, f0 double, f1 double, f2 double")


F3 = ["f0", "f1", "f2"]


def brute_silhouette(labels, d):
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("tile_rows", [16, 2048])
def test_silhouette_and_core_distance(points, tile_rows):
    labels, x, df = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = cluster.silhouette_points(df, F3, tile_rows=tile_rows).orderBy("id").toPandas()
    np.testing.assert_allclose(got["silhouette"], brute_silhouette(labels, d), atol=1e-9)
    core = cluster.core_distances(df, F3, 4, tile_rows=tile_rows).orderBy("id").toPandas()
    np.testing.assert_allclose(core["core_distance"], np.sort(d, axis=1)[:, 3])
    city = cluster.core_distances(df, F3, 2, metric="manhattan", tile_rows=tile_rows).orderBy("id").toPandas()
    np.testing.assert_allclose(city["core_distance"], np.sort(np.abs(x[:, None] - x[None]).sum(2), axis=1)[:, 1])


def test_squared_silhouette(points):
    labels, x, df = points
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert cluster.silhouette_squared(df, F3).first()[0] == pytest.approx(brute_silhouette(labels, d).mean())


def test_davies_bouldin_and_purity(points):
    labels, x, df = points
    centres = {c: x[labels == c].mean(0) for c in set(labels)}
    spread = {c: np.linalg.norm(x[labels == c] - m, axis=1).mean() for c, m in centres.items()}
    want = np.mean([max((spread[a] + spread[b]) / np.linalg.norm(centres[a] - centres[b]) for b in centres if b != a) for a in centres])
    assert cluster.davies_bouldin(df, F3).first()[0] == pytest.approx(want)
    y = df.withColumn("y", F.col("id") % 2)
    table = pd.crosstab(labels, np.arange(len(labels)) % 2)
    assert cluster.purity(y).first()[0] == pytest.approx(table.max(axis=1).sum() / len(labels))


def test_projections(points):
    labels, x, df = points
    scores, shares = cluster.principal_components(df, F3, 2)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    assert shares == pytest.approx(list(values[::-1][:2] / values.sum()))
    got = scores.orderBy("id").toPandas()
    np.testing.assert_allclose(np.abs(got["pc1"]), np.abs(centred @ vectors[:, -1]), atol=1e-8)
    two = df.withColumn("y", (F.col("cluster") >= 2).cast("int"))
    rows = cluster.discriminant_axis(two, F3)[0].toPandas()
    within = rows.groupby("y")["lda"].apply(lambda s: ((s - s.mean()) ** 2).sum()).sum() / (len(rows) - 2)
    means = rows.groupby("y")["lda"].mean()
    assert within == pytest.approx(1.0) and means[1] > means[0] and rows["lda"].mean() == pytest.approx(0, abs=1e-9)


def test_standardise_uses_the_fitted_rows(points):
    _, x, df = points
    got = cluster.standardise(df, F3, df.where("cluster = 1")).orderBy("id").toPandas()
    labels = points[0]
    ref = x[labels == 1]
    np.testing.assert_allclose(got[F3], (x - ref.mean(0)) / ref.std(0))


def test_best_per_k_and_feature_sets(spark):
    rows = spark.createDataFrame([(0, ["b", "a"], 2, 0.5), (1, ["a", "b"], 2, 0.5), (2, ["a", "c"], 2, 0.4), (3, ["a", "c"], 3, 0.1)],
                                 "position int, features array<string>, n_clusters int, silhouette double")
    best = cluster.best_per_k(rows)
    assert sorted(r["position"] for r in best.collect()) == [0, 1, 3]
    assert sorted(r["position"] for r in cluster.distinct_feature_sets(best).collect()) == [0, 3]


def test_search_picks_the_separating_features(spark):
    rng = np.random.default_rng(0)
    side = np.arange(60) % 2
    rows = [(i, float(10 * s + rng.normal()), float(8 * s + rng.normal()), float(rng.normal()), float(rng.normal())) for i, s in enumerate(side)]
    df = spark.createDataFrame(rows, "id long, a double, b double, u double, v double")
    best = cluster.brute_force(df, ["a", "b", "u", "v"], factory=cluster.k_means, low=2, high=3).first()
    assert sorted(best["features"]) == ["a", "b"] and best["n_clusters"] == 2
    grown = cluster.add_features(df, ["a", "b", "u"], [(["a", "u"], 2, 0.1)], factory=cluster.k_means).first()
    assert sorted(grown["features"]) == ["a", "b", "u"] and grown["silhouette"] > 0.1


def test_folds_are_stratified(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = cluster.stratified_folds(df, 4).toPandas()
    for _, g in got.groupby("y"):
        g = g.sort_values("id").reset_index(drop=True)
        assert list(g["fold"]) == [i * 4 // len(g) for i in range(len(g))]


def test_knee(spark):
    values = [1.0, 0.6, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04]
    rows = [("g", f"f{i:02d}", v) for i, v in enumerate(values)] + [("flat", f"f{i}", v) for i, v in enumerate([4.0, 3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "grp string, feature string, importance double")
    knees = {r["grp"]: r["knee"] for r in selection.knee_points(df).collect()}
    assert knees["g"] == 2
    assert selection.knee_cut(df).where("grp = 'g'").count() == 3


def test_forest_finds_the_signal(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(i % 2 * 5 + rng.normal()), float(rng.normal()) if i % 7 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "participant_id long, y int, SHAPES_a double, REACTION_b double")
    grid = {"maxDepth": [3], "numTrees": [5], "featureSubsetStrategy": ["sqrt"]}
    importance, best = selection.forest_importance(df, ["SHAPES_a", "REACTION_b"], True, experiments=["SHAPES", "REACTION"], grid=grid, folds=2)
    assert set(best) == {"SHAPES", "REACTION"}
    overall, _ = selection.forest_importance(df, ["SHAPES_a", "REACTION_b"], False, grid=grid, folds=2)
    values = {r["feature"]: r["importance"] for r in overall.collect()}
    assert values["SHAPES_a"] > values["REACTION_b"]
    accuracy, _ = selection.train_forest(df, ["SHAPES_a", "REACTION_b"], grid=grid, folds=2)
    assert accuracy > 0.8


def test_registered_forests_search_the_whole_grid(spark, sf, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def search(df, features, y, key, grid=None, folds=5, **more):
        asked.append((grid or selection.GRID, folds))
        raise Asked

    small = spark.createDataFrame([(i, i % 2, *[float(i * k % 7) for k in range(len(model_queries.FEATURES))]) for i in range(60)],
                                  "participant_id long, y int, " + ", ".join(f"{f} double" for f in model_queries.FEATURES))
    labels = small.selectExpr("participant_id", "2 as n_clusters", "y as cluster")
    monkeypatch.setattr(inputs, "user_features", lambda *a: small)
    monkeypatch.setattr(model_queries, "people", lambda *a: small)
    monkeypatch.setattr(cluster, "cluster_range", lambda *a, **k: (None, labels))
    monkeypatch.setattr(selection, "forest_search", search)
    monkeypatch.setattr(selection, "reduce_features", lambda df, features, y: (df, list(features)))
    for name in ("explain_clusters", "selected_features", "train_rf"):
        with pytest.raises(Asked):
            model_queries.SPARK[name](spark, sf)
    assert asked == [(selection.GRID, 5), (selection.GRID, 5), (selection.TRAIN_GRID, 5)]


def test_registered_growth_has_six_rounds(monkeypatch):
    asked = []
    monkeypatch.setattr(model_queries, "people", lambda *a: None)
    monkeypatch.setattr(cluster, "tune", lambda *a, patience=0, **k: asked.append(patience))
    model_queries.SPARK["forward_features"](None, None)
    assert asked == [5]


def test_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    train, test = cluster.split_rows(df, "k", 0.2)
    again = cluster.split_rows(df.repartition(7), "k", 0.2)[1]
    assert test.count() + train.count() == 2000 and 300 < test.count() < 500
    assert test.exceptAll(again).count() == 0


def test_mixtures_of_a_search_share_their_passes(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(0, 1, (120, 3)), rng.normal(6, 1, (80, 3))))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(3)
    points, models = mixtures.fit(df, ["a", "b", "c"], [(["a", "b"], 2), (["c"], 3), (["a", "b", "c"], 2)])
    scores = mixtures.squared_silhouettes(points, models)
    for m, (n, s) in zip(models, scores):
        names = [["a", "b", "c"][i] for i in m.columns]
        label = m.log_densities(x).argmax(1)
        marked = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(label, x))], "id long, cluster int, a double, b double, c double")
        assert n == len(set(label)) and s == pytest.approx(cluster.silhouette_squared(marked, names).first()[0])
        assert m.weights.sum() == pytest.approx(1)
    assert np.allclose(sorted(models[2].weights), [0.4, 0.6], atol=0.02)
    assert np.allclose(sorted(models[2].means[:, 0]), [0, 6], atol=0.4)
    points.unpersist()


def test_search_over_mixtures_finds_the_groups(spark):
    rng = np.random.default_rng(9)
    group = np.arange(150) % 2
    rows = [(i, float(rng.normal(9 * g)), float(rng.normal(9 * g)), float(rng.normal())) for i, g in enumerate(group)]
    df = spark.createDataFrame(rows, "id long, a double, b double, u double")
    best = {r["n_clusters"]: r["features"] for r in cluster.brute_force(df, ["a", "b", "u"], low=2, high=4).collect()}
    assert set(best[2]) == {"a", "b"}
    assert cluster.tune(df, ["a", "b", "u"], low=2, high=3).first()["n_features"] >= 2


def test_distances_write_the_points_once_not_once_per_tile(points):
    _, _, df = points
    for got in (cluster.core_distances(df, F3, 4, tile_rows=7), cluster.silhouette_points(df, F3, tile_rows=7)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "explode" not in plan


def test_core_distances_of_repeated_points_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(6, 3)) * 1e4, 5, axis=0), rng.normal(size=(40, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *F3])
    for tile_rows in (5, 100):
        got = cluster.core_distances(df, F3, 7, tile_rows=tile_rows).orderBy("id").toPandas()
        np.testing.assert_allclose(got["core_distance"], np.sort(d, axis=1)[:, 6], atol=1e-9)
    same = cluster.core_distances(df.withColumn("id", F.lit(1)), F3, 3).collect()
    assert [(r["id"], r["core_distance"]) for r in same] == [(1, 0.0)]
    few = cluster.core_distances(df.limit(2), F3, 3).collect()
    assert [r["core_distance"] for r in few] == [None, None]
    gaps = cluster.core_distances(df.withColumn("f1", F.when(F.col("id") != 2, F.col("f1"))), F3, 3, tile_rows=5)
    assert [r["id"] for r in gaps.where("core_distance is null or isnan(core_distance)").collect()] == [2]
    assert gaps.where("isnan(core_distance)").count() == 0


def test_passes_of_a_search_lie_in_few_tasks(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (90, 2)) + 1000.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(12)
    points, (one, two) = mixtures.fit(df, ["a", "b"], [(["a", "b"], 1), (["b"], 2)])
    assert points.rdd.getNumPartitions() == 1 and points.count() == 90
    off = x - one.means[0]
    want = -np.einsum("ni,ij,nj->n", off, np.linalg.inv(one.covariances[0]), off) / 2 - np.log(np.linalg.det(2 * np.pi * one.covariances[0])) / 2
    assert np.allclose(one.log_densities(x)[:, 0], want) and np.allclose(one.means[0], x.mean(0))
    assert two.log_densities(x).shape == (90, 2) and two.weights.sum() == pytest.approx(1)
    points.unpersist()


def test_growth_reads_its_points_once(spark, monkeypatch):
    rows = [(i, float(9 * (i % 2) + i % 5), float(9 * (i % 2) + i % 3), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, u double")
    staged, fitted = [], []
    real, fit = cluster.stage, mixtures.fit
    monkeypatch.setattr(cluster, "stage", lambda df, name: staged.append(real(df, name)) or staged[-1])
    monkeypatch.setattr(mixtures, "fit", lambda df, *a, **k: fitted.append(df) or fit(df, *a, **k))
    assert cluster.tune(df, ["a", "b", "u"], low=2, high=3, patience=1).count() == 1
    assert len(staged) == 1 and len(fitted) == 2 and all(f is staged[0] for f in fitted)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_core_distances_do_not_depend_on_single_precision(spark, metric):
    """Far from zero, closer together than single precision can tell, huge, infinite or missing."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(160, 3))
    x[:60] = x[:60] * 1e-5 + 1e6
    x[60:90] *= [1, 1e-6, 1e4]
    x[90:94] *= 1e18
    x[94, 1], x[95, 2] = np.inf, np.nan
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["id", *F3])
    with np.errstate(invalid="ignore"):
        off = x[:, None] - x[None]
        d = np.sort(np.abs(off).sum(2) if metric == "manhattan" else np.sqrt((off ** 2).sum(2)), axis=1)[:, 4]
    for tile_rows in (16, 64, 500):
        got = cluster.core_distances(df, F3, 5, metric=metric, tile_rows=tile_rows).orderBy("id").toPandas()["core_distance"]
        np.testing.assert_allclose(got.to_numpy(float), d, rtol=1e-12)
