"""Clustering of feature rows and scores of a clustering.

Rows are points (an id column, feature columns, a ``cluster`` column where one is needed) without missing values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.operators import mixtures
from saccadia.operators.scan import scan, sum_before
from saccadia.operators.stats import co_moments, value_chunks
from saccadia.session import stage

TILE_ROWS = 2048
#: Points whose tiles a task meets, at most.
PART_ROWS = 1 << 16
#: Pairs of points measured directly at a time.
PAIRS_AT_ONCE = 1 << 15

# --- scaling and projection ------------------------------------------------------------------------------------------

def standardise(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(value - mean) / population std of the rows of ``fit_on``; a constant feature is only centred."""
    source = df if fit_on is None else fit_on
    stats = source.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                       *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return df.withColumns({f: (F.col(f) - F.lit(stats[f"m_{f}"])) / F.lit(stats[f"s_{f}"] or 1.0) for f in features})


def assemble(df: DataFrame, features: Sequence[str], to: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=to).transform(df)


def principal_components(df: DataFrame, features: Sequence[str], n: float = 2, prefix: str = "pc") -> tuple[DataFrame, list[float]]:
    """Scores on the first ``n`` components of the centred features and their shares of the variance.

    A fraction ``n`` below 1 asks for as many components as explain that share.
    """
    features = list(features)
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = assemble(df.withColumns({f: F.col(f) - F.lit(means[f]) for f in features}), features)
    k = len(features) if n < 1 else int(n)
    model = PCA(k=k, inputCol="_features", outputCol="_pc").fit(centred)
    shares = [float(v) for v in model.explainedVariance]
    if n < 1:
        k = next((i for i, s in enumerate(np.cumsum(shares), 1) if s > n), len(features))
    scores = model.transform(centred).withColumn("_pc", vector_to_array("_pc"))
    names = [c for c in df.columns if c not in features]
    return scores.select(*names, *[F.col("_pc")[i].alias(f"{prefix}{i + 1}") for i in range(k)]), shares[:k]


def discriminant_axis(df: DataFrame, features: Sequence[str], y: str = "y") -> tuple[DataFrame, dict[str, float]]:
    """Projection on the axis that separates two classes best, with within-class variance 1.

    Class means and the pooled scatter come from Spark; the driver solves one p x p system.
    """
    features = list(features)
    means = {r[y]: r for r in df.groupBy(y).agg(F.count("*").alias("_n"), *[F.avg(f).alias(f) for f in features]).limit(3).collect()}
    if len(means) != 2:
        raise ValueError("two classes are needed")
    low, high = (means[k] for k in sorted(means))
    inside = df.withColumns({f: F.col(f) - F.when(F.col(y) == low[y], low[f]).otherwise(high[f]) for f in features})
    rows = co_moments(inside, features).collect()
    at = {f: i for i, f in enumerate(features)}
    scatter = np.zeros((len(features), len(features)))
    for r in rows:
        i, j = at[r["f1"]], at[r["f2"]]
        scatter[i, j] = scatter[j, i] = r["c"]
    pooled = scatter / (low["_n"] + high["_n"] - 2)
    gap = np.array([high[f] - low[f] for f in features])
    axis = np.linalg.pinv(pooled) @ gap
    axis = axis / math.sqrt(axis @ pooled @ axis)
    n = low["_n"] + high["_n"]
    centre = sum(w * (low["_n"] * low[f] + high["_n"] * high[f]) / n for w, f in zip(axis, features))
    weights = {f: float(w) for f, w in zip(features, axis)}
    score = sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0)) - F.lit(float(centre))
    return df.withColumn("lda", score), weights


# --- distances over tiles --------------------------------------------------------------------------------------------

def _tile_pairs(points: DataFrame, key: str, features: Sequence[str], cluster: Column, tile_rows: int) -> DataFrame:
    """Every tile beside every tile, the pairs of a left one in a row.

    Tiles hold about ``tile_rows`` points by a hash of the id, so no key decides their size. The product of the two sides reads
    partitions of packed tiles again and again instead of sending copies: what is written grows with the points alone.
    """
    n = points.count()
    n_tiles = max(1, math.ceil(n / tile_rows))
    tile = F.pmod(F.xxhash64(key), F.lit(n_tiles)).cast("int")
    row = F.struct(F.col(key).alias("id"), cluster.cast("int").alias("cluster"),
                   F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    packed = points.groupBy(tile.alias("tile")).agg(F.collect_list(row).alias("rows"))
    tiles = packed.select("tile", F.col("rows.id").alias("ids"), F.col("rows.cluster").alias("clusters"),
                          F.flatten("rows.v").alias("values"))
    # A task meets the right tiles of one part: few parts, because each gives sums or distances of every point.
    parts = min(n_tiles, math.ceil(n / PART_ROWS) or 1)
    groups = min(n_tiles, max(parts, math.ceil(3 * points.sparkSession.sparkContext.defaultParallelism / parts)))
    left = tiles.repartitionById(groups, F.pmod("tile", F.lit(groups)))
    right = tiles.select(F.col("tile").alias("other"), F.col("clusters").alias("other_clusters"), F.col("values").alias("other_values"))
    return left.hint("shuffle_replicate_nl").crossJoin(right.repartitionById(parts, F.pmod("other", F.lit(parts))))


def _each_tile(begin: Callable, width: int) -> Callable:
    """A function for mapInArrow over pairs of tiles; ``begin(points, ids, clusters)`` gives (meet, result) of a left tile."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = meet = result = None
        for batch in batches:
            tile, ids, clusters, values, others, other_values = (
                batch.column(c) for c in ("tile", "ids", "clusters", "values", "other_clusters", "other_values"))
            for i in range(batch.num_rows):
                if at != tile[i].as_py():
                    if result:
                        yield from result()
                    at = tile[i].as_py()
                    meet, result = begin(values[i].values.to_numpy(zero_copy_only=False).reshape(-1, width), ids[i].values, clusters[i].values)
                meet(other_values[i].values.to_numpy(zero_copy_only=False).reshape(-1, width), others[i].values)
        if result:
            yield from result()

    return run


def silhouette_points(points: DataFrame, features: Sequence[str], key: str = "id", cluster: str = "cluster",
                      tile_rows: int = TILE_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of every point; 0 for a point alone in its cluster.

    A tile adds up its distances per point and cluster over all tiles that it meets in a task; only those sums leave the task.
    The work is quadratic in the number of points, as the score itself is; see ``silhouette_squared`` for a linear one.
    """
    width, pairs = len(features), PAIRS_AT_ONCE

    def begin(a: np.ndarray, ids: pa.Array, own: pa.Array):
        length, total, size = (a * a).sum(1), {}, {}

        def meet(b: np.ndarray, others: pa.Array) -> None:
            scale = length[:, None] + (b * b).sum(1)[None, :]
            square = scale - 2 * a @ b.T
            distances = np.sqrt(np.maximum(square, 0))
            i, j = np.nonzero(square < 1e-6 * scale)  # cancellation: measure close pairs directly
            for at in range(0, len(i), pairs):
                p, q = i[at:at + pairs], j[at:at + pairs]
                distances[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(1))
            names, of = np.unique(others.to_numpy(zero_copy_only=False), return_inverse=True)
            sums = distances @ np.eye(len(names))[of]
            for c, s, n in zip(names, sums.T, np.bincount(of)):
                total[int(c)] = total[int(c)] + s if int(c) in total else s
                size[int(c)] = size.get(int(c), 0) + int(n)

        def result() -> Iterator[pa.RecordBatch]:
            for c, s in total.items():
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(np.full(len(a), c, np.int32)), pa.array(s), pa.array(np.full(len(a), size[c]))],
                                                 ["id", "cluster", "other", "total", "n"])

        return meet, result

    kind = dict(points.dtypes)[key]
    parts = _tile_pairs(points, key, features, F.col(cluster), tile_rows).mapInArrow(
        _each_tile(begin, width), f"id {kind}, cluster int, other int, total double, n long")
    means = parts.groupBy("id", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("cluster")
    each = means.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    score = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.select(F.col("id").alias(key), F.col("cluster").alias(cluster), score.alias("silhouette"))


def silhouette(points: DataFrame, features: Sequence[str], key: str = "id", cluster: str = "cluster",
               tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean silhouette, NULL for a single cluster."""
    scored = silhouette_points(points, features, key, cluster, tile_rows)
    several = F.min(cluster) != F.max(cluster)
    return scored.agg(F.when(several, F.avg("silhouette")).alias("silhouette"))


def mean_silhouette(points: DataFrame, features: Sequence[str], key: str = "id", score: str = "squared") -> DataFrame:
    """Mean silhouette: ``squared`` is linear in the number of points, ``exact`` compares all of them."""
    if score not in ("squared", "exact"):
        raise ValueError(f"unknown score {score!r}")
    return (silhouette_squared if score == "squared" else silhouette)(points, features, key)


def silhouette_squared(points: DataFrame, features: Sequence[str], key: str = "id", cluster: str = "cluster") -> DataFrame:
    """Silhouette on squared Euclidean distances, linear in the number of points.

    The mean squared distance of a point to a cluster follows from the cluster's centre and spread alone.
    """
    square = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    moments = points.groupBy(F.col(cluster).alias("c")).agg(
        F.count("*").alias("n"), F.avg(square).alias("q"), F.array(*[F.avg(f) for f in features]).alias("m"))
    clusters = moments.agg(F.collect_list(F.struct("c", "n", "q", "m")).alias("_all"))  # one entry per cluster
    rows = points.select(key, F.col(cluster).alias("_c"), square.alias("_sq"), F.array(*features).alias("_v"), F.lit(0).alias("_j"))
    # One row with k entries, however many points there are.
    with_all = rows.join(F.broadcast(clusters.withColumn("_j", F.lit(0))), "_j")

    def mean_square(entry: Column) -> Column:
        dot = F.aggregate(F.zip_with("_v", entry["m"], lambda x, m: x * m), F.lit(0.0), lambda acc, x: acc + x)
        return F.col("_sq") + entry["q"] - 2 * dot

    own = F.get(F.filter("_all", lambda e: e["c"] == F.col("_c")), F.lit(0))
    a = F.try_divide(mean_square(own) * own["n"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_all", lambda e: e["c"] != F.col("_c")), mean_square))
    scored = with_all.select(own["n"].alias("n"), a.alias("a"), b.alias("b"))
    score = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return scored.agg(F.when(F.count("b") > 0, F.avg(score)).alias("silhouette"))


def core_distances(points: DataFrame, features: Sequence[str], k: int, key: str = "id", metric: str = "euclidean",
                   tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distance to the k-th nearest point, the point itself being the first; exact.

    A tile keeps the k smallest distances per point over all tiles that it meets in a task, and hands on those. Lower bounds in single
    precision, less all their rounding, leave out the pairs that cannot be among them; the others are measured in double precision.
    """
    width, pairs = len(features), PAIRS_AT_ONCE
    manhattan, slack, wild = metric == "manhattan", 4e-7 * (len(features) + 16), 1e15

    def begin(a: np.ndarray, ids: pa.Array, _: pa.Array):
        best, known = np.full((len(a), k), np.nan), ~np.isnan(a).any(1)
        tame = (np.abs(a) < wild).all(1)  # others are always measured
        centre = a[tame].mean(0) if tame.any() else np.zeros(width)
        # features of wide spread tell points apart early
        order = np.argsort(-a[tame].std(0), kind="stable") if tame.any() else np.arange(width)
        near = np.where(tame[:, None], a - centre, 0.0)[:, order].astype(np.float32)
        size = (np.abs(near) if manhattan else near.astype(float) ** 2).sum(1, dtype=float)
        ends = sorted({width, *range(-(-width // 2), width, 8)})
        running = np.concatenate((np.zeros((len(a), 1)), near.cumsum(1, dtype=float)), axis=1)
        augmented = np.concatenate((near, np.full((len(a), 1), -1, np.float32)), axis=1)

        def measured(p: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
            off = a[p] - b[q]
            return np.abs(off).sum(1) if manhattan else np.sqrt((off ** 2).sum(1))

        def summed(c: np.ndarray, c_size: np.ndarray, limit: np.ndarray) -> np.ndarray:
            """Pairs whose sum of absolute differences may be within the limit of the row; |x - y| = 2 max(x, y) - x - y."""
            out, high = np.zeros((len(a), len(c)), np.float32), np.empty((len(a), len(c)), np.float32)
            after = np.concatenate((np.zeros((len(c), 1)), c.cumsum(1, dtype=float)), axis=1)
            columns, at = np.ascontiguousarray(c.T), 0
            for end in ends:
                for x, y in zip(near.T[at:end], columns[at:end]):
                    np.maximum(x[:, None], y, out=high)
                    out += high
                at = end
                np.subtract(out, (after[:, end] / 2 + slack * c_size).astype(np.float32), out=high)
                found = high <= ((limit + running[:, end]) / 2 + slack * size).astype(np.float32)[:, None]
                if np.count_nonzero(found) * 16 < found.size:
                    break
            return found

        def producted(c: np.ndarray, c_size: np.ndarray, limit: np.ndarray) -> np.ndarray:
            """Pairs whose squared distance may be within that of the limit of the row."""
            other = np.concatenate((c, (c_size * (1 - slack) / 2).astype(np.float32)[:, None]), axis=1)
            least = (size * (1 - slack) - limit ** 2) / 2
            return augmented @ other.T >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]

        def meet(b: np.ndarray, _: pa.Array) -> None:
            b = b[~np.isnan(b).any(1)]
            if not len(b):
                return
            b_tame = (np.abs(b) < wild).all(1)
            c = np.where(b_tame[:, None], b - centre, 0.0)[:, order].astype(np.float32)
            c_size = (np.abs(c) if manhattan else c.astype(float) ** 2).sum(1, dtype=float)
            limit = best[:, k - 1] * (1 + 1e-9)
            if np.isnan(limit[known]).any():
                if len(b) > k and not manhattan:  # no more than the k-th smallest upper bound
                    scale = size[:, None] + c_size
                    upper = np.maximum(scale - 2.0 * (near @ c.T), 0) + slack * scale
                    upper[:, ~b_tame] = np.inf
                    limit = np.fmin(limit, np.sqrt(np.partition(upper, k - 1, axis=1)[:, k - 1]) * (1 + 1e-9))
                limit = np.where(np.isnan(limit), np.inf, limit)
            limit = np.where(known, limit, 0.0)
            may = np.isinf(limit)[:, None] | (summed if manhattan else producted)(c, c_size, np.where(np.isinf(limit), 0.0, limit))
            may |= ~tame[:, None] | ~b_tame
            may &= known[:, None]
            p, q = np.nonzero(may)
            if not len(p):
                return
            d = np.concatenate([measured(p[at:at + pairs], q[at:at + pairs], b) for at in range(0, len(p), pairs)])
            first = np.flatnonzero(np.diff(p, prepend=-1))
            counts, rows = np.diff(first, append=len(p)), p[first]
            each = np.full((len(rows), counts.max()), np.nan)
            each[np.repeat(np.arange(len(rows)), counts), np.arange(len(p)) - np.repeat(first, counts)] = d
            best[rows] = np.sort(np.concatenate((best[rows], each), axis=1), axis=1)[:, :k]

        def result() -> Iterator[pa.RecordBatch]:
            ends = np.arange(len(a) + 1, dtype=np.int32) * best.shape[1]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel(), from_pandas=True))], ["id", "d"])

        return meet, result

    kind = dict(points.dtypes)[key]
    parts = _tile_pairs(points, key, features, F.lit(0), tile_rows).mapInArrow(_each_tile(begin, width), f"id {kind}, d array<double>")
    merged = parts.groupBy("id").agg(F.sort_array(F.array_compact(F.flatten(F.collect_list("d")))).alias("d"))
    return merged.select(F.col("id").alias(key), F.get("d", F.lit(k - 1)).alias("core_distance"))


# --- scores from cluster aggregates ----------------------------------------------------------------------------------

def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def davies_bouldin(points: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance."""
    vectors = points.select(F.col(cluster).alias("c"), F.array(*features).alias("v"))
    centres = points.groupBy(F.col(cluster).alias("c")).agg(F.array(*[F.avg(f) for f in features]).alias("m"))
    spread = (vectors.join(centres, "c").groupBy("c", "m").agg(F.avg(_gap(F.col("v"), F.col("m"))).alias("s")))
    listed = spread.agg(F.collect_list(F.struct("c", "m", "s")).alias("e"))  # one entry per cluster

    def worst(a: Column) -> Column:
        others = F.filter("e", lambda b: b["c"] != a["c"])
        return F.array_max(F.transform(others, lambda b: F.try_divide(a["s"] + b["s"], _gap(a["m"], b["m"]))))

    ratios = F.transform("e", worst)
    return listed.select((F.aggregate(ratios, F.lit(0.0), lambda acc, x: acc + x) / F.size("e")).alias("davies_bouldin"))


def purity(df: DataFrame, cluster: str = "cluster", y: str = "y") -> DataFrame:
    """Share of rows in the most frequent class of their cluster."""
    counts = df.groupBy(cluster, y).agg(F.count("*").alias("n"))
    best = counts.groupBy(cluster).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"))


def crosstab(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    pairs = before.select(key, F.col("cluster").alias("before")).join(after.select(key, F.col("cluster").alias("after")), key)
    return pairs.groupBy("before", "after").agg(F.count("*").alias("n"))


# --- models ----------------------------------------------------------------------------------------------------------

Factory = Callable[[int], Estimator]


def gaussian_mixture(k: int, seed: int = 42) -> Estimator:
    return GaussianMixture(k=k, seed=seed, maxIter=100, tol=1e-3, featuresCol="_features", predictionCol="cluster")


def k_means(k: int, seed: int = 42) -> Estimator:
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")


def bisecting_k_means(k: int, seed: int = 42) -> Estimator:
    return BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")


def fit_clusters(df: DataFrame, features: Sequence[str], k: int, factory: Factory = gaussian_mixture):
    """(model, rows with ``cluster``)."""
    vectors = assemble(df, features)
    model = factory(k).fit(vectors)
    return model, label(model, df, features)


def label(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assemble(df, features)).select(*df.columns, "cluster")


def cluster_range(df: DataFrame, features: Sequence[str], key: str = "id", factory: Factory = gaussian_mixture, low: int = 2,
                  high: int = 10, parallelism: int = 4, score: str = "squared") -> tuple[DataFrame, DataFrame]:
    """Scores per number of clusters and the labels (key, n_clusters, cluster), for low <= k < high.

    ``score`` as in ``mean_silhouette``.
    """
    base = stage(df, "points")
    with ThreadPool(parallelism) as pool:
        fitted = pool.map(lambda k: fit_clusters(base, features, k, factory)[1], range(low, high))
    scores, labels = [], []
    for k, rows in zip(range(low, high), fitted):
        both = mean_silhouette(rows, features, key, score).withColumn("_j", F.lit(0)).join(
            davies_bouldin(rows, features).withColumn("_j", F.lit(0)), "_j")
        scores.append(both.select(F.lit(k).alias("n_clusters"), "silhouette", "davies_bouldin"))
        labels.append(rows.select(key, F.lit(k).alias("n_clusters"), "cluster"))
    return _stack(scores), _stack(labels)


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def control_overlay(patients: DataFrame, controls: DataFrame) -> DataFrame:
    """Labelled patients with the controls as cluster -1."""
    return patients.unionByName(controls.withColumn("cluster", F.lit(-1)).select(*patients.columns))


# --- search over feature sets ----------------------------------------------------------------------------------------

def score_candidates(df: DataFrame, candidates: Sequence[tuple[Sequence[str], int]], key: str = "id",
                     factory: Factory = gaussian_mixture, parallelism: int = 4, score: str = "squared") -> list[dict]:
    """Silhouette of one model per (features, k).

    Mixtures with the squared score share every pass over the points; other models or scores are separate jobs.
    """
    candidates = [(list(names), k) for names, k in candidates]
    if factory is gaussian_mixture and score == "squared":
        features = sorted({f for names, _ in candidates for f in names})
        points, models = mixtures.fit(df, features, candidates)
        found = mixtures.squared_silhouettes(points, models)
        points.unpersist()
        return [{"features": names, "k": k, "n_clusters": n, "silhouette": s} for (names, k), (n, s) in zip(candidates, found)]

    def one(candidate):
        names, k = candidate
        _, rows = fit_clusters(df, names, k, factory)
        s = mean_silhouette(rows, names, key, score).first()["silhouette"]
        return {"features": names, "k": k, "n_clusters": rows.select("cluster").distinct().count(), "silhouette": s}

    with ThreadPool(parallelism) as pool:
        return pool.map(one, candidates)


def best_per_k(rows: DataFrame, k: str = "n_clusters", score: str = "silhouette") -> DataFrame:
    """Best row(s) of every number of clusters; ties stay."""
    best = rows.groupBy(k).agg(F.max(score).alias("_best"))
    return rows.join(best, k).where(F.col(score) == F.col("_best")).select(*rows.columns)


def best_model(rows: DataFrame, score: str = "silhouette") -> DataFrame:
    """The single best row."""
    return rows.orderBy(F.col(score).desc_nulls_last()).limit(1)


def distinct_feature_sets(rows: DataFrame, features: str = "features", k: str = "n_clusters",
                          order: str = "position") -> DataFrame:
    """First row of every (feature set, k), whatever the order of the names."""
    first = rows.groupBy(F.array_sort(features).alias("_set"), F.col(k).alias("_k")).agg(
        F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return first.select("_row.*")


_SEARCH = "features array<string>, k int, n_clusters int, silhouette double"


def _rows(df: DataFrame, found: Sequence[dict]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f["features"], f["k"], f["n_clusters"], f["silhouette"]) for f in found], _SEARCH)


def brute_force(df: DataFrame, features: Sequence[str], key: str = "id", factory: Factory = gaussian_mixture,
                choose: int = 2, low: int = 2, high: int = 10, parallelism: int = 4) -> DataFrame:
    """Best feature set of ``choose`` features per number of clusters, over all sets and low <= k < high."""
    candidates = [(c, k) for k in range(low, high) for c in combinations(features, choose)]
    found = score_candidates(df, candidates, key, factory, parallelism)
    rows = _rows(df, [f for f in found if f["silhouette"] is not None])
    return best_per_k(rows, "k").drop("n_clusters").withColumnRenamed("k", "n_clusters")


def add_features(df: DataFrame, features: Sequence[str], starts: Sequence[tuple[Sequence[str], int, float]], key: str = "id",
                 factory: Factory = gaussian_mixture, patience: int = 0, parallelism: int = 4) -> DataFrame:
    """Grow each start by the best further feature for ``patience + 1`` rounds.

    A round always adds its best feature to the trial set; the chosen set only grows when the overall score improves.
    """
    states = [{"trial": list(s), "kept": list(s), "best": score, "n": k, "k": k, "open": True} for s, k, score in starts]
    for _ in range(patience + 1):
        # all starts of a round are scored together
        tasks = [(s, f) for s in states if s["open"] for f in features if f not in s["trial"]]
        if not tasks:
            break
        found = score_candidates(df, [(sorted({f, *s["trial"]}), s["k"]) for s, f in tasks], key, factory, parallelism)
        for s in states:
            ranked = [(r["silhouette"], -i) for i, ((t, _), r) in enumerate(zip(tasks, found)) if t is s and (r["silhouette"] or 0) > 0]
            if not ranked:
                s["open"] = False
                continue
            top, at = max(ranked)
            name = tasks[-at][1]
            s["trial"].append(name)
            if top > s["best"]:
                s |= {"kept": [*s["kept"], name], "best": top, "n": found[-at]["n_clusters"]}
    chosen = [{"features": s["kept"], "k": s["k"], "n_clusters": s["n"], "silhouette": s["best"]} for s in states]
    rows = best_per_k(_rows(df, chosen)).drop("k")
    return rows.withColumn("n_features", F.size("features"))


def tune(df: DataFrame, features: Sequence[str], key: str = "id", factory: Factory = gaussian_mixture, choose: int = 2,
         low: int = 2, high: int = 6, patience: int = 0, parallelism: int = 4) -> DataFrame:
    """Brute force over small feature sets, then growth of the best ones."""
    df = stage(df, "points")  # every round reads the points again
    best = brute_force(df, features, key, factory, choose, low, high, parallelism).withColumn("position", F.concat_ws(",", "features"))
    starts = [(r["features"], r["n_clusters"], r["silhouette"]) for r in distinct_feature_sets(best).orderBy("n_clusters", "position").collect()]
    return add_features(df, features, starts, key, factory, patience, parallelism)


# --- validation ------------------------------------------------------------------------------------------------------

def split_rows(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key, so that a repeated task splits the same way."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
    test = bucket < int(share * 1_000_000)
    return df.where(~test), df.where(test)


def stratified_folds(df: DataFrame, n: int, y: str = "y", key: str = "id") -> DataFrame:
    """``fold`` 0..n-1: consecutive blocks of each class in key order."""
    sizes = df.groupBy(y).agg(F.count("*").alias("_size"))
    numbered = scan(value_chunks(df, [y], key), [y], key, [], {"_i": sum_before(F.lit(1))}, chunk=F.col("_part"))
    return (numbered.join(sizes, y).withColumn("fold", F.floor(F.col("_i") * n / F.col("_size")).cast("int"))
            .select(*df.columns, "fold"))


def _centres(model) -> list[list[float]]:
    if hasattr(model, "gaussiansDF"):
        return [[float(v) for v in r["mean"]] for r in model.gaussiansDF.select("mean").collect()]
    return [[float(v) for v in c] for c in model.clusterCenters()]


def fold_scores(train: DataFrame, test: DataFrame, features: Sequence[str], k: int, y: str = "y", key: str = "id",
                factory: Factory = gaussian_mixture, score: str = "squared") -> DataFrame:
    """Within and between cluster sums, silhouette and purity on test rows of a model fitted to the train rows."""
    model, _ = fit_clusters(train, features, k, factory)
    rows = label(model, test, features)
    centres = F.array(*[F.array(*[F.lit(v) for v in c]) for c in _centres(model)])
    placed = rows.select("cluster", *features, F.array(*features).alias("v"), F.get(centres, F.col("cluster")).alias("m"))
    overall = placed.agg(F.array(*[F.avg(f) for f in features]).alias("g"))
    per_cluster = placed.groupBy("cluster", "m").agg(
        F.avg(F.pow(_gap(F.col("v"), F.col("m")), 2)).alias("w"), F.count("*").alias("n")).withColumn("_j", F.lit(0))
    sums = per_cluster.join(overall.withColumn("_j", F.lit(0)), "_j").agg(
        F.sum("w").alias("wcss"), F.sum(F.col("n") * F.pow(_gap(F.col("m"), F.col("g")), 2)).alias("bcss"))
    parts = [sums, mean_silhouette(rows, features, key, score), purity(rows, "cluster", y)]
    out = parts[0].withColumn("_j", F.lit(0))
    for p in parts[1:]:
        out = out.join(p.withColumn("_j", F.lit(0)), "_j")
    return out.drop("_j")


def fold_validation(df: DataFrame, features: Sequence[str], y: str = "y", key: str = "id", n_splits: int = 2, low: int = 4,
                    high: int = 11, factory: Factory = gaussian_mixture, parallelism: int = 4) -> DataFrame:
    """Scores averaged over stratified folds per number of clusters, with balance (B - W) / (B + W)."""
    folds = stage(stratified_folds(df, n_splits, y, key), "folds")

    def scores(task: tuple[int, int]) -> DataFrame:
        k, i = task
        found = fold_scores(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i), features, k, y, key, factory)
        return found.withColumn("n_clusters", F.lit(k))

    with ThreadPool(parallelism) as pool:
        frames = pool.map(scores, [(k, i) for k in range(low, high) for i in range(n_splits)])
    means = _stack(frames).groupBy("n_clusters").agg(*[F.avg(c).alias(c) for c in ("wcss", "bcss", "silhouette", "purity")])
    return means.withColumn("balance", F.try_divide(F.col("bcss") - F.col("wcss"), F.col("bcss") + F.col("wcss")))
