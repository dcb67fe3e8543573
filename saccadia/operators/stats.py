"""Feature filters and group tests on the long view (participant_id, y, feature, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saccadia.operators.describe import exact_medians
from saccadia.operators.matrix import long_view
from saccadia.operators.scan import scan, sum_before


#: Rows of a value range, about, and the number of ranges that is always made.
RANGE_ROWS, LEAST_RANGES = 1_000_000, 64


def value_chunks(df: DataFrame, by: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """Add ``_part``: which of about ``parts`` equally filled value ranges of its group a row falls in.

    Without ``parts`` the rows are counted, so that a range stays within RANGE_ROWS whatever the size of its group.
    """
    by = list(by)
    if parts is None:
        parts = max(LEAST_RANGES, -(-df.count() // RANGE_ROWS))
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(1000, 10 * parts)).alias("_cuts"))
    at = F.col(value)
    return df.join(cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < at)).cast("bigint")).drop("_cuts")


# --- variance, outliers ----------------------------------------------------------------------------------------------

def feature_variance(long: DataFrame, normalise: bool = True) -> DataFrame:
    """Population variance per feature, of the values scaled to [0, 1] by default; a constant feature has none."""
    value = F.col("value")
    stats = long.groupBy("feature").agg(F.min(value).alias("low"), F.max(value).alias("high"),
                                        F.var_pop(value).alias("v"))
    spread = F.col("high") - F.col("low")
    return stats.select("feature", "low", "high",
                        (F.try_divide(F.col("v"), spread * spread) if normalise else F.col("v")).alias("variance"))


def min_max_scaled(df: DataFrame, features: Sequence[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: F.try_divide(F.col(f) - ranges[f][0], F.lit(ranges[f][1] - ranges[f][0])) for f in features})


def remove_low_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.01,
                        normalise: bool = True) -> tuple[DataFrame, list[str]]:
    """Keep features whose variance exceeds the threshold; kept features are scaled when ``normalise``."""
    stats = {r["feature"]: r for r in feature_variance(long_view(df, features, feature_keys(df, features)), normalise).collect()}
    kept = [f for f in features if f in stats and (stats[f]["variance"] or 0) > threshold]
    out = df.select(*feature_keys(df, features), *kept)
    if normalise:
        out = min_max_scaled(out, kept, {f: (stats[f]["low"], stats[f]["high"]) for f in kept})
    return out, kept


def feature_keys(df: DataFrame, features: Sequence[str]) -> list[str]:
    wanted = set(features)
    return [c for c in df.columns if c not in wanted]


def outlier_limits(long: DataFrame) -> DataFrame:
    """Median and median absolute deviation per feature."""
    medians = exact_medians(long, ["feature"], {"value": F.col("value")}, {"value": "median"})
    off = long.join(medians, "feature").withColumn("off", F.abs(F.col("value") - F.col("median")))
    return medians.join(exact_medians(off, ["feature"], {"off": F.col("off")}, {"off": "mad"}), "feature")


def is_outlier(value: Column, median: Column, mad: Column, threshold: float) -> Column:
    return (mad > 0) & (F.abs(value - median) > threshold * mad)


def mark_outliers(long: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Outlying values become NULL; features without spread are left alone."""
    marked = long.join(outlier_limits(long), "feature")
    outlying = is_outlier(F.col("value"), F.col("median"), F.col("mad"), threshold)
    return marked.withColumn("value", F.when(~outlying, F.col("value"))).select(*long.columns)


def remove_outliers(df: DataFrame, features: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Wide form of ``mark_outliers``: two numbers per feature go through the driver."""
    limits = {r["feature"]: r for r in outlier_limits(long_view(df, features, feature_keys(df, features))).collect()}
    return df.withColumns({
        f: F.when(~is_outlier(F.col(f), F.lit(limits[f]["median"]), F.lit(limits[f]["mad"]), threshold), F.col(f))
        for f in features if f in limits and limits[f]["mad"]})


# --- correlation -----------------------------------------------------------------------------------------------------

def target_correlation(long: DataFrame) -> DataFrame:
    """Correlation with y and sample variance per feature; a constant feature has no correlation."""
    value, y = F.col("value"), F.col("y").cast("double")
    return long.groupBy("feature").agg(
        F.try_divide(F.covar_pop(value, y), F.stddev_pop(value) * F.stddev_pop(y)).alias("corr"),
        F.var_samp(value).alias("variance"))


def low_target_correlation(long: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Features with |correlation to y| below the threshold."""
    return target_correlation(long).where(F.abs("corr") < threshold).select("feature", "corr")


def co_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature pair over the rows that have both: count, sums, squares and cross product.

    Each task adds up p x p matrices over its batches and hands on one row per pair, so what is shuffled depends on the
    number of features and tasks, not on the number of rows. Values are shifted by the feature means beforehand.
    """
    features = list(features)
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    shifted = df.select(*[(F.col(f).cast("double") - F.lit(means[f] or 0.0)).alias(f) for f in features])
    names = features

    def add_up(batches):
        p = len(names)
        n, s, q, c = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            present = ~np.isnan(x)
            m = present.astype(float)
            x = np.where(present, x, 0.0)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            c += x.T @ x
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j], "si": s[i, j], "sj": s[j, i],
                            "qi": q[i, j], "qj": q[j, i], "c": c[i, j]})

    parts = shifted.mapInPandas(add_up, "i int, j int, n double, si double, sj double, qi double, qj double, c double")
    named = F.array(*[F.lit(f) for f in features])
    return parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in ("n", "si", "sj", "qi", "qj", "c")]).select(
        named[F.col("i")].alias("f1"), named[F.col("j")].alias("f2"), *("n", "si", "sj", "qi", "qj", "c"))


def pairwise_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(f1, f2, corr) over complete pairs, f1 before f2 in column order; NULL when a side is constant."""
    n, si, sj = F.col("n"), F.col("si"), F.col("sj")
    vi, vj = n * F.col("qi") - si * si, n * F.col("qj") - sj * sj
    # A constant column leaves only rounding noise in its variance.
    flat = (vi <= 1e-12 * n * F.col("qi")) | (vj <= 1e-12 * n * F.col("qj"))
    r = F.when(~flat, (n * F.col("c") - si * sj) / F.sqrt(vi * vj))
    return co_moments(df, features).where(F.col("f1") != F.col("f2")).select("f1", "f2", r.alias("corr"))


def collinear_features(df: DataFrame, features: Sequence[str], y: str = "y", threshold: float = 0.85) -> list[str]:
    """Features to drop: in the order of correlation with y (then variance), each feature drops the features in
    columns before it that correlate with it beyond the threshold, unless it was dropped itself."""
    features = list(features)
    long = long_view(df, features, [y]).withColumnRenamed(y, "y")
    strength = {r["feature"]: (abs(r["corr"]) if r["corr"] is not None else -1.0, r["variance"] or 0.0)
                for r in target_correlation(long).collect()}
    close: dict[str, list[str]] = {}
    for r in pairwise_correlation(df, features).where(F.abs("corr") > threshold).collect():
        close.setdefault(r["f2"], []).append(r["f1"])
    dropped: list[str] = []
    for feature in sorted(features, key=lambda f: strength.get(f, (-1.0, 0.0)), reverse=True):
        if feature not in dropped:
            dropped += [f for f in close.get(feature, []) if f not in dropped]
    return dropped


def remove_collinear(df: DataFrame, features: Sequence[str], y: str = "y",
                     threshold: float = 0.85) -> tuple[DataFrame, list[str]]:
    dropped = set(collinear_features(df, features, y, threshold))
    return df.drop(*dropped), [f for f in features if f not in dropped]


# --- group tests -----------------------------------------------------------------------------------------------------

def _two_sided_normal(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2))) if v == v else None)

    return tail(z)


def _two_sided_t(t: Column, freedom: Column) -> Column:
    @F.pandas_udf("double")
    def tail(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        def beta_fraction(a: float, b: float, x: float) -> float:
            # Continued fraction of the incomplete beta function (modified Lentz).
            tiny, c = 1e-300, 1.0
            d = 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
            h = d
            for m in range(1, 500):
                for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                             -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1.0 / (1.0 + step * d or tiny)
                    c = 1.0 + step / c or tiny
                    h *= d * c
                if abs(d * c - 1.0) < 1e-15:
                    break
            return h

        def incomplete_beta(a: float, b: float, x: float) -> float:
            if x <= 0 or x >= 1:
                return float(x >= 1)
            front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
            if x < (a + 1) / (a + b + 2):
                return front * beta_fraction(a, b, x) / a
            return 1 - front * beta_fraction(b, a, 1 - x) / b

        return pd.Series([incomplete_beta(v / 2, 0.5, v / (v + t * t)) if t == t and v > 0 else None
                          for t, v in zip(ts, dfs)], dtype=float)

    return tail(t, freedom)


#: Exact p-values are meant for small groups: up to this many members of the smaller one with ``method='auto'``.
EXACT_GROUP = 8


def _two_sided_exact(u: Column, n0: Column, n1: Column) -> Column:
    """Share of the arrangements of two untied groups whose U is at least as far from the middle, by the counting recursion:
    the largest value belongs to one group, which adds the size of the other to U, or to the other group, which adds nothing."""
    @F.pandas_udf("double")
    def share(us: pd.Series, n0s: pd.Series, n1s: pd.Series) -> pd.Series:
        def arrangements(a: int, b: int) -> list[int]:
            # row[j] counts the values of U over j members of the second group; one more member of the first per round
            row = [[1]] * (b + 1)
            for i in range(1, a + 1):
                new = [[1]]
                for j in range(1, b + 1):
                    counts = [0] * (i * j + 1)
                    for k, c in enumerate(row[j]):
                        counts[k + j] += c
                    for k, c in enumerate(new[j - 1]):
                        counts[k] += c
                    new.append(counts)
                row = new
            return row[b]

        def one(u: float, a: int, b: int) -> float:
            counts = arrangements(min(a, b), max(a, b))
            return min(1.0, 2 * sum(counts[math.ceil(max(u, a * b - u)):]) / math.comb(a + b, a))

        return pd.Series([one(u, int(a), int(b)) if u == u and u is not None and a > 0 and b > 0 else None for u, a, b in zip(us, n0s, n1s)], dtype=float)

    return share(u, n0, n1)


def mann_whitney(long: DataFrame, parts: int | None = None, method: str = "asymptotic") -> DataFrame:
    """U of the controls (y = 0) against the patients (y = 1) per feature, with group means and population stds.

    Two-sided p: ``asymptotic`` is the normal approximation with tie and continuity correction, ``exact`` counts all
    arrangements as if no values were tied, ``auto`` is exact where no values are tied and a group has EXACT_GROUP members or
    fewer. Equal values are counted first; the number of smaller patient values then is a running sum in value order.
    """
    if method not in ("asymptotic", "exact", "auto"):
        raise ValueError(f"unknown method {method!r}")
    control, patient, value = F.col("y") == 0, F.col("y") == 1, F.col("value")
    groups = long.groupBy("feature").agg(
        F.avg(F.when(control, value)).alias("mean_control"), F.avg(F.when(patient, value)).alias("mean_patient"),
        F.stddev_pop(F.when(control, value)).alias("std_control"),
        F.stddev_pop(F.when(patient, value)).alias("std_patient"))
    counts = long.groupBy("feature", "value").agg(F.count_if(control).alias("c"), F.count_if(patient).alias("p"))
    below = scan(value_chunks(counts, ["feature"], "value", parts), ["feature"], "value", [],
                 {"_below": sum_before(F.col("p"))}, chunk=F.col("_part"))
    t = (F.col("c") + F.col("p")).cast("double")
    ranks = below.groupBy("feature").agg(
        F.sum(F.col("c") * (F.col("_below") + F.col("p") / 2)).alias("U_value"),
        F.sum("c").alias("n_control"), F.sum("p").alias("n_patient"), F.sum(t * t * t - t).alias("_ties"))
    n0, n1 = F.col("n_control"), F.col("n_patient")
    n, half = (n0 + n1).cast("double"), n0 * n1 / 2
    sigma = F.sqrt(F.try_divide(n0 * n1, F.lit(12)) * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.col("U_value"), n0 * n1 - F.col("U_value")) - half - 0.5, sigma)
    p = _two_sided_normal(F.col("z"))
    if method != "asymptotic":
        exactly = F.lit(True) if method == "exact" else (F.col("_ties") == 0) & (F.least(n0, n1) <= EXACT_GROUP)
        # a NULL instead of U keeps the recursion from rows that do not ask for it
        exact = _two_sided_exact(F.when(exactly, F.col("U_value")), n0, n1)
        p = exact if method == "exact" else F.when(exactly, exact).otherwise(p)
    return (ranks.withColumn("z", z).join(groups, "feature")
            .select("feature", "U_value", "n_control", "n_patient", "z", p.alias("p_value"),
                    "mean_control", "mean_patient", "std_control", "std_patient"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, p: str = "p_value", key: str = "feature") -> DataFrame:
    """Adjusted p and verdict. One row per feature, so the global order is over as many rows as there are columns."""
    m, order = F.count(p).over(W.partitionBy()), W.orderBy(F.col(p), F.col(key))
    known = tests.where(F.col(p).isNotNull())
    ranked = known.withColumns({"_m": m, "_rank": F.row_number().over(order)})
    falling = W.orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(falling))
    return (ranked.withColumn("p_value_corrected", adjusted).drop("_m", "_rank")
            .withColumn("is_significant", F.col("p_value_corrected") <= alpha))


def significant_features(long: DataFrame, alpha: float = 0.05, method: str = "asymptotic") -> DataFrame:
    return benjamini_hochberg(mann_whitney(long, method=method), alpha).where("is_significant").orderBy("p_value", "feature")


def t_test(long: DataFrame) -> DataFrame:
    """Two-sample t-test with equal variances per feature, uncorrected."""
    control, patient, value = F.col("y") == 0, F.col("y") == 1, F.col("value")
    g = long.groupBy("feature").agg(*[
        fn(F.when(cond, value)).alias(f"{name}{i}") for i, cond in enumerate((control, patient))
        for name, fn in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    freedom = F.col("n0") + F.col("n1") - 2
    pooled = F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), freedom)
    t = F.try_divide(F.col("m0") - F.col("m1"),
                     F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1")))))
    return (g.withColumns({"t_value": t, "df": freedom})
            .select("feature", "t_value", "df", _two_sided_t(F.col("t_value"), F.col("df").cast("double")).alias("p_value")))
