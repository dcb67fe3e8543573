"""Descriptive statistics per group, with an exact median that never gathers a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FIVE = ("mean", "min", "max", "median", "std")
_SIMPLE = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}

# The median lies between these two approximate percentiles: the sketch errs by at most 1/_ACCURACY of the rows.
_ACCURACY = 10_000
_BRACKET = (0.4995, 0.5005)


def exact_medians(df: DataFrame, by: Sequence[str], metrics: dict[str, Column], outputs: dict[str, str] | None = None,
                  extra: Sequence[Column] = ()) -> DataFrame:
    """Exact median per group of every metric (of those named in ``outputs``, if given), plus the ``extra`` aggregates.

    First pass: a mergeable quantile sketch per group gives a narrow bracket around the median. Second pass: values
    below the bracket are only counted, values inside it are counted by value, and the middle ranks are read off.
    """
    by, names = list(by), list(metrics)
    outputs = {n: f"{n}_median" for n in names} if outputs is None else outputs
    values = df.select(*by, *[m.alias(f"_m{i}") for i, m in enumerate(metrics.values())])
    wanted = [i for i, n in enumerate(names) if n in outputs]
    sketches = []
    for i in wanted:
        sketches += [F.count(f"_m{i}").alias(f"_n{i}"),
                     F.percentile_approx(f"_m{i}", list(_BRACKET), _ACCURACY).alias(f"_b{i}")]
    # ``extra`` aggregates refer to metric i as column _m{i}.
    groups = values.groupBy(*by).agg(*extra, *sketches)
    if not wanted:
        return groups
    # Packed, because then both uses of the groups read the same aggregation; only the brackets go to the values.
    packed = groups.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in by])).select(
        *by, F.array(F.struct(*[c for c in groups.columns if c not in by])).alias("_packed"))
    described = packed.select(*by, F.inline("_packed"))
    located = values.join(described.select(*by, *[c for i in wanted for c in (f"_n{i}", f"_b{i}")]), by)
    entries = []
    for i in wanted:
        value, low, high = F.col(f"_m{i}"), F.col(f"_b{i}")[0], F.col(f"_b{i}")[1]
        entries.append(F.when(value <= high, F.struct(
            F.lit(i).alias("_i"), F.when(value >= low, value.cast("double")).alias("_v"),
            F.col(f"_n{i}").alias("_of"))))
    counted = (located.select(*by, F.inline(F.array_compact(F.array(*entries))))
               .groupBy(*by, "_i", "_v", "_of").agg(F.count("*").alias("_count")))
    upto = W.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_count").over(upto))
    lower, upper = F.floor((F.col("_of") + 1) / 2), F.floor((F.col("_of") + 2) / 2)
    middles = ranked.groupBy(*by, "_i").agg(
        F.min(F.when(F.col("_upto") >= lower, F.col("_v"))).alias("_lo"), F.min(F.when(F.col("_upto") >= upper, F.col("_v"))).alias("_hi"),
        F.max(F.when(F.col("_v").isNull(), F.col("_upto") >= lower)).alias("_miss"))
    middle = F.when(~F.coalesce("_miss", F.lit(False)), (F.col("_lo") + F.col("_hi")) / 2)
    medians = middles.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, middle)).alias(f"_md{i}") for i in wanted])

    def median(i: int) -> Column:
        return (F.when((F.col(f"_n{i}") > 0) & F.col(f"_md{i}").isNull(), F.raise_error(F.lit("median outside its bracket")).cast("double"))
                .otherwise(F.col(f"_md{i}")))

    own = [f"_{x}{i}" for i in wanted for x in "nb"]
    kept = [c for c in groups.columns if c not in by and c not in own]
    return described.join(medians, by, "left").select(*by, *kept, *[median(i).alias(outputs[names[i]]) for i in wanted])


def five_stats(df: DataFrame, by: Sequence[str], metrics: dict[str | tuple[str, str], Column],
               stats: Sequence[str] = FIVE) -> DataFrame:
    """``<metric>_<stat>`` for every metric, or ``<metric>_<stat>_<suffix>`` for a ``(metric, suffix)`` key.

    Missing values are left out.
    """
    by = list(by)
    columns, suffixes = {}, {}
    for metric, column in metrics.items():
        name, suffix = metric if isinstance(metric, tuple) else (metric, "")
        label = f"{name}|{suffix}"
        columns[label] = column
        suffixes[label] = (name, f"_{suffix}" if suffix else "")
    extra, order = [], []
    for i, label in enumerate(columns):
        name, suffix = suffixes[label]
        for stat in stats:
            order.append(f"{name}_{stat}{suffix}")
            if stat in _SIMPLE:
                extra.append(_SIMPLE[stat](f"_m{i}").alias(order[-1]))
    if "median" in stats:
        outputs = {label: f"{n}_median{s}" for label, (n, s) in suffixes.items()}
        described = exact_medians(df, by, columns, outputs, extra)
    else:
        described = (df.select(*by, *[c.alias(f"_m{i}") for i, c in enumerate(columns.values())])
                     .groupBy(*by).agg(*extra))
    return described.select(*by, *order)
