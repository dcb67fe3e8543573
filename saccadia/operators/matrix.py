"""Feature matrix: experiments side by side, labels, missing-value filters, long view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.scalars import is_patient


def prefixed(features: DataFrame, experiment: str) -> DataFrame:
    """One experiment's features with its name in front of every feature column."""
    keep = ("experiment", "participant_id")
    return features.select("participant_id", *[F.col(c).alias(f"{experiment}_{c}") for c in features.columns
                                               if c not in keep])


def feature_matrix(frames: dict[str, DataFrame]) -> DataFrame:
    """Full outer combination of the experiments; every frame has one row per participant.

    One union and one aggregate shuffle the rows once, however many experiments there are.
    """
    tables = [prefixed(df, e) for e, df in frames.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    values = [c for c in stacked.columns if c != "participant_id"]
    return stacked.groupBy("participant_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def demographics(people: DataFrame, require_visit: bool = True) -> DataFrame:
    """(participant_id, y) from a demographics table; without a recording date a person is left out."""
    rows = people.where(F.col("Eye tracking date").isNotNull()) if require_visit else people
    return rows.select(F.col("ID").cast("bigint").alias("participant_id"), is_patient(F.col("Group")).alias("y"))


def labelled_matrix(features: DataFrame, people: DataFrame) -> DataFrame:
    """Every person of ``people`` with their features, missing where there are none."""
    return people.join(features, "participant_id", "left")


def with_demographics(features: DataFrame, people: DataFrame) -> DataFrame:
    return features.join(people, "participant_id", "left")


def feature_columns(df: DataFrame, keys: Sequence[str] = ("participant_id", "y")) -> list[str]:
    return [c for c in df.columns if c not in keys]


def long_view(df: DataFrame, features: Sequence[str] | None = None,
              keys: Sequence[str] = ("participant_id", "y")) -> DataFrame:
    """(keys, feature, value) without missing values."""
    features = feature_columns(df, keys) if features is None else list(features)
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return typed.unpivot(list(keys), features, "feature", "value").where(F.col("value").isNotNull())


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Missing values per column and the row count (``*``): one aggregate, one number per column."""
    row = df.agg(F.count("*").alias("*"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
    return row.asDict()


def drop_empty_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.na.drop("all", subset=list(features))


def drop_incomplete_rows(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(features) if features else None)


def drop_incomplete_columns(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    counts = null_counts(df, df.columns)
    return df.select(*[f"`{c}`" for c in df.columns if c in keys or counts[c] == 0])


def drop_sparse_columns(df: DataFrame, share: float = 0.60) -> DataFrame:
    """Columns with at most ``round(share * rows)`` missing values."""
    counts = null_counts(df, df.columns)
    limit = round(counts["*"] * share)
    return df.select(*[f"`{c}`" for c in df.columns if counts[c] <= limit])


def drop_sparse_rows(df: DataFrame, share: float = 0.10) -> DataFrame:
    """Rows with at most ``round(share * columns)`` missing values."""
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(missing <= round(len(df.columns) * share))
