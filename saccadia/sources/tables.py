"""Parquet and CSV tables at the hand-offs between stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, experiment: str | None = None,
                 participant_id: int | None = None) -> DataFrame:
    """Parquet scan; columns and both filters reach the scan, ``experiment`` as a partition."""
    df = spark.read.parquet(path)
    if experiment is not None:
        df = df.where(F.col("experiment") == experiment)
    if participant_id is not None:
        df = df.where(F.col("participant_id") == participant_id)
    return df if columns is None else df.select(*columns)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ("experiment",)) -> None:
    """Parquet sink. Overwriting replaces only the partitions that ``df`` holds; ``append`` adds files."""
    writer = df.write.mode(mode).partitionBy(*[p for p in partition_by if p in df.columns])
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A workbook sheet exported as CSV, with a declared schema."""
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)
