"""Stage functions from recordings to selected features. Each reads a table, transforms it and writes the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from saccadia import schemas as S
from saccadia.operators.clean import clean_events
from saccadia.operators.matrix import feature_columns, feature_matrix, labelled_matrix
from saccadia.plans.features import experiment_features
from saccadia.plans.preprocess import preprocess_events, preprocess_samples
from saccadia.plans.selection import select_features
from saccadia.sources.logs import extract_events, extract_samples
from saccadia.sources.tables import read_parquet, write_parquet


def extract_event_stage(spark: SparkSession, logs: str, out: str, experiments: Sequence[str] = S.EXPERIMENTS) -> None:
    for e in experiments:
        write_parquet(extract_events(spark, logs, e), out)


def clean_stage(spark: SparkSession, raw: str, out: str, experiments: Sequence[str] = S.EXPERIMENTS) -> None:
    for e in experiments:
        write_parquet(clean_events(read_parquet(spark, raw, experiment=e), e), out)


def preprocess_event_stage(spark: SparkSession, cleaned: str, out: str, experiments: Sequence[str] = S.EXPERIMENTS,
                           **options) -> None:
    for e in experiments:
        write_parquet(preprocess_events(read_parquet(spark, cleaned, experiment=e), e, **options), out)


def extract_sample_stage(spark: SparkSession, logs: str, cleaned: str, out: str,
                         experiments: Sequence[str] = S.EXPERIMENTS, **options) -> None:
    for e in experiments:
        events = read_parquet(spark, cleaned, experiment=e)
        write_parquet(extract_samples(spark, logs, events, e, **options), out)


def preprocess_sample_stage(spark: SparkSession, cleaned: str, out: str, experiments: Sequence[str] = S.EXPERIMENTS) -> None:
    for e in experiments:
        write_parquet(preprocess_samples(read_parquet(spark, cleaned, experiment=e)), out)


def feature_stage(spark: SparkSession, events: str, samples: str, out: str, experiments: Sequence[str] = S.EXPERIMENTS,
                  event_features: bool = False, sample_features: bool = False, **options) -> None:
    """One table per experiment, ``<out>/<experiment>``; with neither flag both kinds are computed."""
    both = not event_features and not sample_features
    for e in experiments:
        table = experiment_features(
            e, read_parquet(spark, events, experiment=e) if event_features or both else None,
            read_parquet(spark, samples, experiment=e) if sample_features or both else None, **options)
        write_parquet(table, f"{out}/{e}", partition_by=())


def matrix_stage(spark: SparkSession, features: str, people: DataFrame, out: str,
                 experiments: Sequence[str] = S.EXPERIMENTS) -> DataFrame:
    """All experiments side by side with the label; ``people`` holds (participant_id, y)."""
    table = feature_matrix({e: spark.read.parquet(f"{features}/{e}") for e in experiments})
    write_parquet(labelled_matrix(table, people), out, partition_by=())
    return spark.read.parquet(out)


def selection_stage(matrix: DataFrame, out: str, **options) -> list[str]:
    selected = select_features(matrix, **options)
    write_parquet(selected, out, partition_by=())
    return feature_columns(selected)
