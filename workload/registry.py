"""All registered queries and their oracle SQL."""

from __future__ import annotations

from workload import event_queries, feature_queries, file_queries, model_queries, sample_queries, table_queries

SPARK: dict = {}
SQL: dict[str, str] = {}

for _module in (event_queries, sample_queries, feature_queries, file_queries, table_queries, model_queries):
    SPARK |= _module.SPARK
    SQL |= _module.SQL
