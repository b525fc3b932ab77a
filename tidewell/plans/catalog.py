"""The catalog that query modules register in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Table names.
EVIDENCE, EVENTS, CLAIMS, GOLD = "evidence_v3_repaired_plus_low37", "event_registry", "candidate_soa_tuples", "gold_tuple_sample_for_human_review"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add
