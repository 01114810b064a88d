"""All queries of the core over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import nested
from tessera.plans import q_guard, q_numeric, q_text, q_vectors

MODULES = [q_text, q_vectors, q_guard, q_numeric]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return q_text.dedup_reference_hash(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.case_children(spark.read.parquet(f"{d}/incident_reports.parquet"), spark.read.parquet(f"{d}/extraction_results.parquet"))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.case_tables(spark.read.parquet(f"{d}/incident_reports.parquet"), spark.read.parquet(f"{d}/extraction_results.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in MODULES for name in m.NAMES} | {"p3_found": p3_found, "p3_tables": p3_tables}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.sql().items()}
