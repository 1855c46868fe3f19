"""All registered queries of the package outside ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans import analytics, assist, documents, extensions, inventory, memory, retrieval, sequences, sources, streams, web
from quern.plans.registry import QUERIES, SQL

MODULES = (analytics, retrieval, assist, memory, documents, sequences, web, streams, sources, extensions, inventory)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and vector lists fused by reciprocal rank."""
    return QUERIES["r10_hybrid"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
