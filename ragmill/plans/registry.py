"""All retrieval queries, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, chunking, evaluation, relations, retrieval, streams, texts  # noqa: F401  (they register themselves)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["ret02_hybrid_flagship"](spark, sf_dir)


def queries() -> dict:
    return base.QUERIES


def oracle_sql() -> dict:
    return base.ORACLES
