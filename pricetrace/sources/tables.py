"""Columnar inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet scan of the columns in `schema` (DDL), without a job to infer them."""
    return spark.read.schema(schema).parquet(path)
