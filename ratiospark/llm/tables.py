"""Table access shared by the training-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path goes to Spark's reader unchanged, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
