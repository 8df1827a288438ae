"""Reading of the star-schema tables that queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table below ``sf_dir``; any path that Spark itself can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
