"""Reader for a directory that holds one Parquet table per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the directory, as written there."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
