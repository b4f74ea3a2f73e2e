"""Parquet tables in a directory, one per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory`` (``<directory>/<name>.parquet``, a file or a folder)."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
