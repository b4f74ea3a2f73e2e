"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def _named(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir, else that of setCheckpointDir, if any."""
    context = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def _base(spark: SparkSession) -> str:
    """The folder named; where none is: a temporary one in local mode, an error on a cluster."""
    context, base = spark.sparkContext, _named(spark)
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="loomline-"))
        base = _local[0]
    return f"{base.rstrip('/')}/loomline/{context.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under this application's own."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs no earlier stage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what this application left in the shared folder; for the end of a run, when no result reads from it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
