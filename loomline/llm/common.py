"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.shared import scratch, written  # noqa: F401

#: Partial sums that one task adds up at most.
FAN_IN = 64
#: Buckets a group's keys are cut into for running totals.
BUCKETS = 1024


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by the values of ``parts``: 53 bits of their SHA-256, the same on every machine and run."""
    text = F.concat_ws("\x1f", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def running_total(df: DataFrame, group: list[str], key: str, size: Column, tie: Column | str, alias: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``alias``: the sum of ``size`` over the rows of the group whose (key, tie) come before the row's own.

    ``key`` is a number in [0, 1). A group is cut into buckets of the key: bucket totals are summed first (at most
    ``buckets`` rows a group), then only rows of one bucket are ordered together, so a group that holds much of the
    table is spread over as many tasks. Exact for any distribution of the key.
    """
    cut = df.withColumn("_bucket", F.least(F.floor(F.col(key) * buckets), F.lit(buckets - 1)).cast("int")).withColumn("_size", size)
    sums = cut.groupBy(*group, "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_bucket").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(base, [*group, "_bucket"])
    return joined.withColumn(alias, F.col("_base") + F.coalesce(F.sum("_size").over(within), F.lit(0))).drop("_bucket", "_size", "_base")


def table_parts(table: np.ndarray, width: int) -> pa.RecordBatch:
    """A task's table of counts as rows (chunk, task, n): the chunks of ``width`` entries that are not all zero."""
    flat = table.reshape(-1, width)
    some = np.nonzero(flat.any(1))[0]
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "task": pa.array([task] * len(some), pa.int32()), "n": pa.array([flat[i].tobytes() for i in some], pa.binary())})


TABLE_PARTS = "chunk int, task int, n binary"


def summed_table(parts: DataFrame, tasks: int, size: int, width: int, dtype: type) -> np.ndarray:
    """The sum of the tasks' tables, each of ``size`` entries of ``dtype``; sums stop at its largest value.

    Parts are added up in levels of at most FAN_IN, so no task holds more however many there were; the driver gets one
    table of fixed size.
    """
    most = np.iinfo(dtype).max

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for x in rows.n:
            total += np.frombuffer(x, dtype).astype(np.uint64)
        return pd.DataFrame({"chunk": rows.chunk.iloc[:1], "task": rows.task.iloc[:1] // FAN_IN, "n": [np.minimum(total, most).astype(dtype).tobytes()]})

    while True:
        parts = parts.groupBy("chunk", F.floor(F.col("task") / FAN_IN).alias("level")).applyInPandas(add, TABLE_PARTS)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(size, dtype)
    for r in parts.select("chunk", "n").toLocalIterator():
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.n, dtype)
    return out
