"""Problem 1: a sample that stays the same at every run and row order, and only grows as data does.

Permanent random numbers: an identifier gets a number in [0, 1) when it is first seen, kept in a registry; later loads
add only identifiers the registry lacks. The sample is every identifier under a threshold that never falls. Both are
kept in the registry's folder and taken up again by a later run that opens it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import scratch, uniform


class Registry:
    """Numbers of identifiers per seed, as parquet in one folder: a part per load (``load=...``), never rewritten.

    Opening a folder takes up the parts and the threshold that are there. One run writes to it at a time; a second
    one that would write the same part raises.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path
        names = self._names()
        # The rows of a load that broke off are as good as any: what it lacks is inserted by the next one.
        self.loads = [f"{path}/{n}" for n in sorted(names, key=_number) if _number(n) >= 0]
        self.at = spark.read.schema("at double").json(f"{path}/threshold").agg({"at": "max"}).first()[0] or 0.0 if "threshold" in names else 0.0

    SCHEMA = "seed bigint, id string, number double"

    def _names(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def read(self) -> DataFrame:
        if not self.loads:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*self.loads)

    def add(self, ids: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
        """Registers what is new in ``ids`` (seed, id), each pair once, and returns the registry after it.

        Null seeds or ids are left out; repeated rows and rows known from an earlier load change nothing.
        """
        fresh = ids.select(F.col("seed").cast("bigint").alias("seed"), F.col("id").cast("string").alias("id")).where("seed is not null and id is not null").distinct()
        if self.loads:
            fresh = fresh.join(self.read().select("seed", "id"), ["seed", "id"], "left_anti")
        target = f"{self.path}/load={_number(self.loads[-1]) + 1 if self.loads else 0:06d}"
        # The number is a digest of seed and id, so a task that is repeated after a lost executor writes the same.
        fresh.withColumn("number", uniform("seed", "id")).write.parquet(target)
        self.loads.append(target)
        return self.read()

    def raise_threshold(self, wanted: float) -> float:
        """The threshold from now on, by :func:`threshold`; kept beside the parts."""
        at = threshold(self.at, wanted)
        if at > self.at:
            self.spark.range(0, 1, 1, 1).select(F.lit(at).alias("at")).write.mode("append").json(f"{self.path}/threshold")
            self.at = at
        return at


def _number(part: str) -> int:
    """The number of a part, by its name or path; -1 for anything else."""
    found = re.search(r"load=(\d+)$", part)
    return int(found[1]) if found else -1


def threshold(previous: float, wanted: float) -> float:
    """The next threshold: never lower than the one before, within [0, 1]."""
    return min(1.0, max(previous, wanted))


def select(registry: DataFrame, at: float) -> DataFrame:
    """(seed, id) of the identifiers under the threshold."""
    return registry.where(F.col("number") < at).select("seed", "id")


def grow(ids: DataFrame, loads: list[tuple[int, int]], share: float = 0.1, name: str = "registry", path: str | None = None) -> DataFrame:
    """(seed, id, number, first_load, selected) after ``ids`` (seed, id, batch_no) were loaded in the given batch ranges in turn.

    Each load registers its identifiers by an anti-join insert; the threshold follows :func:`threshold`. An empty
    table gives an empty result; other columns are ignored; null seeds, ids or batches are left out. ``path`` is the
    folder of a registry that outlives the call: what an earlier call left there is kept and part of the result, and
    its threshold holds; without one the registry is new.
    """
    registry = Registry(ids.sparkSession, path or scratch(ids.sparkSession, name))
    for low, high in loads:
        registry.add(ids.where(F.col("batch_no").between(low, high)))
    at = registry.raise_threshold(share) if loads else registry.at
    # The load is told by the part a row was written in.
    load = F.regexp_extract(F.input_file_name(), r"load=(\d+)", 1).cast("int")
    return registry.read().withColumn("first_load", load).withColumn("selected", F.col("number") < at)
