"""Exact ranks in a seeded random order, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, where the size of a group is known, and buckets of a group where it is not.
BUCKET_ROWS, BUCKETS = 1 << 18, 4096


def shuffled(seed: Column, key: Column) -> Column:
    """The sort key of a seeded shuffle: the same in every engine that has MD5."""
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def _marked(df: DataFrame, seed: Column, key: str, size: Column | None) -> DataFrame:
    """``df`` with ``_order``, the digest as 16 bytes, and ``_bucket``, the part of the order it lies in: as many parts as ``size`` calls for."""
    n = F.lit(BUCKETS) if size is None else F.greatest(F.lit(1), F.ceil(size / BUCKET_ROWS))
    digest = shuffled(seed, F.col(key))
    part = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") * n / (1 << 32)).cast("bigint")
    return df.withColumns({"_order": F.unhex(digest), "_bucket": part})


def shuffle_rank(df: DataFrame, group: list[str], seed: Column, key: str, alias: str, size: Column | None = None) -> DataFrame:
    """Adds ``alias``: the row's place (from 0) in its group's order by (shuffled, key).

    A group is cut into buckets of the order; buckets are counted, and only the rows of one are sorted together.
    ``size`` is the number of rows of the row's group, as far as known: small groups then need but one bucket.
    """
    marked = _marked(df, seed, key, size)
    counts = marked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = [f"_own{i}" for i in range(len(group))]
    base = counts.select(*(F.col(g).alias(o) for g, o in zip(group, own)), F.col("_bucket").alias("_cut"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_bucket").orderBy("_order", key)
    same = F.col("_bucket") == F.col("_cut")
    for g, o in zip(group, own):
        same = same & F.col(g).eqNullSafe(F.col(o))
    joined = marked.join(base, same)
    return joined.withColumn(alias, F.col("_base") + F.row_number().over(within) - 1).drop("_order", "_bucket", "_base", "_cut", *own)


def first_rows(df: DataFrame, group: list[str], seed: Column, key: str, most: Column, alias: str, size: Column | None = None) -> DataFrame:
    """The rows that :func:`shuffle_rank` ranks below ``most`` (one number a group), with that rank.

    Buckets are counted where the rows lie; only the rows of those that reach below ``most`` are moved and ordered.
    """
    marked = _marked(df, seed, key, size).withColumn("_most", most)
    counts = marked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("_most").alias("_need"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_base < _need").select(*group, "_bucket", "_base")
    within = Window.partitionBy(*group, "_bucket").orderBy("_order", key)
    ranked = marked.join(base, [*group, "_bucket"]).withColumn(alias, F.col("_base") + F.row_number().over(within) - 1)
    return ranked.where(F.col(alias) < F.col("_most")).drop("_order", "_bucket", "_base", "_most")


def top_rows(df: DataFrame, group: list[str], order: list[Column], k: int, salt: Column, alias: str, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group with their rank (from 1). Salted first, so a large group is cut down before it meets."""
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    few = df.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts))).withColumn(alias, F.row_number().over(part)).where(F.col(alias) <= k)
    whole = Window.partitionBy(*group).orderBy(*order)
    return few.drop("_salt", alias).withColumn(alias, F.row_number().over(whole)).where(F.col(alias) <= k)
