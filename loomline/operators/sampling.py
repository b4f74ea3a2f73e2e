"""Seeded samples and folds: identical for every partitioning, as their order is a digest of seed and id.

Each stream has a seed of its own, so a budget of one leaves the others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.ranking import first_rows, shuffle_rank
from loomline.sources.shared import written

# What is added to a seed for each stream.
CAP_ANOMALY, TRAIN, TUNE_NORMAL, TUNE_ANOMALY, TEST_ANOMALY = 1000, 0, 2000, 3000, 4000
#: Groups whose plan is broadcast at most (a few MB).
MAX_BROADCAST_GROUPS = 50_000
BUDGETS = ("train_normal_per_fold", "tune_normal_per_fold", "tune_anomaly_per_fold", "test_anomaly_per_fold")


def _seed(offset: int, *more: Column) -> Column:
    out = F.col("seed") + offset
    for x in more:
        out = out + x
    return out


def capped(paragraphs: DataFrame, caps: DataFrame, group: list[str]) -> DataFrame:
    """Paragraphs of each group and label, at most as many as its cap; all, where the cap is not exceeded.

    ``caps``: group, seed, max_normal, max_anomaly (one row a group). Normal and anomalous paragraphs are drawn by
    separate seeds. A negative cap raises; a null one is none. Paragraphs without label are left out.
    """
    small = F.least(F.col("max_normal"), F.col("max_anomaly"))
    checked = caps.withColumn("max_normal", F.when(small < 0, F.raise_error(F.lit("a cap is negative"))).otherwise(F.col("max_normal")))
    joined = paragraphs.where("label is not null").join(_small(checked.select(*group, "seed", "max_normal", "max_anomaly")), group)
    seed = F.col("seed") + F.when(F.col("label") == 1, CAP_ANOMALY).otherwise(0)
    cap = F.when(F.col("label") == 0, F.col("max_normal")).otherwise(F.col("max_anomaly"))
    return first_rows(joined, [*group, "label"], seed, "paragraph_id", F.coalesce(cap, F.lit(2**62)), "_rank").drop("_rank", "seed", "max_normal", "max_anomaly")


def cap_summary(paragraphs: DataFrame, caps: DataFrame, group: list[str]) -> DataFrame:
    """Paragraphs before and after :func:`capped`, by label, and whether a cap applied."""
    n = lambda v: F.count_if(F.col("label") == v)
    counts = paragraphs.groupBy(*group).agg(n(0).alias("input_normal"), n(1).alias("input_anomaly")).join(caps.select(*group, "max_normal", "max_anomaly"), group)
    out = lambda kind: F.least(F.col(f"input_{kind}"), F.coalesce(F.col(f"max_{kind}"), F.col(f"input_{kind}")))
    return counts.select(*group, "input_normal", "input_anomaly", *(out(k).alias(f"output_{k}") for k in ("normal", "anomaly")), *((out(k) < F.col(f"input_{k}")).alias(f"{k}_was_capped") for k in ("normal", "anomaly")))


def assign_folds(paragraphs: DataFrame, plan: DataFrame, group: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Normal paragraphs with ``fold``: their place in the seeded order modulo the number of folds.

    ``plan``: group, seed, n_folds. Fewer than two folds raise. ``sizes``: group, _n0 (its normal paragraphs), where known.
    """
    checked = plan.select(*group, "seed", F.when(F.col("n_folds") < 2, F.raise_error(F.lit("folds need to be two or more"))).otherwise(F.col("n_folds")).alias("n_folds"))
    normal = paragraphs.where("label = 0").join(_small(checked), group)
    if sizes is not None:
        normal = normal.join(_small(sizes), group)
    ranked = shuffle_rank(normal, group, F.col("seed"), "paragraph_id", "_rank", None if sizes is None else F.col("_n0"))
    return ranked.withColumn("fold", (F.col("_rank") % F.col("n_folds")).cast("int")).drop("_rank", "_n0")


def shares(pool: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two budgets, scaled down in proportion where the pool is smaller than both together."""
    short = (pool < a + b) & (a + b > 0)
    first = F.when(short, F.expr("0") + F.floor(pool * a / F.when(a + b > 0, a + b))).otherwise(a)
    return first, F.when(short, pool - first).otherwise(b)


def _carve(pool: DataFrame, key: list[str], offsets: tuple[int, int], streams: tuple[str, str]) -> DataFrame:
    """Two disjoint streams of each fold's pool: the first ``_first`` of one order, then the first ``_second`` of another without those."""
    seeds = [_seed(x, F.col("fold_id")) for x in offsets]
    size = F.col("_pool")
    one = written(first_rows(pool, key, seeds[0], "paragraph_id", F.col("_first"), "pos", size).select(*key, "pos", "paragraph_id"), "stream")
    # Of the first rows of the other order at most _first are taken, so there are enough among these.
    near = first_rows(pool, key, seeds[1], "paragraph_id", F.col("_first") + F.col("_second"), "_at", size).drop("_at")
    rest = near.join(one.select(*key, "paragraph_id"), [*key, "paragraph_id"], "left_anti")
    two = first_rows(rest, key, seeds[1], "paragraph_id", F.col("_second"), "pos", size).select(*key, "pos", "paragraph_id")
    return one.select(F.lit(streams[0]).alias("stream"), "*").unionByName(two.select(F.lit(streams[1]).alias("stream"), "*"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast, if it has at most MAX_BROADCAST_GROUPS rows; as it is (for a shuffle), if more."""
    rows = df.limit(MAX_BROADCAST_GROUPS + 1).collect()
    return df if len(rows) > MAX_BROADCAST_GROUPS else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def create_splits(paragraphs: DataFrame, plan: DataFrame, group: list[str]) -> DataFrame:
    """Folds in long form: group, fold_id, seed, stream, pos, paragraph_id.

    ``plan``: group, seed, n_folds and the four budgets. A fold's test normals are its own part, in input order (ord);
    its training and tuning normals come from the other parts, its anomalies from all of them. What several folds read
    is written to the shared folder once.
    """
    narrow = written(paragraphs.where("label is not null").select(*group, "paragraph_id", "label", "ord"), "labelled")
    low = F.least(*BUDGETS)
    checked = F.when(low < 0, F.raise_error(F.lit("a budget is negative"))).otherwise(F.col(BUDGETS[0]))
    # Sizes are counted per group; those of folds follow from them.
    sizes = narrow.groupBy(*group).agg(F.count_if(F.col("label") == 0).alias("_n0"), F.count_if(F.col("label") == 1).alias("_n1"))
    budgets = _small(plan.select(*group, "seed", "n_folds", *BUDGETS).withColumn(BUDGETS[0], checked).join(sizes, group))
    folds = F.explode(F.sequence(F.lit(0), (F.col("n_folds") - 1).cast("int"))).alias("fold_id")
    key = [*group, "fold_id"]
    own = F.floor((F.col("_n0") - F.col("fold_id") + F.col("n_folds") - 1) / F.col("n_folds"))

    def drawn(rows: DataFrame, size: Column, names: tuple[str, str]) -> DataFrame:
        """``rows`` of each fold with its seed and what its two streams take; joined before folds are told apart."""
        first, second = shares(F.col("_pool"), *map(F.col, names))
        each = rows.join(budgets, group).select("*", folds).withColumn("_pool", size)
        return each.withColumns({"_first": first, "_second": second})

    placed = written(assign_folds(narrow, plan, group, sizes=budgets.select(*group, "_n0")).select(*group, "paragraph_id", "ord", "fold"), "folds")
    needed = (*key, "paragraph_id", "seed", "_pool", "_first", "_second")
    others = drawn(placed.drop("ord"), F.col("_n0") - own, BUDGETS[:2]).where("fold <> fold_id").select(*needed)
    normal = _carve(others, key, (TRAIN, TUNE_NORMAL), ("train_normal_ids", "tune_normal_ids"))
    pool = drawn(narrow.where("label = 1").select(*group, "paragraph_id"), F.col("_n1"), BUDGETS[2:]).select(*needed)
    anomaly = _carve(pool, key, (TUNE_ANOMALY, TEST_ANOMALY), ("tune_anomaly_ids", "test_anomaly_ids"))
    test = placed.select(F.lit("test_normal_ids").alias("stream"), *group, F.col("fold").alias("fold_id"), F.col("ord").alias("pos"), "paragraph_id")
    out = normal.unionByName(anomaly).unionByName(test).join(budgets.select(*group, F.col("seed").alias("_seed")), group)
    return out.select(*key, (F.col("_seed") + F.col("fold_id")).alias("seed"), "stream", "pos", "paragraph_id")


def fold_sizes(splits: DataFrame, group: list[str]) -> DataFrame:
    """Rows of each stream, totals and anomaly rates of each fold."""
    streams = ("train_normal_ids", "tune_normal_ids", "tune_anomaly_ids", "test_normal_ids", "test_anomaly_ids")
    n = lambda s: F.count_if(F.col("stream") == s)
    wide = splits.groupBy(*group, "fold_id").agg(*(n(s).alias(s.removesuffix("_ids")) for s in streams))
    total = lambda k: F.col(f"{k}_normal") + F.col(f"{k}_anomaly")
    rate = lambda k: F.coalesce(F.try_divide(F.col(f"{k}_anomaly").cast("double"), total(k).cast("double")), F.lit(0.0))
    return wide.select("*", total("tune").alias("tune_total"), total("test").alias("test_total"), rate("tune").alias("tune_anomaly_rate"), rate("test").alias("test_anomaly_rate"))


def stream_overlaps(splits: DataFrame, group: list[str]) -> DataFrame:
    """(group, fold_id, left, right, n): ids that stand in two streams of one fold; no rows if all are disjoint."""
    per = splits.groupBy(*group, "fold_id", "paragraph_id").agg(F.sort_array(F.collect_set("stream")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("left"), y.alias("right")))))
    return per.select(*group, "fold_id", F.explode(pairs).alias("p")).groupBy(*group, "fold_id", "p.left", "p.right").agg(F.count(F.lit(1)).alias("n"))
