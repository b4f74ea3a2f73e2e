"""Caps, folds and splits of every artifact, where a data set has several."""

import pytest
from pyspark.sql import functions as F

from loomline.plans import reference
from oracle import rows

NAMES = ("capped_paragraphs", "cap_summary", "fold_assignment", "created_splits")


@pytest.fixture(scope="module")
def several(spark, tmp_path_factory):
    """Two artifacts of data set x, with batches 0-1 and 2-3, and one of y; x also has batch 4, which none covers."""
    d = str(tmp_path_factory.mktemp("several"))
    rows = [(f"{s}{b}_{i}", s, int(i % 4 == 0), i + 100 * b, b) for s, last in (("x", 4), ("y", 1)) for b in range(last + 1) for i in range(20)]
    p = spark.createDataFrame(rows, "paragraph_id string, dataset string, label int, ord bigint, batch_no bigint")
    p.union(p.limit(3)).withColumn("lines", F.array(F.lit("a"))).write.parquet(f"{d}/paragraphs.parquet")
    budgets = "train_normal_per_fold int, tune_normal_per_fold int, tune_anomaly_per_fold int, test_anomaly_per_fold int"
    plans = [("x_0", "x", 0, 1, 2, 5, 8, 4, 3, 3), ("x_2", "x", 2, 3, 3, 6, 9, 5, 2, 9), ("y_0", "y", 0, 1, 2, 5, 7, 3, 3, 2)]
    spark.createDataFrame(plans, f"artifact_id string, dataset string, batch_from bigint, batch_to bigint, n_folds int, seed bigint, {budgets}").write.parquet(f"{d}/splits_artifacts.parquet")
    caps = [("x_0", 5, 7, 2), ("x_2", 6, None, 4), ("y_0", 5, 99, 3)]
    spark.createDataFrame(caps, "artifact_id string, seed bigint, max_normal bigint, max_anomaly bigint").write.parquet(f"{d}/subsample_summaries.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_every_artifact_over_its_own_batches(spark, several, name):
    import duckdb

    con = duckdb.connect()
    for t in ("paragraphs", "splits_artifacts", "subsample_summaries"):
        con.execute(f"create view {t} as select * from read_parquet('{several}/{t}.parquet/*.parquet')")
    want = con.execute(reference.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = reference.QUERIES[name](spark, several)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_counts_by_hand(spark, several):
    q = lambda name: reference.QUERIES[name](spark, several)
    got = {r.artifact_id: (r.input_normal, r.input_anomaly, r.output_normal, r.output_anomaly) for r in q("cap_summary").collect()}
    assert got == {"x_0": (30, 10, 7, 2), "x_2": (30, 10, 30, 4), "y_0": (30, 10, 30, 3)}
    capped = {(r.artifact_id, r.label): r["count"] for r in q("capped_paragraphs").groupBy("artifact_id", "label").count().collect()}
    assert capped == {("x_0", 0): 7, ("x_0", 1): 2, ("x_2", 0): 30, ("x_2", 1): 4, ("y_0", 0): 30, ("y_0", 1): 3}
    folds = q("fold_assignment")
    assert {(r.artifact_id, r.batch) for r in folds.select("artifact_id", F.substring("paragraph_id", 1, 2).alias("batch")).distinct().collect()} == {("x_0", "x0"), ("x_0", "x1"), ("x_2", "x2"), ("x_2", "x3"), ("y_0", "y0"), ("y_0", "y1")}
    assert {r.artifact_id: r.n for r in folds.groupBy("artifact_id").agg(F.countDistinct("fold").alias("n")).collect()} == {"x_0": 2, "x_2": 3, "y_0": 2}
    assert {r.artifact_id: r.n for r in q("created_splits").where("stream = 'test_normal_ids'").groupBy("artifact_id").agg(F.count("*").alias("n")).collect()} == {"x_0": 30, "x_2": 30, "y_0": 30}


def test_first_rows_are_those_of_the_whole_order(spark):
    from loomline.operators.ranking import first_rows, shuffle_rank

    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("g"), F.lit("x").alias("_other"))
    most = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 17).otherwise(5000)
    want = shuffle_rank(df, ["g"], F.col("g"), "id", "r").where(F.col("r") < most)
    got = first_rows(df, ["g"], F.col("g"), "id", most, "r")
    assert sorted(got.columns) == sorted(want.columns) and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 1017
    for size in (F.lit(1), F.lit(3 << 18)):
        again = first_rows(df, ["g"], F.col("g"), "id", most, "r", size)
        assert sorted(map(tuple, again.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
