import pytest

from loomline.operators import scoring
from loomline.plans import pipeline


def test_first_five_faulty_ids(spark):
    ids = [("A", 0, 0, i, f"m{i}") for i in range(9, -1, -1)] + [("A", 0, c, i, f"p{i}") for i in range(7) for c in (0, 1)] + [("A", 1, 0, 0, "p0"), ("A", 1, 0, 1, None)]
    df = spark.createDataFrame(ids, "artifact_id string, fold_id int, class int, pos bigint, paragraph_id string").repartition(5)
    paragraphs = spark.createDataFrame([(f"p{i}",) for i in range(7)] * 2, "paragraph_id string")
    got = {r.fold_id: tuple(r)[2:] for r in scoring.id_faults(df, paragraphs, ["artifact_id"]).collect()}
    assert got == {0: (10, 7, [f"m{i}" for i in range(5)], [f"p{i}" for i in range(5)]), 1: (1, 0, [], [])}


def test_score_names_the_ids(spark, tmp_path):
    spark.createDataFrame([("p", 0, ["a"])], "paragraph_id string, label int, lines array<string>").write.parquet(f"{tmp_path}/paragraphs")
    splits = spark.createDataFrame([(0, s, 0, p) for s, p in (("tune_normal_ids", "p"), ("tune_normal_ids", "gone"), ("tune_anomaly_ids", "p"))], "fold_id int, stream string, pos bigint, paragraph_id string")
    with pytest.raises(ValueError, match=r"1 ids without paragraph \(first: gone\), 1 repeated \(first: p\)"):
        pipeline.score(spark, str(tmp_path), splits, 0, None, str(tmp_path))
