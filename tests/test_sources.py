import json

import pytest
from pyspark.sql import functions as F

from loomline.sources import artifacts, text_log


def test_lines_are_numbered_within_each_file(spark, tmp_path):
    for name, n in (("a.log", 500), ("b.log", 3)):
        (tmp_path / name).write_bytes(b"".join(b"%d \xff\r\n" % i if i % 2 else b"%d ok\n" % i for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = text_log.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 503
    assert all(r.text == (f"{r.line_no} \N{REPLACEMENT CHARACTER}" if r.line_no % 2 else f"{r.line_no} ok") for r in got)


def test_labels(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("BlockId , Label\nblk_1, Normal\nblk_2 ,Anomaly \n")
    assert [tuple(r) for r in text_log.read_labels(spark, str(f)).collect()] == [("blk_1", "Normal"), ("blk_2", "Anomaly")]
    f.write_text("BlockId,Label\nblk_0,Normal\n blk_1 , Odd \n")
    with pytest.raises(ValueError, match="'Odd' of blk_1 at row 3"):
        text_log.read_labels(spark, str(f))
    f.write_text("blockid,label\nblk_1,Normal\n")
    with pytest.raises(ValueError, match="BlockId"):
        text_log.read_labels(spark, str(f))


def score(accuracies):
    return {"split_name": "test", "topk_grid": [5], "n_passes": 1, "scores": [{"paragraph_id": "p", "label": 1, "topk_accuracies": accuracies, "n_masked_total": 3, "n_passes": 1}]}


def test_scores_and_fold_layout(spark, tmp_path):
    artifacts.save_json(score([{"top_k": 5, "accuracy": 0.5}]), tmp_path / "fold_3" / "scores_test.json")
    r = artifacts.read_scores(spark, str(tmp_path / "*" / "scores_test.json")).withColumn("fold_id", artifacts.fold_of()).first()
    assert (r.fold_id, r.split_name, r.top_k, r.accuracy, r.n_masked_total) == (3, "test", 5, 0.5, 3)
    for bad in (score({"5": 0.5}), {"split_name": "test"}):
        artifacts.save_json(bad, tmp_path / "bad.json")
        with pytest.raises(Exception, match="no scores"):
            artifacts.read_scores(spark, str(tmp_path / "bad.json")).collect()


def test_grids(spark, tmp_path):
    cell = {"top_k": 5, "threshold": 0.5, "precision": 1.0, "recall": 1.0, "f1": 1.0, "specificity": 1.0}
    artifacts.save_json({"cells": [cell], "best_top_k": 5, "best_threshold": 0.5, "train_top1_acc": 0.8}, tmp_path / "g.json")
    r = artifacts.read_grids(spark, str(tmp_path / "g.json")).first()
    assert (r.best_top_k, r.top_k, r.tp, r.fn) == (5, 5, 0, 0)
    artifacts.save_json({"cells": [cell], "best_threshold": 0.5}, tmp_path / "g.json")
    with pytest.raises(Exception, match="best_top_k, train_top1_acc"):
        artifacts.read_grids(spark, str(tmp_path / "g.json")).collect()


def test_splits_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 7, "train_normal_ids", 1, "y"), ("a", 0, 7, "train_normal_ids", 0, "x"), ("a", 1, 8, "test_anomaly_ids", 0, "z")], "k string, fold_id int, seed bigint, stream string, pos int, paragraph_id string")
    (tmp_path / "s.json").write_text(artifacts.splits_json(rows, ["k"]).first().value)
    back = artifacts.read_splits(spark, str(tmp_path / "s.json")).drop("file")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r)[1:] for r in rows.collect())


def test_json_files(spark, tmp_path):
    f = artifacts.save_json({"a": 1}, tmp_path / "x" / "p.json")
    artifacts.upsert_json(f, "token_length_distribution", {"max": 3})
    assert json.loads(f.read_text()) == {"a": 1, "token_length_distribution": {"max": 3}}
    assert artifacts.length_summary(f, tokens=True) == {"max": 3}
    with pytest.raises(ValueError):
        artifacts.length_summary(f)
    alone = artifacts.upsert_json(tmp_path / "no.json", "t", {"max": 4}, tmp_path / "t.json")
    assert json.loads(alone.read_text()) == {"max": 4}
    assert artifacts.target_file("out", "g.json").name == "g.json" and artifacts.target_file("a.json", "g.json").name == "a.json"
    artifacts.write_table(spark.range(3).withColumn("split", F.lit("t")), str(tmp_path / "t"), ["split"])
    assert artifacts.file_digests(spark, str(f)).count() == 1


def test_intermediate_tables_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from loomline.sources import shared

    monkeypatch.setattr(shared, "_named", lambda _: f"{tmp_path}/named/")
    kept, own = shared.written(spark.range(5), "numbers"), tmp_path / "named" / "loomline" / spark.sparkContext.applicationId
    assert kept.count() == 5 and list(own.glob("numbers-*"))
    shared.clean(spark)
    assert not own.exists()
    monkeypatch.setattr(shared, "_named", lambda _: None)
    monkeypatch.setattr(shared, "_local", [str(tmp_path)])
    assert shared.scratch(spark, "x").startswith(f"{tmp_path}/loomline/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.scratch(spark, "x")
