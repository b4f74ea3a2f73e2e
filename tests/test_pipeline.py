import json

import pytest

from loomline.functions.numeric import threshold_grid
from loomline.operators import quality, scoring
from loomline.plans import pipeline as P


@pytest.fixture(scope="module")
def windows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("windows")
    lines = []
    for w in range(60):
        for i in range(6):
            odd = w % 6 == 0 and i % 2 == 0
            lines.append(f"{'APPSEV' if odd else '-'} {1000 + w * 10 + i} 2005.06.03 node RAS KERNEL {'FATAL panic' if odd else 'INFO all is'} {'halted now' if odd else 'well here'}")
    (root / "log.txt").write_text("\n".join(lines) + "\n")
    return root, P.prepare_windows(spark, str(root / "log.txt"), "bgl", 10, str(root / "out"))


def test_from_log_to_results(spark, windows):
    root, summary = windows
    assert (summary["total"], summary["normal"], summary["anomaly"], summary["flags"]) == (60, 50, 10, [])
    assert json.loads((root / "out" / "preparation_summary.json").read_text())["drop_counters"]["total_lines_read"] == 360
    gate = P.gate(spark, str(root / "out"), "roberta-base")
    assert gate["flags"] == [] and gate["distribution"]["max"] == 1 + 6 * 11
    assert P.choose(spark, str(root / "out"))["chosen_backbone"] == "roberta-base"
    assert P.choose(spark, str(root / "out"), tokens=True)["rationale"].startswith("p80(token_length) = 67.0 <= threshold 512")
    assert P.subsample(spark, str(root / "out"), str(root / "few"), 40, 10)["output_normal"] == 40
    splits = P.make_splits(spark, str(root / "few"), str(root / "few"), 2, (15, 5, 5, 5))
    paragraphs = spark.read.parquet(str(root / "few" / "paragraphs"))
    parts = []
    for k in range(2):
        train = paragraphs.join(P.fold(splits, k).where("stream = 'train_normal_ids'").select("paragraph_id"), "paragraph_id")
        parts.append(P.score(spark, str(root / "few"), splits, k, scoring.BigramScorer(train), str(root / "few"), n_passes=2))
    measured, spread = P.evaluate(parts[0].unionByName(parts[1]), threshold_grid(1.0), 2)
    assert measured.count() == 2 and spread.first().n_folds == 2 and 0 < spread.first().mean_f1 <= 1
    with pytest.raises(ValueError, match="no scores of folds"):
        P.evaluate(parts[0], threshold_grid(1.0), 2)
    with pytest.raises(ValueError, match="no fold 9"):
        P.fold(splits, 9)


def test_bad_lines_stop_the_run(spark, tmp_path):
    (tmp_path / "log.txt").write_text("- 1000 2005 x\n- 1001 2005 x\n- bad time x\n")
    with pytest.raises(quality.HardFailure, match="bad_lines"):
        P.prepare_windows(spark, str(tmp_path / "log.txt"), "bgl", 10, str(tmp_path / "out"))
    assert "bad_lines" in P.prepare_windows(spark, str(tmp_path / "log.txt"), "bgl", 10, str(tmp_path / "out"), warn_only=True)["flags"]


def test_sessions(spark, tmp_path):
    (tmp_path / "log.txt").write_text("081109 1 INFO blk_1 a\n081109 2 INFO none\n081109 3 WARN blk_2 b blk_1\n")
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\nblk_3,Normal\n")
    summary = P.prepare_sessions(spark, str(tmp_path / "log.txt"), str(tmp_path / "labels.csv"), str(tmp_path / "out"))
    assert (summary["total"], summary["anomaly"], summary["flags"]) == (2, 1, ["multi_entity"])
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_1,Normal\n")
    with pytest.raises(quality.HardFailure, match="missing_labels"):
        P.prepare_sessions(spark, str(tmp_path / "log.txt"), str(tmp_path / "labels.csv"), str(tmp_path / "out"))


def test_variation(spark):
    lexicon = spark.createDataFrame([("sent", "mailed"), ("got", None), ("saw", "saw")], "verb string, lemma string")
    train = spark.createDataFrame([("t", 0, ["we sent it", "got Sent saw"])], "paragraph_id string, ord int, lines array<string>")
    out, report = P.vary(train, train, lexicon, 5)
    assert out.first().lines == ["we mailed it", "got Mailed saw"]
    assert report == {"top_verbs": ["sent", "got", "saw"], "rules": {"sent": "mailed"}, "no_lemma": ["got"], "multi_word": [], "identity": ["saw"], "modified_paragraphs": 1, "substitutions": 2}
