import math

import pytest
from pyspark.sql import functions as F

from loomline.functions import config, numeric
from loomline.operators import segments, substitution, tuning


def scores(spark, extra=()):
    rows = [("f", f"n{i}", 0, k, a) for i in range(5) for k, a in ((5, 0.71), (9, 0.84), (12, 0.88))]
    rows += [("f", f"a{i}", 1, k, a) for i in range(5) for k, a in ((5, 0.31), (9, 0.36), (12, 0.39))]
    return spark.createDataFrame([*rows, *extra], "fold_id string, paragraph_id string, label int, top_k int, accuracy double")


def test_threshold_grids():
    assert numeric.threshold_grid(0.86) == pytest.approx([0.76, 0.81, 0.86])
    assert numeric.threshold_grid(0.05)[0] == 0.0
    assert numeric.threshold_grid(0.5, 1) == [0.5]
    assert numeric.wide_threshold_grid(0.9) == pytest.approx([0.85, 0.875, 0.9, 0.925, 0.95])
    assert numeric.wide_threshold_grid(0.99)[-1] == 0.995
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            numeric.threshold_grid(bad)
    with pytest.raises(ValueError):
        numeric.threshold_grid(0.5, 0)
    assert numeric.positive_list("5, 9,12") == [5, 9, 12]
    with pytest.raises(ValueError):
        numeric.positive_list("5,0")


def test_best_cell_breaks_ties_by_k_then_threshold(spark):
    cells = tuning.grid(spark, [5, 9, 12], [0.5, 0.55, 0.6])
    measured = tuning.grid_metrics(scores(spark), cells, ["fold_id"])
    assert measured.count() == 9 and {r.f1 for r in measured.collect()} == {1.0}
    assert tuple(tuning.best_cell(measured, ["fold_id"]).first()) == ("f", 5, 0.6, 1.0)


def test_threshold_is_strict(spark):
    cells = tuning.grid(spark, [5], [0.31])
    r = tuning.grid_metrics(scores(spark), cells, ["fold_id"]).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.f1, r.precision, r.specificity) == (0, 0, 5, 5, 0.0, 0.0, 1.0)


def test_accuracy_lookup(spark):
    df = spark.createDataFrame([([(5, 0.5), (9, 0.6)],)], "r array<struct<top_k:int,accuracy:double>>")
    assert df.select(tuning.accuracy_at("r", 9)).first()[0] == 0.6
    with pytest.raises(Exception, match="k = 7; there is 5, 9"):
        df.select(tuning.accuracy_at("r", 7)).collect()


def test_spread_across_folds(spark):
    values = [0.25 * i * i / 4 for i in range(4)]
    df = spark.createDataFrame([("d", i, 5, 0.5, v, v, v, v) for i, v in enumerate(values)], "d string, fold_id int, top_k int, best_threshold double, precision double, recall double, f1 double, specificity double")
    r = tuning.across_folds(df, ["d"]).first()
    mean = sum(values) / 4
    assert r.std_f1 == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 3)) and r.n_folds == 4
    assert tuning.across_folds(df.limit(1), ["d"]).first().std_f1 == 0.0
    assert tuning.fold_lists(df, ["d"]).first().per_fold["f1"] == values
    assert [r[0] for r in tuning.missing_folds(df.where("fold_id <> 3"), 4).collect()] == [3]


def test_training_log(spark):
    log = spark.createDataFrame([("r", 1, 0.6, 2.0, None), ("r", 2, 1.4, 1.5, None), ("r", 3, 1.0, 1.0, 0.7), ("r", 4, 2.5, 0.9, None), ("r", 5, None, 0.1, None)], "run string, seq int, epoch double, loss double, train_top1_acc double")
    assert sorted((r.epoch, r.loss) for r in tuning.epoch_losses(log, ["run"]).collect()) == [(1, 1.0), (2, 0.9)]
    assert tuning.last_accuracy(log, ["run"]).first().train_top1_acc == 0.7
    assert tuning.last_accuracy(log.where("seq <> 3"), ["run"]).first().train_top1_acc == 0.0
    trials = spark.createDataFrame([("r", 0.3, 1e-5), ("r", 0.2, 1e-4), ("r", 0.2, 1e-3)], "run string, loss double, lr double")
    assert tuning.best_rate(trials, ["run"]).first().lr == 1e-4


def test_weights(spark):
    a = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0), ("b", 0, 0.5)], "name string, idx int, value double")
    b = a.withColumn("value", F.when((F.col("name") == "w") & (F.col("idx") == 1), 2.25).otherwise(F.col("value")))
    assert {r.name: r.divergence for r in tuning.divergence(a, b).collect()} == {"w": 0.25, "b": 0.0}
    with pytest.raises(Exception, match="names or shape"):
        tuning.divergence(a, b.where("name = 'w'")).collect()
    parts = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, bytes binary")
    assert tuning.digest(parts).first()[0] == tuning.digest(parts.orderBy(F.desc("name"))).first()[0] != tuning.digest(parts.limit(1)).first()[0]


def test_floor_division(spark):
    df = spark.createDataFrame([(-1,), (-10,), (9,), (10,)], "x bigint")
    assert [tuple(r) for r in df.select(numeric.floor_div(F.col("x"), 10), numeric.ceil_div(F.col("x"), 10)).collect()] == [(-1, 0), (-1, -1), (0, 1), (1, 1)]


@pytest.mark.parametrize("text,rules,want,n", [
    ("INFO Receiving block blk_123", [("receiving", "acquiring")], "INFO Acquiring block blk_123", 1),
    ("Receiver", [("receive", "get")], "Receiver", 0),
    ("sent: receive,done RECEIVE", [("receive", "get")], "sent: get,done GET", 2),
    ("a b", [("a", "b"), ("b", "c")], "c c", 3),
    ("été a", [("t", "x")], "été a", 0),
    ("foo.bar fooxbar", [("foo.bar", "baz")], "baz fooxbar", 1),
])
def test_substitution(spark, text, rules, want, n):
    df = spark.createDataFrame([("p", [text, None], 1), ("q", None, 0)], "paragraph_id string, lines array<string>, label int")
    out = {r.paragraph_id: r for r in substitution.substitute(df, rules).collect()}
    assert (out["p"].lines, out["p"].n_replaced) == ([want, None], n)
    assert (out["q"].lines, out["q"].n_replaced) == (None, 0)
    assert substitution.substitution_counts(substitution.substitute(df, rules)).first().substitutions == n


def test_lexicon(spark):
    df = spark.createDataFrame([("a", None), ("b", "x_y"), ("c", "C"), ("d", "e")], "verb string, lemma string")
    assert [r.kind for r in substitution.classify(df).collect()] == ["no_lemma", "multi_word", "identity", "accepted"]


def test_segments(spark):
    df = spark.createDataFrame([("p", [str(i) for i in range(25)]), ("q", ["x"]), ("r", [])], "paragraph_id string, lines array<string>")
    out = segments.segments(df, 10).collect()
    assert [(r.first_line, len(r.lines)) for r in out if r.paragraph_id == "p"] == [(0, 10), (5, 10), (10, 10), (15, 10)]
    assert {r.paragraph_id for r in out} == {"p", "q"}
    assert {x for r in out if r.paragraph_id == "p" for x in r.lines} == {str(i) for i in range(25)}
    assert segments.pooled(spark.createDataFrame([("p", 0.1), ("p", 0.4)], "paragraph_id string, s double"), "s").first().s == 0.4


def test_configuration(tmp_path):
    base = {"dataset": "bgl", "masking": {"sentence_mask_ratio": "0.5e0"}, "backbone": {"roberta_id": "roberta-base", "longformer_id": "long/longformer"}}
    assert config.run_config(base).backbone == "roberta-base" and config.run_config(base).sentence_mask_ratio == 0.5
    assert config.resolve_backbone(base | {"training": {"use_longformer": True}}) == "long/longformer"
    decision = tmp_path / "d.json"
    with pytest.raises(FileNotFoundError):
        config.resolve_backbone(base, decision)
    decision.write_text('{"chosen_backbone": "x/roberta"}')
    assert config.resolve_backbone(base, decision) == "x/roberta"
    assert config.resolve_backbone(base | {"training": {"backbone": "mine"}}, decision) == "mine"
    assert config.token_limit("X/Longformer-4096-roberta") == 4096 and config.physical_batch("roberta-base") == 8
    with pytest.raises(ValueError):
        config.token_limit("bert")
    assert config.batch_sizes(32, 8) == (8, 4) and config.steps_per_epoch(33, 8, 2) == 3 and config.steps_per_epoch(0, 8, 2) == 1
    with pytest.raises(ValueError):
        config.batch_sizes(30, 8)
