"""Exact results of operators that never put a group into one task, and of rules by the hundred."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import config
from loomline.operators import masking, profile, quality, scoring, substitution, tuning


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0], [0.5, -2.0, 7.25, 7.25, 1e9], np.random.default_rng(1).lognormal(0, 3, 500).tolist(), [0.1] * 99 + [0.2]])
def test_quantiles(spark, values):
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    rows = [(x,) for x in values] + [(None,)]
    got = profile.quantiles(profile.value_counts(spark.createDataFrame(rows, "x double"), "x"), shares, buckets=16).first().p
    assert got == [None] * 5 if not values else np.allclose(got, np.quantile(values, shares), rtol=1e-12)


@pytest.mark.parametrize("word,want", [("sent", "mailed"), ("SENT", "MAILED"), ("Sent", "Mailed"), ("SeNt", "mailed"), ("sENT", "mailed"), ("SEnt", "mailed")])
def test_case_is_carried_over(spark, word, want):
    df = spark.createDataFrame([("p", [word])], "paragraph_id string, lines array<string>")
    assert substitution.substitute(df, [("sent", "mailed")]).first().lines == [want]
    assert substitution.substitute(df, [("sent", "mailed"), ("x.y", "z")]).first().lines == [want]
    assert df.select(substitution.keep_case(F.lit(word), F.lit("mailed"))).first()[0] == want


def test_one_letter_is_neither_capitals_nor_title(spark):
    df = spark.createDataFrame([("p", ["A a"])], "paragraph_id string, lines array<string>")
    assert substitution.substitute(df, [("a", "bc")]).first().lines == ["bc bc"]
    assert df.select(substitution.keep_case(F.lit("A"), F.lit("bc"))).first()[0] == "bc"


def test_many_rules_equal_the_patterns_one_after_another(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)] + ["é", "İx", "ß"]
    rules = [(words[a], words[b]) for a, b in rng.integers(0, len(words), (1000, 2))]
    lines = [" ".join(rng.choice([w, w.upper(), w.capitalize(), w + "x"]) for w in rng.choice(words, 40)) for _ in range(50)]
    token, pattern = substitution._by_token(rules), substitution._by_pattern(rules)
    ascii_only = [x for x in lines if x.isascii()]
    assert ascii_only and [token(x) for x in ascii_only] == [pattern(x) for x in ascii_only]
    df = spark.createDataFrame([("p", lines)], "paragraph_id string, lines array<string>")
    assert substitution.substitute(df, rules).first().n_replaced == sum(token(x)[1] for x in lines)


def _scores(spark, ks=(5,)):
    rng = np.random.default_rng(5)
    rows = [(f"a{a}", f, s, f"p{i}", int(rng.integers(2)), k, float(rng.integers(100) / 100)) for a in range(2) for f in range(3) for s in ("tune", "test", "train") for i in range(20) for k in ks]
    return spark.createDataFrame(rows, "artifact_id string, fold_id int, split string, paragraph_id string, label int, top_k int, accuracy double")


def test_a_k_that_was_not_scored_raises(spark):
    scores, keys = _scores(spark), ["artifact_id", "fold_id"]
    cells = tuning.grid(spark, [5, 9], [0.5])
    for run in (lambda: tuning.grid_metrics(scores, cells, keys), lambda: tuning.tuned_metrics(scores, cells, keys), lambda: tuning.grid_metrics(scores, tuning.grid(spark, [9], [0.5]), []), lambda: tuning.tuned_metrics(scores, tuning.grid(spark, [9], [0.5]), keys)):
        with pytest.raises(Exception, match="no accuracy for k = 9; there is"):
            run().collect()
    empty = scores.limit(0)
    assert tuning.grid_metrics(empty, cells, keys).collect() == [] and tuning.tuned_metrics(empty, cells, keys).collect() == []


def test_tuning_and_test_in_one_pass(spark):
    scores, keys = _scores(spark, (5, 9, 12)), ["artifact_id", "fold_id"]
    cells = tuning.grid(spark, [5, 9], [0.3, 0.5, 0.7])
    measured = tuning.grid_metrics(scores.where("split = 'tune' and top_k < 12"), cells, keys).withColumn("f1", F.round("f1", 9))
    want = tuning.fold_metrics(scores.where("split = 'test'"), tuning.best_cell(measured, keys), keys)
    got = tuning.tuned_metrics(scores, cells, keys)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() == 6
    assert tuning.tuned_metrics(scores.where("split = 'tune'"), cells, keys).collect() == []
    assert tuning.scored_k(scores) == [5, 9, 12]


def test_training_gate_and_subset(spark):
    log = spark.createDataFrame([("good", 1, 0.4), ("good", 2, 0.5), ("bad", 1, 0.49), ("none", 1, None)], "run string, seq int, train_top1_acc double")
    gate = tuning.training_gate(log, ["run"])
    assert {r.run: r.training_failed for r in gate.collect()} == {"good": False, "bad": True, "none": True}
    with pytest.raises(quality.HardFailure, match="training_failed"):
        quality.enforce(quality.report(gate, quality.TRAINING_RULES, ["run"]))
    assert quality.enforce(quality.report(gate.where("run = 'good'"), quality.TRAINING_RULES, ["run"])) == []
    assert tuning.rate_subset(spark.range(600).select(F.col("id").alias("pos"))).count() == 500


def test_a_named_decision_must_exist_even_if_overridden(tmp_path):
    with pytest.raises(FileNotFoundError):
        config.resolve_backbone({"training": {"backbone": "mine"}}, tmp_path / "none.json")


def test_flattened_lines_and_spans(spark):
    df = spark.createDataFrame([("p", ["a b", None, "", "c d e", "f"]), ("q", []), ("r", None)], "paragraph_id string, lines array<string>")
    got = {r.paragraph_id: (r.tokens, [tuple(x) for x in r.spans] if r.spans is not None else None) for r in masking.flattened(df, 4).collect()}
    assert got["p"] == (["a", "b", "c", "d"], [(0, 2), (2, 2), (2, 4)]) and got["q"] == ([], [])
    assert not got["r"][0]


def test_ranks_of_hidden_and_seen_tokens(spark):
    train = spark.createDataFrame([("p", ["a b", "a b", "a c"])], "paragraph_id string, lines array<string>")
    masked = spark.createDataFrame([("q", 0, 0, i, t, p) for i, (t, p) in enumerate([("b", "a"), ("c", "a"), ("a", None), ("z", None), ("b", "new"), ("a", "a")])], "paragraph_id string, pass int, line_no int, pos int, token string, previous string")
    got = {r.pos: r.hit_rank for r in scoring.BigramScorer(train).rank(masked, 2).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: None, 4: 2, 5: None}


def test_settings_of_all_sections(tmp_path):
    raw = {
        "dataset": "bgl", "window_seconds": 60, "backbone": {"roberta_id": "x/roberta", "longformer_id": "y/longformer"},
        "training": {"epochs": 3, "max_lr": "1.0e-4", "lr_grid": ["1e-5", 2], "effective_batch_size": 32, "betas": [0.9, "0.95"], "fp16": True,
                     "lr_scheduler": {"pct_start": 0.3, "final_div_factor": "1.0e4", "anneal_strategy": "cos"},
                     "gradual_unfreezing_schedule": {"epoch_1_unfrozen_layers": [10, 11], "epoch_3_plus_unfrozen_layers": "all", "embeddings_frozen_until_epoch": 3}},
        "determinism": {"hf_full_determinism": True, "fp16_weight_divergence_threshold": "1e-3"}, "masking": {"sentence_ratio": 0.4, "token_ratio": "0.7"},
    }
    c = config.run_config(raw)
    assert (c.backbone, c.window_seconds, c.epochs, c.max_lr, c.lr_grid, c.betas, c.fp16) == ("x/roberta", 60, 3, 1e-4, (1e-5, 2.0), (0.9, 0.95), True)
    assert (c.final_div_factor, c.anneal_strategy, c.epoch_1_unfrozen_layers, c.epoch_3_plus_unfrozen_layers, c.embeddings_frozen_until_epoch) == (1e4, "cos", (10, 11), "all", 3)
    assert (c.full_determinism, c.fp16_weight_divergence_threshold, c.sentence_mask_ratio, c.token_mask_ratio) == (True, 1e-3, 0.4, 0.7)
    assert (c.physical_batch_size, c.gradient_accumulation_steps) == (8, 4) and c.three_phase is False
    with pytest.raises(ValueError):
        config.run_config({"training": {"max_lr": "fast"}})
    pytest.importorskip("yaml")
    assert config.load_yaml(config.save_yaml(raw, tmp_path / "a" / "c.yaml")) == raw


def test_orders_and_display(spark):
    from loomline.operators import grouping

    p = spark.createDataFrame([("b", 2, 0, "x" * 61), ("a", 1, 1, "x" * 60), ("c", 1, 0, None)], "paragraph_id string, first_line int, first_pos int, t string")
    assert [r.paragraph_id for r in grouping.in_order(p).collect()] == ["c", "a", "b"]
    assert [r.paragraph_id for r in grouping.in_order(p.drop("first_pos")).collect()] == ["a", "b", "c"]
    assert {r.paragraph_id: r.s for r in p.select("paragraph_id", profile.shown("t", 60).alias("s")).collect()} == {"b": "x" * 57 + "...", "a": "x" * 60, "c": None}
    ids = spark.createDataFrame([("b",), ("a",)], "paragraph_id string")
    assert [r.paragraph_id for r in scoring.evaluation_set(ids, p, in_order=True).collect()] == ["a", "b"]
