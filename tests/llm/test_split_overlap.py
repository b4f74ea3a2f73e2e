import random
from collections import Counter

import pytest

from loomline.llm import split_overlap as O

PAR = "paragraph_id string, dataset string, lines array<string>"
FOLD = "artifact_id string, fold_id int, stream string, pos bigint, paragraph_id string"


def brute(paragraphs, folds):
    words = {p: Counter(w for x in lines if x for w in x.lower().split()[2:]) for p, _, lines in paragraphs if lines}
    out = set()
    sides = {}
    for a, f, s, _, p in folds:
        side = "train" if s == "train_normal_ids" else "test" if s.startswith("test") else None
        if side and p is not None:
            sides.setdefault((a, f), {}).setdefault(side, set()).add(p)
    for (a, f), x in sides.items():
        for p in x.get("train", ()):
            for q in x.get("test", ()):
                n, m = words.get(p, Counter()), words.get(q, Counter())
                if p == q or n and m and 5 * (n & m).total() >= 4 * max(n.total(), m.total()):
                    out.add((a, f, min(p, q), max(p, q)))
    return out


def check(spark, paragraphs, folds):
    got = O.found(spark.createDataFrame(paragraphs, PAR), spark.createDataFrame(folds, FOLD)).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(paragraphs, folds)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = [[" ".join(["t1", "t2", *(f"w{r.randrange(30 if seed else 8)}" for _ in range(r.randrange(1, 9)))]) for _ in range(r.randrange(1, 4))] for _ in range(25)]
    paragraphs = []
    for i in range(120):
        lines = [" ".join(w if r.random() > 0.08 else f"w{r.randrange(30)}" for w in x.split()) for x in r.choice(base)]
        if r.random() < 0.1:
            lines = [x.upper() for x in reversed(lines)]
        paragraphs.append((f"p{i}", "d", lines))
    streams = ["train_normal_ids", "test_normal_ids", "test_anomaly_ids", "tune_normal_ids"]
    folds = [(r.choice("AB"), r.randrange(3), r.choice(streams), i, f"p{r.randrange(125)}") for i in range(500)]
    check(spark, paragraphs, folds)


def test_first_two_words_case_and_order_do_not_count(spark):
    paragraphs = [("a", "d", ["1 2 x y z", "3 4 u"]), ("b", "d", ["9 9 U", "8 8 X Y z"]), ("c", "d", ["1 2"]), ("e", "d", ["1 2"]), ("n", "d", None), ("m", "d", [None, ""])]
    folds = [("A", 0, "train_normal_ids", i, x) for i, x in enumerate("acnm")] + [("A", 0, "test_normal_ids", i, x) for i, x in enumerate("benm")]
    check(spark, paragraphs, folds)
    got = {tuple(r)[2:] for r in O.found(spark.createDataFrame(paragraphs, PAR), spark.createDataFrame(folds, FOLD)).collect()}
    assert got == {("a", "b"), ("n", "n"), ("m", "m")}


def test_exactly_four_fifths(spark):
    text = lambda *w: ["1 2 " + " ".join(w)]
    paragraphs = [("a", "d", text(*"abcde")), ("b", "d", text(*"abcdz")), ("c", "d", text(*"abcyz")), ("e", "d", text(*"abcd")), ("f", "d", text(*"abcdefg"))]
    folds = [("A", 0, "train_normal_ids", 0, "a")] + [("A", 0, "test_anomaly_ids", i, x) for i, x in enumerate("bcef")]
    check(spark, paragraphs, folds)


def test_a_hot_group_of_copies(spark):
    paragraphs = [(f"p{i}", "d", ["1 2 same words here again now"]) for i in range(300)] + [(f"q{i}", "d", [f"1 2 own{i} x{i}"]) for i in range(50)]
    folds = [("A", i % 2, "train_normal_ids" if i % 7 else "test_normal_ids", i, p) for i, (p, _, _) in enumerate(paragraphs)]
    check(spark, paragraphs, folds)


def test_counts_are_of_test_ids_by_their_dataset(spark):
    same, near = ["1 2 a b c d e"], ["1 2 a b c d z"]
    paragraphs = spark.createDataFrame([(f"a{i}", "x", same) for i in range(6)] + [(f"b{i}", "y", same) for i in range(3)] + [("c", "z", near), ("o", "y", ["1 2 own words"]), ("t", "x", ["1 2 other"])], PAR)
    rows = [("A", k, "train_normal_ids", i, f"a{i}") for k in (0, 1) for i in range(6)] + [("A", 0, "test_normal_ids", i, f"b{i}") for i in range(3)]
    rows += [("A", 0, "test_anomaly_ids", 0, "c"), ("A", 1, "test_anomaly_ids", 0, "c"), ("A", 0, "test_normal_ids", 9, "o"), ("A", 1, "train_normal_ids", 9, "t"), ("A", 1, "test_normal_ids", 9, "t")]
    folds = spark.createDataFrame(rows + rows[-3:], FOLD)
    assert {tuple(r) for r in O.per_stream(paragraphs, folds).collect()} == {("y", "test_normal_ids", 3), ("z", "test_anomaly_ids", 2), ("x", "test_normal_ids", 1)}
    assert {tuple(r) for r in O.pairs_per_stream(paragraphs, folds).collect()} == {("y", "test_normal_ids", 18), ("z", "test_anomaly_ids", 12), ("x", "test_normal_ids", 1)}


def test_without_broadcast_of_ids(spark, monkeypatch):
    monkeypatch.setattr(O, "MAX_BROADCAST_IDS", 0)
    paragraphs = [("a", "d", ["1 2 a b c d e"]), ("b", "d", ["1 2 a b c d z"])]
    check(spark, paragraphs, [("A", 0, "train_normal_ids", 0, "a"), ("A", 0, "test_normal_ids", 0, "b")])


def test_repeats_nulls_empty_and_counts(spark):
    paragraphs = spark.createDataFrame([("a", "d", ["1 2 x y"]), ("a", "d", ["1 2 x y"]), ("b", "d", ["1 2 x y"]), (None, "d", ["1 2 x y"])], PAR)
    rows = [("A", 0, "train_normal_ids", 0, "a"), ("A", 0, "train_normal_ids", 0, "a"), ("A", 0, "test_normal_ids", 0, "b"), ("A", None, "test_normal_ids", 0, "a"), ("A", 0, "test_normal_ids", 1, None)]
    folds = spark.createDataFrame(rows, FOLD)
    assert [tuple(r) for r in O.found(paragraphs, folds).collect()] == [("A", 0, "a", "b")]
    assert [tuple(r) for r in O.per_stream(paragraphs, folds).collect()] == [("d", "test_normal_ids", 1)]
    assert O.found(paragraphs.limit(0), folds.limit(0)).collect() == [] and O.found(paragraphs, folds.limit(0)).collect() == []
