import random

import numpy as np
import pytest

from loomline.llm import prose
from loomline.llm import reading_level as R

DOC = "doc_id bigint, text string, level int"
RATING = "doc_id bigint, rater string, level int"
EASY, HARD = "the cat ran to a red door and it was not shut".split(), "methodological characterization of institutional interdependencies presupposes probabilistic generalization".split()


def corpus(n=200, seed=1):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        hard = i % 4 == 0
        words = (lambda: r.choice(HARD) if hard and r.random() < 0.5 else r.choice(EASY))
        size = (lambda: r.randrange(20, 28)) if hard else (lambda: r.randrange(5, 12))
        out[i] = (" ".join(" ".join(words() for _ in range(size())).capitalize() + "." for _ in range(8)), hard)
    return out


def test_held_out_documents_are_told_apart(spark):
    docs = corpus()
    rows = spark.createDataFrame([(i, t, 0) for i, (t, _) in docs.items()], DOC)
    ratings = spark.createDataFrame([(i, x, (5 if i % 8 else 4) if h else 1 + i % 3) for i, (_, h) in docs.items() if i < 60 for x in "ab"] + [(1, "c", None)], RATING)
    got = {r.doc_id for r in R.for_specialists(rows, ratings).collect()}
    assert got == {i for i, (_, h) in docs.items() if h}
    levels = {r.doc_id: r.level for r in R.levels(rows, ratings).collect() if r.doc_id >= 60}
    assert min(levels[i] for i in levels if docs[i][1]) > max(levels[i] for i in levels if not docs[i][1])


def test_without_ratings_levels_follow_sentence_length(spark):
    docs = corpus(80)
    rows = spark.createDataFrame([(i, t, 0) for i, (t, _) in docs.items()], DOC)
    levels = {r.doc_id: r.level for r in R.levels(rows).collect()}
    assert np.mean([levels[i] for i in docs if docs[i][1]]) > np.mean([levels[i] for i in docs if not docs[i][1]]) + 0.5


def test_model_recovers_difficulties():
    rng = np.random.default_rng(0)
    true = rng.normal(0, 0.7, 300)
    rate = np.exp(true[:, None] * (R.GRID - R.GRID.mean()))
    counts = rng.poisson(2000 * rate / rate.sum(0)).astype(float)
    assert np.corrcoef(R.Model(counts).s, true)[0, 1] > 0.95


@pytest.mark.parametrize("text,want", [
    ("One two. Three!", [2, 1]),
    ("A line\nwrapped here. Next one.", [4, 2]),
    ("See node (e.g. node 4) today. Use v2.4.1 now.", [6, 3]),
    ("# Heading\n\nBody text is here.", [4]),
    ("Short heading\n\nBody text is here.", [4]),
    ("1) first entry\n2) second longer entry\n   goes on", [2, 5]),
    ("- one\n- two three", [1, 2]),
    ("| a | b |\n|---|---|\n| 1 | 2 |\n\nText here now.", [3]),
    ("010122 000032 5165 ERROR store.Scanner: x\n\nReal text is this.", [4]),
    ("", []),
])
def test_sentences(text, want):
    assert [len(s.split()) for s in prose.sentences(text)] == want


def test_language_is_learnt_from_labels_with_errors(spark):
    r = random.Random(4)
    own, other = "the cat ran to a door and it was not shut".split(), "die katze lief zur tür und sie war nicht zu".split()
    rows = []
    for i in range(400):
        is_own = i % 4 > 0
        text = " ".join(r.choice(own if is_own else other) for _ in range(30)) + "."
        label = r.choice(["en", "EN", " eng", "en-GB"]) if is_own else "de"
        rows.append((i, text, None if i % 50 == 7 else "en" if i % 40 == 8 else label))
    rows += [(1000, "", "en"), (1001, None, "de"), (None, "x", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    odds = R.language_odds(df)
    assert odds["the"] > 1 and odds["nicht"] < -1
    got = {x.doc_id: x.english for x in R.levels(df).collect()}
    assert all(got[i] == (i % 4 > 0) for i in range(400)) and got[1000] is False
    assert R.language_odds(df.where("lang like 'en%'")) == {} == R.language_odds(df.drop("lang")) == R.language_odds(df.limit(0))
    assert all(x.english for x in R.levels(df.drop("lang").where("doc_id < 9")).collect())


def test_levels_of_a_batch_are_those_of_each_document():
    rng = np.random.default_rng(2)
    model = R.Model(rng.poisson(3, (50, len(R.GRID))).astype(float))
    sizes = np.array([0, 3, 17, 1, 0, 40])
    words, ratings = rng.integers(0, 50, sizes.sum()).astype(np.int32), np.array([np.nan, 4.0, np.nan, 1.5, 2.0, np.nan])
    (got, spread), at = model.levels(words, sizes, ratings), 0
    assert spread[5] < spread[0]
    for n, rating, level in zip(sizes, ratings, got):
        s = model.s[words[at : at + n]].astype(float).sum()
        prior = (R.FINE - (3.0 if np.isnan(rating) else rating)) / (R.LEVEL_SPREAD if np.isnan(rating) else R.RATING_SPREAD)
        assert abs(level - R.FINE[np.argmax(s * (R.FINE - R.GRID.mean()) - n * model.log_z - prior**2 / 2)]) < 1e-9
        at += n


def test_nulls_repeats_and_empty(spark):
    rows = spark.createDataFrame([(1, "A cat ran.", 0), (1, "A cat ran.", 0), (2, None, 0), (None, "x", 0), (3, "", 0), (4, "x " * 100_000, 0)], DOC)
    ratings = spark.createDataFrame([], RATING)
    out = {r.doc_id: r for r in R.levels(rows, ratings).collect()}
    assert not R.for_specialists(rows.where("doc_id < 4")).count()
    assert set(out) == {1, 3, 4} and out[3].n_sentences == 0
    assert R.for_specialists(rows.limit(0), ratings).collect() == []
    assert R.levels(rows.limit(0)).collect() == []
