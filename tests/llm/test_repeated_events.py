import random

import pytest

from loomline.llm import repeated_events as R

S = "paragraph_id string, lines array<string>"


def runs(spark, lines):
    return sorted((r.first_line, r.last_line) for r in R.runs(spark.createDataFrame([("p", lines)], S)).collect())


@pytest.mark.parametrize("a,b,same", [
    ("1 x cat sat 5", "2 x CAT sat. 77", True),
    ("a, (b) -- c", "a b c", True),
    ("read block", "read blocks", True),
    ("read block", "read blocking", False),
    ("read cats", "read cat", False),  # shorter than five
    ("alpha bravo", "alphas bravos", False),  # two pairs
    ("alpha 5", "alpha five", False),
    ("alpha beta", "beta alpha", False),
    ("capacitor", "capacit\N{REPLACEMENT CHARACTER}r", True),
    ("a b", "a b c", False),
    ("", "", False),
    ("...", "...", False),
])
def test_same_event(spark, a, b, same):
    normal = R._Normal()
    assert (R.dissimilarity(normal.line(a), normal.line(b)) < R.PENALTY) == same


def test_runs_chain_and_are_maximal(spark):
    lines = ["x", "read alpha 1", "read alpha 2", "read alpho 3", "read elpho 4", "", "read elpho 4", None, "z", "Z!"]
    assert runs(spark, lines) == [(1, 4), (8, 9)]


def test_optimal_against_all_segmentations():
    random.seed(5)
    for _ in range(200):
        n = random.randrange(1, 8)
        costs = [R.DIFFERENT] + [random.choice([0, 0.2, 0.9, 1.1, R.DIFFERENT]) for _ in range(n - 1)]

        def price(starts):
            return len(starts) * R.PENALTY + sum(costs[i] for i in range(n) if i not in starts)

        every = [{0} | {i for i in range(1, n) if m >> (i - 1) & 1} for m in range(2 ** (n - 1))]
        assert price(set(R.segment(costs))) == pytest.approx(min(map(price, every)))
    assert R.segment([]) == []


def test_optimal_by_event_against_all_segmentations():
    random.seed(6)
    drift = ["alphabet", "alphabat", "alphobat", "olphobat", "olphobit", "", "other words", "alphabet 1"]
    several = 0
    for _ in range(300):
        n = random.randrange(1, 9)
        events = [R._Normal().line(random.choice(drift)) for _ in range(n)]
        every = [e for e in events if e]
        far = lambda i, e: 0.0 if e is i else R.DIFFERENT if not isinstance(e, tuple) else R.dissimilarity(events[i], e)

        def price(starts):
            cost, ends = 0.0, [*sorted(starts)[1:], n]
            for a, b in zip(sorted(starts), ends):
                cost += R.PENALTY + min(sum(far(i, e) for i in range(a, b)) for e in [*every, *range(a, b)])
            return cost

        got = R.segment_by_event(R._Events(events))
        cuts = [{0} | {i for i in range(1, n) if m >> (i - 1) & 1} for m in range(2 ** (n - 1))]
        assert price(set(got)) == pytest.approx(min(map(price, cuts)))
        several += len(got) != len(R.segment([R.DIFFERENT] + [R.dissimilarity(a, b) for a, b in zip(events, events[1:])]))
    assert several > 10  # the measure decides, not the pairs alone
    assert R.segment_by_event(R._Events([])) == []


def test_drifting_chain_is_cut_where_one_event_no_longer_stands_for_it(spark):
    lines = ["abcdefghij", "abcdefghiX", "abcdefghXX", "abcdefgXXX", "abcdefXXXX", "abcdeXXXXX", "abcdXXXXXX"]
    df = spark.createDataFrame([("p", lines), ("p", lines), ("q", ["alpha 1"] * 5)], S)
    assert [(r.first_line, r.last_line) for r in R.runs(df).where("paragraph_id = 'p'").collect()] == [(0, 6)]
    got = {r.paragraph_id: [] for r in R.collapse(df).collect()}
    for r in R.collapse(df).orderBy("first_line").collect():
        got[r.paragraph_id].append(r.n_lines)
    assert sum(got["p"]) == 7 and 1 < len(got["p"]) < 4 and got["q"] == [5]


def test_counts_and_durations(spark):
    df = spark.createDataFrame([("h", ["010122 235959 1 x", "020122 000001 2 x", "020122 000001 9 INFO y"]), ("b", ["1640995212 d x", "bad d x", "q"])], S)
    out = {(r.paragraph_id, r.first_line): (r.n_lines, r.seconds) for r in R.collapse(df).collect()}
    assert out[("h", 0)] == (2, 2) and out[("h", 2)] == (1, 0) and out[("b", 0)][1] == 0 and out[("b", 1)][1] is None


def test_nulls_repeats_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("p", ["a", "a"]), ("p", ["a", "a"]), ("q", None), ("r", []), (None, ["b", "b"])], S).withColumns({"key": F.lit(1), "first_line": F.lit(2)})
    assert sorted(map(tuple, R.runs(df).collect()), key=str) == sorted([("p", 0, 1), (None, 0, 1)], key=str)
    assert R.runs(df.limit(0)).collect() == [] and R.collapse(df.limit(0)).collect() == []


def test_long_sequences_by_event():
    events = R._Events([("alpha", "\0")] * 50_000 + [("alpho", "\0"), ("alpha", "\0")] * 5_000 + [(f"w{i % 977}", "x") for i in range(50_000)])
    assert len(R.segment_by_event(events)) == 50_001


def test_very_long_sequence(spark):
    assert runs(spark, ["alpha 1"] * 100_000 + ["x " * 100_000]) == [(0, 99_999)]
