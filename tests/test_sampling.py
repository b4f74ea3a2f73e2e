import pytest

from loomline.operators import masking, sampling, scoring

P = "g string, paragraph_id string, label int, ord bigint"


def pool(spark, normal, anomaly, shuffle=False):
    rows = [("d", f"n_{i}", 0, i) for i in range(normal)] + [("d", f"a_{i}", 1, normal + i) for i in range(anomaly)]
    df = spark.createDataFrame(rows, P)
    return df.repartition(7, "paragraph_id") if shuffle else df


def plan(spark, seed=42, folds=5, train=400, tune=80, tune_a=1000, test_a=1000):
    return spark.createDataFrame([("d", seed, folds, train, tune, tune_a, test_a)], "g string, seed bigint, n_folds bigint, train_normal_per_fold bigint, tune_normal_per_fold bigint, tune_anomaly_per_fold bigint, test_anomaly_per_fold bigint")


def streams(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.fold_id, r.stream), []).append((r.pos, r.paragraph_id))
    return {k: [p for _, p in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def made(spark):
    return streams(sampling.create_splits(pool(spark, 600, 100), plan(spark), ["g"]))


def test_sizes_and_degradation(made):
    assert {len(made[k, "train_normal_ids"]) for k in range(5)} == {400}
    assert {len(made[k, "tune_normal_ids"]) for k in range(5)} <= set(range(1, 81))
    assert all(len(made[k, "tune_anomaly_ids"]) == len(made[k, "test_anomaly_ids"]) == 50 for k in range(5))
    assert sum(len(made[k, "test_normal_ids"]) for k in range(5)) == 600


def test_streams_are_disjoint(made):
    for k in range(5):
        normal = [set(made[k, f"{s}_normal_ids"]) for s in ("train", "tune", "test")]
        assert len(set.union(*normal)) == sum(map(len, normal))
        assert not set(made[k, "tune_anomaly_ids"]) & set(made[k, "test_anomaly_ids"])


def test_same_for_any_partitioning(spark, made):
    assert streams(sampling.create_splits(pool(spark, 600, 100, shuffle=True), plan(spark), ["g"])) == made


def test_budgets_leave_other_streams(spark, made):
    other = streams(sampling.create_splits(pool(spark, 600, 100), plan(spark, train=100), ["g"]))
    assert all(other[k, s] == made[k, s] for k in range(5) for s in ("tune_anomaly_ids", "test_anomaly_ids", "test_normal_ids"))


def test_without_anomalies_or_rows(spark):
    got = streams(sampling.create_splits(pool(spark, 100, 0), plan(spark), ["g"]))
    assert {s for _, s in got} == {"train_normal_ids", "tune_normal_ids", "test_normal_ids"} or {s for _, s in got} == {"train_normal_ids", "test_normal_ids"}
    assert streams(sampling.create_splits(pool(spark, 0, 0), plan(spark), ["g"])) == {}


def test_wrong_parameters(spark):
    for bad in (dict(folds=1), dict(train=-1)):
        with pytest.raises(Exception, match="two or more|negative"):
            sampling.create_splits(pool(spark, 10, 2), plan(spark, **bad), ["g"]).collect()


def test_caps(spark):
    caps = lambda n, a: spark.createDataFrame([("d", 7, n, a)], "g string, seed bigint, max_normal bigint, max_anomaly bigint")
    got = lambda n, a: {r.paragraph_id for r in sampling.capped(pool(spark, 50, 20), caps(n, a), ["g"]).collect()}
    few = got(10, 5)
    assert len(few) == 15 and len(got(50, 20)) == 70 and len(got(None, 0)) == 50
    assert {x for x in got(10, 20) if x[0] == "n"} == {x for x in few if x[0] == "n"}
    assert few < got(20, 9)
    with pytest.raises(Exception, match="negative"):
        got(-1, 3)


def test_masks(spark):
    df = spark.createDataFrame([("p", ["a b c d e", "f g h", "", "i"]), ("q", []), ("r", None)], "paragraph_id string, lines array<string>")
    rows = masking.masked_positions(df, n_passes=3).collect()
    assert {r.paragraph_id for r in rows} == {"p"}
    for k in range(3):
        own = [r for r in rows if r["pass"] == k]
        assert len({r.line_no for r in own}) <= 2  # half of four lines; the blank one has no token
        assert all(r.token == df.first().lines[r.line_no].split()[r.pos] for r in own)
        hidden = {(r.line_no, r.pos) for r in own}
        assert all((r.previous is None) == (r.pos == 0 or (r.line_no, r.pos - 1) in hidden) for r in own)


def test_truncation(spark):
    df = spark.createDataFrame([("p", ["a b c", "", "d e f g", "h"])], "paragraph_id string, lines array<string>")
    got = lambda n: [r.tokens for r in masking.boundaries(df, n).orderBy("line_no").collect()]
    assert got(5) == [["a", "b", "c"], [], ["d", "e"]]
    assert got(3) == [["a", "b", "c"]]
    assert got(None) == [["a", "b", "c"], [], ["d", "e", "f", "g"], ["h"]]
    assert max(r.pos for r in masking.masked_positions(df, 5, limit=5).collect()) <= 2


def test_examples_are_padded(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, [10, 11, 12], [1]), (1, [13], [0])], "batch int, ids array<int>, masked array<int>")
    made = rows.select("batch", *(c.alias(n) for c, n in zip(masking.masked_example(F.col("ids"), F.col("masked")), ("input_ids", "labels", "attention_mask"))))
    out = sorted(masking.padded(made, "batch").collect(), key=lambda r: r.input_ids)
    assert [(r.input_ids, r.labels, r.attention_mask) for r in out] == [([0, 3, 2, 1, 1], [-100, 13, -100, -100, -100], [1, 1, 1, 0, 0]), ([0, 10, 3, 12, 2], [-100, -100, 11, -100, -100], [1, 1, 1, 1, 1])]


def test_scorer_ranks_and_backs_off(spark):
    train = spark.createDataFrame([("t", ["x a", "x a", "x b", "y c"])], "paragraph_id string, lines array<string>")
    masked = spark.createDataFrame([("p", "a", "x"), ("p", "b", "x"), ("p", "c", "x"), ("p", "x", None), ("p", "zz", "new")], "paragraph_id string, token string, previous string")
    scorer = scoring.BigramScorer(train)
    got = {(r.token, r.previous): r.hit_rank for r in scorer.rank(masked, 12).collect()}
    assert got == {("a", "x"): 1, ("b", "x"): 2, ("c", "x"): None, ("x", None): 1, ("zz", "new"): None}
    people = spark.createDataFrame([("p", 0), ("q", 1)], "paragraph_id string, label int")
    pooled = scoring.pooled_accuracy(people, scorer.rank(masked, 12), (1, 2)).collect()
    assert {(r.paragraph_id, r.top_k): r.accuracy for r in pooled} == {("p", 1): 0.4, ("p", 2): 0.6, ("q", 1): 1.0, ("q", 2): 1.0}
