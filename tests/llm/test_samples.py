import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.llm import category_sample as C
from loomline.llm import common, mixing
from loomline.llm import permanent_sample as P

REQUEST = "request_id bigint, seed bigint, batch_from bigint, batch_to bigint, sample_size bigint, max_normal bigint, max_anomaly bigint, dataset string, label int, target_share double, min_rows bigint"
PAR = "paragraph_id string, dataset string, label int, batch_no bigint"


def test_sample_keeps_members_as_data_grows(spark):
    ids = spark.createDataFrame([(7, f"p{i}", i // 100) for i in range(1000)], "seed bigint, id string, batch_no bigint")
    take = lambda loads, df=ids: {r.id for r in P.grow(df, loads, 0.2).where("selected").collect()}
    early, late = take([(0, 4)]), take([(0, 4), (0, 9)])
    assert early < late and take([(0, 9)]) == late
    assert take([(0, 9)], ids.union(ids).repartition(5)) == late
    assert 140 < len(late) < 260
    assert take([(0, 9)], ids.withColumn("seed", F.lit(8))) != late


def test_registry_inserts_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (1, None)], "seed bigint, id string")
    registry = P.Registry(spark, common.scratch(spark, "t"))
    assert registry.read().count() == 0
    first = {tuple(r) for r in registry.add(rows).collect()}
    again = {tuple(r) for r in registry.add(rows.union(spark.createDataFrame([(2, "a")], "seed bigint, id string"))).collect()}
    assert len(first) == 1 and first < again and len(again) == 2
    assert P.threshold(0.3, 0.2) == 0.3 and P.threshold(0.3, 2.0) == 1.0


def test_registry_is_taken_up_again(spark):
    path = common.scratch(spark, "kept")
    ids = lambda low, high: spark.createDataFrame([(7, f"p{i}", i // 100) for i in range(low, high)], "seed bigint, id string, batch_no bigint")
    first = {tuple(r) for r in P.Registry(spark, path).add(ids(0, 500)).collect()}
    reopened = P.Registry(spark, path)
    assert {tuple(r) for r in reopened.read().collect()} == first and len(first) == 500
    assert first < {tuple(r) for r in reopened.add(ids(400, 600)).collect()}
    assert P.Registry(spark, path).read().count() == 600


def test_later_call_keeps_members_and_threshold(spark):
    path = common.scratch(spark, "kept")
    ids = lambda low, high: spark.createDataFrame([(7, f"p{i}", i // 100) for i in range(low, high)], "seed bigint, id string, batch_no bigint")
    take = lambda df, loads, share: {r.id: r.first_load for r in P.grow(df, loads, share, path=path).where("selected").collect()}
    early = take(ids(0, 500), [(0, 4)], 0.3)
    late = take(ids(500, 1000), [(5, 9)], 0.1)
    assert 100 < len(early) and early.items() < late.items() and set(late.values()) == {0, 1}
    assert P.Registry(spark, path).at == 0.3


def test_running_total_is_exact(spark):
    random.seed(2)
    rows = [(random.choice("aab"), random.choice([0.1, 0.25, random.random()]), i, random.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k double, i int, s int")
    got = {r.i: r.before for r in common.running_total(df, ["g"], "k", F.col("s"), "i", "before", buckets=8).collect()}
    want = {}
    for g in "ab":
        total = 0
        for _, k, i, s in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want[i], total = total, total + s
    assert got == want


def test_tables_are_summed_in_levels(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(common, "FAN_IN", 3)

    def count(batches):
        own = np.zeros(32, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own[x % 20] += 1
        yield common.table_parts(own, 8)

    rows = spark.range(0, 1000, 1, 20)
    got = common.summed_table(rows.mapInArrow(count, common.TABLE_PARTS), 20, 32, 8, np.int64)
    assert got.tolist() == [50] * 20 + [0] * 12


def test_controlled_rounding_keeps_margins():
    random.seed(4)
    for _ in range(200):
        cells = {(r, c): random.choice([0.0, 1.0, random.random() * 9]) for r in range(random.randrange(1, 5)) for c in range(random.randrange(1, 5))}
        out = C.controlled_rounding(cells)
        near = lambda x, n: n in (int(x + 1e-9), int(x + 1e-9) + (x - int(x + 1e-9) > 1e-9))
        assert all(near(x, out[k]) for k, x in cells.items())
        for axis in (0, 1):
            for v in {k[axis] for k in cells}:
                assert near(sum(x for k, x in cells.items() if k[axis] == v), sum(n for k, n in out.items() if k[axis] == v))
        assert sum(out.values()) == round(sum(cells.values()))


@pytest.fixture(scope="module")
def paragraphs(spark):
    rows = [(f"h{i}", "hdfs", 0, i % 4) for i in range(100)] + [(f"a{i}", "hdfs", 1, i % 4) for i in range(10)] + [(f"b{i}", "bgl", 0, i % 4) for i in range(40)]
    # Delivered again, once in another batch; a null label; a null id.
    return spark.createDataFrame([*rows, ("h0", "hdfs", 0, 0), ("h1", "hdfs", 0, 3), ("x", "hdfs", None, 1), (None, "hdfs", 0, 1)], PAR)


def request(spark, *cells, batches=(0, 3), size=60, caps=(50, 5)):
    return spark.createDataFrame([(1, 40, *batches, size, *caps, d, label, s, m) for d, label, s, m in cells], REQUEST)


def test_quotas_and_report(spark, paragraphs):
    asked = request(spark, ("hdfs", 0, 0.5, 0), ("hdfs", 1, 0.1, 0), ("bgl", 0, 0.4, 30))
    got = {(r.dataset, r.label): r for r in C.quotas(paragraphs, asked.union(asked)).collect()}
    # The minimum of bgl takes six rows from the rest, which share what is left in proportion.
    assert {k: (r.available, r.supply, r.wanted, r.quota, r.shortfall, r.met) for k, r in got.items()} == {
        ("hdfs", 0): (100, 50, 30.0, 25, 0.0, True), ("hdfs", 1): (10, 5, 6.0, 5, 1.0, False), ("bgl", 0): (40, 40, 30.0, 30, 0.0, True),
    }
    assert [tuple(r) for r in C.unmet(paragraphs, asked).collect()] == [(1, "hdfs", 1)]
    counts = Counter((r.dataset, r.label) for r in C.sample(paragraphs, asked).collect())
    assert counts == {("hdfs", 0): 25, ("hdfs", 1): 5, ("bgl", 0): 30}
    first = {r.paragraph_id for r in C.sample(paragraphs, asked).collect()}
    assert first == {r.paragraph_id for r in C.sample(paragraphs.repartition(9).union(paragraphs), asked).collect()}


def test_water_filling_meets_the_total_within_bounds():
    random.seed(8)
    for _ in range(300):
        n = random.randrange(1, 7)
        targets = [random.choice([0.0, random.random() * 50]) for _ in range(n)]
        highs = [float(random.randrange(60)) for _ in range(n)]
        lows = [min(h, random.choice([0.0, float(random.randrange(20))])) for h in highs]
        total = float(random.randrange(200))
        got = C.water_fill(targets, lows, highs, total)
        assert all(lo - 1e-9 <= x <= hi + 1e-9 for x, lo, hi in zip(got, lows, highs))
        most = sum(hi if t > 0 else lo for t, lo, hi in zip(targets, lows, highs))
        assert sum(got) == pytest.approx(max(sum(lows), min(total, most)), abs=1e-6)
        free = [x / t for x, t, lo, hi in zip(got, targets, lows, highs) if t > 0 and lo + 1e-6 < x < hi - 1e-6]
        assert not free or max(free) - min(free) < 1e-6
        whole = C.controlled_rounding({(i, i % 2): x for i, x in enumerate(got)}, {(i, i % 2): int(h) for i, h in enumerate(highs)})
        assert all(lo <= whole[i, i % 2] <= hi for i, (lo, hi) in enumerate(zip(lows, highs))) and sum(whole.values()) == round(sum(got))


@pytest.mark.parametrize("shares,size,caps,taken", [
    ((0.5, 0.1, 0.4), 60, (50, 5), 60), ((0.9, 0.05, 0.05), 80, (50, 50), 80), ((0.5, 0.1, 0.4), 500, (1000, 1000), 150), ((1.0, 0.0, 0.0), 7, (None, None), 7),
])
def test_samples_have_the_size_asked_for(spark, paragraphs, shares, size, caps, taken):
    cells = [(d, label, s, 0) for (d, label), s in zip((("hdfs", 0), ("hdfs", 1), ("bgl", 0)), shares)]
    asked = request(spark, *cells, size=size, caps=caps)
    assert C.quotas(paragraphs, asked).agg(F.sum("quota")).first()[0] == taken == C.sample(paragraphs, asked).count()


def test_keys_beyond_the_bound_are_taken_up(spark, paragraphs, monkeypatch):
    asked = request(spark, ("hdfs", 0, 0.5, 0), ("bgl", 0, 0.5, 0), size=20)
    want = sorted(map(tuple, C.sample(paragraphs, asked).collect()))
    monkeypatch.setattr(C, "MARGIN", -2.0)
    assert len(want) == 20 and sorted(map(tuple, C.sample(paragraphs, asked).collect())) == want


def test_batches_count_a_paragraph_once(spark, paragraphs):
    n = lambda a, b: C.quotas(paragraphs, request(spark, ("hdfs", 0, 0.1, 0), batches=(a, b))).first().available
    assert (n(0, 3), n(3, 3), n(1, 1), n(9, 9)) == (100, 26, 25, 0)


def test_requests_with_nulls_or_nothing(spark, paragraphs):
    odd = spark.createDataFrame([(1, 4, 0, 3, 10, None, None, "hdfs", 0, 0.5, None), (2, 4, 0, 3, None, 5, 5, "hdfs", None, 0.5, 1), (3, 4, 0, 3, 10, 5, 5, "none", 0, 1.0, 0)], REQUEST)
    assert [tuple(r) for r in C.unmet(paragraphs, odd).collect()] == [(3, "none", 0)]
    assert C.unmet(paragraphs, odd.limit(0)).collect() == [] and C.sample(paragraphs.limit(0), odd).collect() == []


DOC = "doc_id bigint, batch_no bigint, source string, text string, weight int"
MIX = "mix_id bigint, batch_from bigint, batch_to bigint, total_words bigint, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, i % 3, random.Random(i).choice(["Big", " big "]), "w " * 10, 1) for i in range(200)] + [(1000 + i, 0, "small", "x y", 1) for i in range(5)]
    return spark.createDataFrame([*rows, (7, 1, "Big", "w " * 10, 1), (5000, 0, None, "z", 1), (5001, 0, "big", None, 1), (5002, 0, "  ", "z", 1)], DOC)


def test_mix_meets_shares(spark, documents):
    plan = spark.createDataFrame([(1, 0, 2, 1000, "BIG", 0.97, 4), (1, 0, 2, 1000, "small", 0.03, 4), (2, 0, 0, 100, "small", 1.0, 2), (2, 0, 0, 100, "none", 0.5, 3)], MIX)
    assert sorted(tuple(r) for r in mixing.short_sources(documents, plan).collect()) == [(2, "none"), (2, "small")]
    used = mixing.mix(documents, plan).collect()
    assert all(r.repeats <= 4 for r in used) and all(r.repeats == 2 for r in used if r.mix_id == 2)
    got = {(r.mix_id, r.source): r for r in mixing.reached(documents, plan).collect()}
    assert got[1, "big"].reached == 970 and got[1, "small"].reached == 30
    assert got[2, "small"].reached == 20 and got[2, "none"].reached == 0 and got[2, "small"].share_reached == 1.0
    again = mixing.mix(documents.repartition(7), plan).collect()
    assert sorted(map(tuple, used)) == sorted(map(tuple, again))


def test_weights_favour_clean_documents(spark):
    rows = [(i, 0, "s", "w " * 10 if i % 2 else "\N{REPLACEMENT CHARACTER} " * 10, 1) for i in range(400)]
    plan = spark.createDataFrame([(1, 0, 0, 1000, "s", 1.0, 1)], MIX)
    picked = Counter(r.doc_id % 2 for r in mixing.mix(spark.createDataFrame(rows, DOC), plan, weight=mixing.intactness("text")).collect())
    assert picked[1] > 3 * picked[0]
    # Any column is a weight; null or none at all is the least.
    odd = mixing.mix(spark.createDataFrame(rows, DOC), plan, weight=F.when(F.col("doc_id") < 100, 5.0))
    assert sum(r.doc_id < 100 for r in odd.collect()) > 90


def test_empty_texts_keep_to_the_repeats(spark):
    random.seed(3)
    for most in (0, 1, 2, 3):
        rows = [(i, 0, "s", "w " * random.choice([0, 0, 1, 5]), 1) for i in range(40)]
        size = sum(len(r[3].split()) for r in rows)
        plans = spark.createDataFrame([(k, 0, 0, total, "s", 1.0, most) for k, total in enumerate((0, 1, size, 2 * size, 2 * size + 3, 9 * size))], MIX)
        used = mixing.mix(spark.createDataFrame(rows, DOC), plans).collect()
        assert all(0 < r.repeats <= most for r in used)
        for k, total in enumerate((0, 1, size, 2 * size, 2 * size + 3)):
            assert sum(r.size * r.repeats for r in used if r.mix_id == k) <= total


def test_budgets_in_another_unit(spark, documents):
    plan = spark.createDataFrame([(1, 0, 2, 1000, "big", 0.5, 4), (1, 0, 2, 1000, "small", 0.5, 4)], MIX)
    words, triple = (sorted(tuple(r)[:3] for r in mixing.reached(documents, plan, size).select("mix_id", "source", "reached", "budget").collect()) for size in (None, F.length("text") * 0 + 3 * F.size(F.split(F.trim("text"), " "))))
    assert [(a, b, 3 * c) for a, b, c in words] == triple


def test_mix_of_nothing(spark, documents):
    plan = spark.createDataFrame([(1, 0, 2, 1000, "big", 0.5, None), (None, 0, 2, 1000, "big", 0.5, 1), (2, 0, 2, None, "big", 0.5, 1)], MIX)
    assert mixing.mix(documents.limit(0), plan).collect() == [] and mixing.mix(documents, plan.limit(0)).collect() == []
    assert [tuple(r) for r in mixing.short_sources(documents.limit(0), plan).collect()] == [(1, "big")]
    assert mixing.short_sources(documents, plan).collect() == []
