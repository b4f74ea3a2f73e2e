import random

import pytest

from loomline.llm import leakage as K

DOC = "doc_id bigint, text string, item_id int"
ITEM = "item_id bigint, suite string, split string, text string"


def brute(document, item):
    """Every stretch of every alignment."""
    w, v = K.normal_words(document), K.item_words(item)
    least = max(12, -(-len(v) // 4))
    for shift in range(-len(v), len(w)):
        for a in range(len(v)):
            wrong = 0
            for b in range(a, len(v)):
                if not 0 <= b + shift < len(w):
                    break
                if not 0 <= a + shift:
                    break
                wrong += w[b + shift] != v[b]
                n = b - a + 1
                if n >= least and wrong <= n // 10:
                    return True
    return False


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(i, "s", "t", " ".join(f"v{r.randrange(40 if seed else 6)}" for _ in range(r.choice([11, 12, 30, 60, 90])))) for i in range(8)]
    documents = []
    for d in range(60):
        v = r.choice(items)[3].split()
        n = r.randrange(8, 40)
        a = r.randrange(max(1, len(v) - n))
        cut = [w if r.random() > r.choice([0, 0.08, 0.15]) else "other" for w in v[a : a + n]]
        documents.append((d, " ".join(["noise"] * r.randrange(5) + cut + ["noise"] * r.randrange(5)), 0))
    got = {tuple(x) for x in K.leaks(spark.createDataFrame(documents, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {(d, i) for d, t, _ in documents for i, _, _, v in items if brute(t, v)}
    assert got


V = "Alpha-1 beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


@pytest.mark.parametrize("text,hit", [
    (V, True),
    (V.upper().replace(" ", " \r\n"), True),
    ("> " + V.replace(" gamma ", " <b>gamma</b> ").replace("delta", "“delta”,"), True),
    ("| " + " | ".join(V.split()) + " |", True),
    ("1) " + V.replace(" iota ", "\n2) iota "), True),
    (" ".join(V.split()[:12]), True),
    (" ".join(V.split()[:11]), False),
    (" ".join(V.split()[:12]).replace("zeta", "other"), True),
    (" ".join(V.split()[:12]).replace("zeta", "other").replace("eta ", "x "), False),
    ("Read the text below:", False),
])
def test_what_does_not_count(spark, text, hit):
    items = spark.createDataFrame([(3, "s", "t", "Read the text below:\n" + V)], ITEM)
    got = K.leaks(spark.createDataFrame([(1, text, 0)], DOC), items).collect()
    assert [tuple(r) for r in got] == ([(1, 3)] if hit else [])


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, "s", "t", " ".join(f"v{i}_{k}" for k in range(20))) for i in range(5)], ITEM)
    documents = spark.createDataFrame([(i, " ".join(f"v{i}_{k}" for k in range(15)), 0) for i in range(5)], DOC)
    monkeypatch.setattr(K, "BLOCK_WORDS", 30)
    assert sorted(map(tuple, K.leaks(documents, items).collect())) == [(i, i) for i in range(5)]


def test_nulls_repeats_empty_and_long(spark):
    items = spark.createDataFrame([(1, "s", "t", V), (1, "s", "t", V), (2, "s", "t", None), (3, "s", "t", "short"), (None, "s", "t", V)], ITEM)
    documents = spark.createDataFrame([(1, "x " * 200_000 + V, 0), (1, V, 0), (2, None, 0), (3, "", 0), (None, V, 0)], DOC)
    assert [tuple(r) for r in K.leaks(documents, items).collect()] == [(1, 1)]
    assert [tuple(r) for r in K.leaked_items(documents, items).collect()] == [(1, "s", "t", 1)]
    assert K.leaks(documents.limit(0), items).collect() == [] and K.leaks(documents, items.limit(0)).collect() == []
