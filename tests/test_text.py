import pytest

from loomline.functions.text import entities, real_time, shape, word_count, words


def test_words_are_those_of_python(spark):
    texts = ["a b", " a\tb\n", "", "é x　y", "a\xa0b\x85c\x1cd", "ab éa,é b", "x" * 100_000 + "é" * 100_000 + " y", "éa" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r for r in df.select("i", words("t").alias("w"), word_count("t").alias("n")).orderBy("i").collect()]
    assert [r.w for r in got] == [*(t.split() for t in texts), None]
    assert [r.n for r in got] == [*(len(t.split()) for t in texts), None]


def test_every_space_ends_a_word(spark):
    chars = [(c, f"a{chr(c)}b") for c in range(1, 0x3100)]
    got = {r.c: r.n for r in spark.createDataFrame(chars, "c int, t string").select("c", word_count("t").alias("n")).collect()}
    assert {c for c, n in got.items() if n == 2} == {c for c, t in chars if len(t.split()) == 2}


@pytest.mark.parametrize("text,want", [("blk_1 x blk_-2 blk_1", ["blk_1", "blk_-2"]), ("prefixblk_123 fooblk_456bar blk_abc", []), ("(blk_7)", ["blk_7"])])
def test_entities(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(entities("t")).first()[0] == want


def test_shape_and_times(spark):
    df = spark.createDataFrame([("- 16#0 ab-1  [x]:",)], "t string")
    assert df.select(shape("t", 9)).first()[0] == "w w w [w]:"
    assert df.select(shape("t", 3)).first()[0] == "w w w"
    assert spark.createDataFrame([("10:2.5 a.b$C/d: \"k\"",)], "t string").select(shape("t", 9)).first()[0] == 'w:w w: "w"'
    stamps = ["20220228235959", "20220230000000", "20220101240000", "20220101000060", "x", "", None]
    from pyspark.sql import functions as F

    out = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string").orderBy("i").select(real_time(F.col("s"))).collect()]
    assert out[0] is not None and out[1:] == [None] * 6
