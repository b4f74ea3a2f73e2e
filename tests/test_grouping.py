import pytest
from pyspark.sql import functions as F

from loomline.operators import grouping as G
from loomline.operators import parsing, profile, quality

LINES = "line_no bigint, text string"


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), LINES)


def stamped(spark, times, anomalous=()):
    return parsing.parse_labelled(lines(spark, [f"{'APPSEV' if t in anomalous else '-'} {t} 2005.06.03 x" for t in times]))


@pytest.mark.parametrize("text,failure", [
    ("- 1000 2005.06.03 x", None), ("  - +12 x", None), ("", "unparseable_timestamp"), ("-", "unparseable_timestamp"), ("- 1000", "missing_content"),
    ("- abc", "missing_content"), ("- abc rest", "unparseable_timestamp"), (None, "unparseable_timestamp"),
])
def test_parse_failures(spark, text, failure):
    assert parsing.parse_labelled(lines(spark, [text])).first().failure == failure


def test_content_keeps_the_time_stamp(spark):
    r = parsing.parse_labelled(lines(spark, ["  APPSEV 1005 2005.06.03  node x"])).first()
    assert (r.label_field, r.ts, r.content, r.anomaly) == ("APPSEV", 1005, "1005 2005.06.03  node x", 1)


@pytest.mark.parametrize("times,want", [
    ([1000, 1003, 1009, 1010, 1015, 1019, 1020, 1025, 1029], {0: 3, 1: 3, 2: 3}),
    ([1000, 1005, 1009, 1010, 1015], {0: 3, 1: 2}),
    ([1000, 1005, 1015, 1003, 1019], {0: 3, 1: 2}),
    ([2000, 2005, 1000, 1005], {-100: 2, 0: 2}),
    ([1000, 1100, 1200, 1300], {}),
])
def test_windows(spark, times, want):
    out = G.window_paragraphs(stamped(spark, times), 10, "bgl").collect()
    assert {r.source_window_id: len(r.lines) for r in out} == want
    assert all(r.paragraph_id == f"bgl_10s_w{r.source_window_id}" for r in out)


def test_window_label_start_and_order(spark):
    out = G.window_paragraphs(stamped(spark, [1005, 1000, 1007, 1025], {1007, 1025}), 10, "tbird").collect()
    # Anchored at 1005, the first line; 1000 falls in window -1 alone, as does 1025 in window 2.
    assert [(r.label, r.start_timestamp, [x.split()[0] for x in r.lines]) for r in out] == [(1, 1005.0, ["1005", "1007"])]
    r = G.dropped_windows(G.with_window(stamped(spark, [1005, 1000, 1007, 1025], {1007, 1025}), 10)).first()
    assert tuple(r) == (1, 1, 1)


def test_window_checks():
    assert G.check_window(30) == [] and len(G.check_window(600)) == 1
    with pytest.raises(ValueError):
        G.check_window(0)
    with pytest.raises(ValueError):
        G.check_window(10, "hdfs")


def test_sessions(spark):
    log = ["x blk_9", "nothing", "a blk_5 blk_1 blk_5", "z blk_9 prefixblk_3", "y blk_-7"]
    labels = G.label_table(spark.createDataFrame([("blk_9", "Normal"), (" blk_5 ", "Anomaly "), ("blk_1", "Normal"), ("blk_8", "Normal")], "`BlockId` string, ` Label` string"))
    out = G.session_paragraphs(lines(spark, log), labels).orderBy("first_line", "first_pos").collect()
    assert [(r.paragraph_id, r.label, r.lines) for r in out] == [("blk_9", 0, [log[0], log[3]]), ("blk_5", 1, [log[2]]), ("blk_1", 0, [log[2]])]
    with pytest.raises(G.MissingLabel, match="blk_-7 on line 5"):
        G.session_paragraphs(lines(spark, log), labels, strict=True)
    assert tuple(G.entity_counters(lines(spark, log)).first()) == (5, 1, 1)


def test_label_repeats_and_conflicts(spark):
    rows = [("a", "Normal"), ("a", "Normal"), ("b", "Normal"), ("b", "Anomaly"), ("c", "Odd")]
    got = {r.block_id: (r.label, r.n_rows, r.n_labels) for r in G.label_table(spark.createDataFrame(rows, "BlockId string, Label string")).collect()}
    assert got == {"a": (0, 2, 1), "b": (None, 2, 2), "c": (None, 1, 0)}


def test_bad_line_gate(spark):
    def counters(total, bad):
        return spark.createDataFrame([(total, bad, 0, 0)], "total_lines_read bigint, unparseable_timestamp bigint, lines_missing_content bigint, encoding_replacements_seen bigint")

    assert quality.enforce(quality.report(counters(2000, 2), quality.LINE_RULES)) == []
    with pytest.raises(quality.HardFailure):
        quality.enforce(quality.report(counters(1000, 11), quality.LINE_RULES))
    assert quality.enforce(quality.report(counters(1000, 11), quality.LINE_RULES), warn_only=True) == ["bad_lines"]


def test_length_rules(spark):
    limits = spark.createDataFrame([("roberta-base", 10)], "backbone string, max_tokens bigint")
    for words, fails in ((48, False), (49, True)):  # 50 and 51 tokens
        gate = profile.length_gate(spark.createDataFrame([("d", ["w " * words])], "g string, lines array<string>"), limits, ["g"])
        report = quality.report(gate, quality.LENGTH_RULES, ["g"])
        assert (quality.enforce(report, warn_only=True) == ["longest", "p95"]) == fails


def test_lengths(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "v int")
    r = profile.length_distribution(df, "v").first()
    assert (r.n, r.min, r.max, r.p50, r.p80) == (5, 1, 100, 3.0, pytest.approx(23.2))
    empty = profile.length_distribution(df.limit(0), "v").first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    s = profile.index_stats(df.withColumn("g", F.lit(1)), "v", ["g"]).first()
    assert (s.p50, s.p95, s["mean"]) == (3, 100, 22.0)


def test_token_lengths(spark):
    df = spark.createDataFrame([([],), (["a b", "c"],), (None,), ([None, "a"],)], "lines array<string>")
    assert [r[0] for r in df.select(profile.lines_tokens("lines")).collect()] == [2, 6, 2, 3]


def test_replaced_characters(spark):
    df = lines(spark, ["ok", "bad \N{REPLACEMENT CHARACTER}"] * 120)
    assert [r[0] for r in parsing.replaced_lines(df).collect()] == [2 * i for i in range(1, 101)]


def test_positions(spark):
    placed = G.line_positions(G.with_window(stamped(spark, [1000, 1001, 1002, 1003], {1002, 1003}), 10))
    at = profile.anomaly_positions(placed)
    assert sorted((r.position, r.is_first) for r in at.collect()) == [(0.5, True), (0.75, False)]
    assert [r.n for r in profile.position_histogram(at).orderBy("bin").collect()] == [0, 0, 0, 0, 0, 1, 0, 1, 0, 0]
    assert profile.position_stats(at.where("is_first")).first().verdict == "DISTRIBUTED / MIDDLE"
    assert profile.position_stats(at.limit(0)).first().p50 == 0.0


def test_a_hard_rule_is_found_among_many_that_fired(spark):
    rules = (quality.Rule("soft", "v", 0.0), quality.Rule("hard", "v", 4999.0, hard=True))
    report = quality.report(spark.range(1, 5002).selectExpr("id", "cast(id as double) v"), rules, ["id"])
    with pytest.raises(quality.HardFailure, match=r"^hard: 5001 > 4999 \(largest of 2\)$"):
        quality.enforce(report)
    assert quality.enforce(report, warn_only=True) == ["hard", "soft"]
    assert quality.enforce(report.where("id < 5000")) == ["soft"]
