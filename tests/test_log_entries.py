import pytest

from loomline.operators import log_entries as L

SCHEMA = "log_file string, line_no bigint, text string"


def found(spark, texts, file="a.log", extra=()):
    rows = [(file, i + 1, t) for i, t in enumerate(texts)] + list(extra)
    return sorted(tuple(r) for r in L.severe_entries(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("line,hit", [
    ("- 1640995203 2022.01.01 Q04-N6-K:J04 RAS TORUSNET ERROR bad", True),
    ("- 16x0995203 2022.01.01 Q04-N6-K:J04 RAS TORUSNET ERROR bad", False),
    ("POWFAIL 1640995203 2022.01.01 Q04-N6-K:J04 RAS TORUSNET INFO ERROR later", False),
    ("E0101 00:00:05.728381 4806 beacon.src:300] msg", True),
    ("E0230 00:00:05.728381 4806 beacon.src:300] no such day", False),
    ("F#### ##:##:##.###### 4806 beacon.src:300] msg", False),
    ("010122 000032 5165 ERROR store.Scanner: x blk_1", True),
    ("320122 000032 5165 ERROR store.Scanner: x blk_1", False),
    ("<13>Jan  1 00:00:40 tbcn562 fsguard[29780]: notice", False),
    ("<179>Jan  1 00:00:40 tbcn562 rpc.lease[29780]: error", True),
    ("<179>Jan  9 99:99:99 tbcn562 rpc.lease[29780]: error", False),
    ("Jan  1 00:00:40 tbcn562 fsguard[29780]: error without level", False),
    ("[2022/01/01 00:01:31] (emergency) store.Mover | x", True),
    ("2022-01-01 00:04:33,739 FATAL [w-3] io.PipeStage - x", True),
    ("2022-01-01 00:04:33,7x9 FATAL [w-3] io.PipeStage - x", False),
    ('ts=2022-01-01T00:19:34Z component=a.B level=crit msg="x"', True),
    ('ts=2022-01-01T00:19:34Z level=info component=a.B msg="level=error x"', False),
    ('{"message":"severity","time":"2022-01-01T00:01:50.330Z","severity":"error","logger":"a.B"}', True),
    ('{"severity":"error","time":"9999-99-99T99:99:99.999Z","message":"x","logger":"a.B"}', False),
    (">> 2022-08-30 09:55:11,000 ERROR [w-1] a.B - quoted", False),
    ("", False),
])
def test_layouts_levels_and_times(spark, line, hit):
    assert found(spark, [line]) == ([("a.log", 1, 1)] if hit else [])


def test_continuations_belong_to_the_entry_before(spark):
    error, info = "2022-01-01 00:04:33,739 ERROR [w-3] a.B - x", "2022-01-01 00:04:34,739 INFO [w-3] a.B - x"
    assert found(spark, ["\tlost head", error, "\tat x.Y(Z:1)", "", "  | " + error, info, error]) == [("a.log", 2, 5), ("a.log", 7, 7)]
    # An unreadable stamp still begins an entry.
    assert found(spark, [error, "####-##-## ##:##:##,### INFO [w-3] a.B - x"]) == [("a.log", 1, 1)]


def test_spread_json(spark):
    body = ["{", '  "severity": "Critical",', '  "time": "2022-01-01T00:00:32Z",', '  "logger": "io.C",', '  "message": "m"', "}", "\ttrace"]
    assert found(spark, body) == [("a.log", 1, 7)]
    body[2] = '  "time": "9999-99-99T99:99:99Z",'
    assert found(spark, body) == []


def test_keys_in_a_continuation_speak_for_no_other_layout(spark):
    assert found(spark, ["Jan  1 00:00:40 tbcn562 fsguard[29780]: x", '  "severity": "Error",']) == []


def test_entries_reach_over_blocks_and_files_stay_apart(spark):
    error = "2022-01-01 00:04:33,739 ERROR [w-3] a.B - x"
    rows = [("a", 1, error), *(("a", i, "\tmore") for i in range(2, 30)), ("b", 3, "\tmore")]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    small = L.attach(df.withColumn("begins", F.col("text") == error), block_lines=4)
    assert {(r.log_file, r.first_line_no) for r in small.collect()} == {("a", 1), ("b", None)}


def test_nulls_repeats_and_empty(spark):
    error = "2022-01-01 00:04:33,739 ERROR [w-3] a.B - x"
    extra = [("a.log", 1, error), (None, 4, error), ("a.log", None, error), ("a.log", 3, None)]
    assert found(spark, [error, "more"], extra=extra) == [("a.log", 1, 3)]
    assert L.severe_entries(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fields(spark):
    df = spark.createDataFrame([("a", 1, "[2022/01/01 00:01:31] (info) store.Mover | two  copies")], SCHEMA)
    r = L.entries(df).first()
    assert (r.level, r.component, r.message, str(r.time), r.layout, r.severe) == ("info", "store.Mover", "two  copies", "2022-01-01 00:01:31", "bracket", False)


def test_very_long_line_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    line = "2022-01-01 00:04:33,739 ERROR [w-3] a.B - " + "x1-" * 300_000
    df = spark.createDataFrame([("a", 1, line)], SCHEMA).withColumns({"rule": F.lit(1), "level": F.lit("z"), "signature": F.lit(2)})
    assert [tuple(r) for r in L.severe_entries(df).collect()] == [("a", 1, 1)]


@pytest.mark.parametrize("bound", ["MAX_BROADCAST_SIGNATURES", "MAX_SIGNATURE_LENGTH"])
def test_many_or_long_signatures_are_resolved_in_place(spark, monkeypatch, bound):
    monkeypatch.setattr(L, bound, 1)
    assert found(spark, ["010122 000032 5165 ERROR a.B: x", "a, b", "c; d"]) == [("a.log", 1, 3)]


@pytest.mark.parametrize("component", [".".join(f"part{i}" for i in range(20)), "a$b$" * 50 + "C", "x" * 5000])
def test_long_components_begin_entries(spark, component):
    info = "010122 000031 5165 INFO a.B: y"
    assert found(spark, [info, f"010122 000032 5165 ERROR {component}: x"]) == [("a.log", 2, 2)]


def test_unknown_layouts_are_counted(spark):
    lines = ["\tlost head", "010122 000032 5165 ERROR a.B: x", "NEWPROG 2008-11-09T20:35:20 one", "NEWPROG 2008-11-09T20:35:21 two", "\tat x"]
    rows = [("a", i, t) for i, t in enumerate(lines)] + [("a", 2, lines[2])]
    got = {r.signature: tuple(r)[1:] for r in L.unresolved_signatures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {" w w": (2, 0, 1), "w w:w:w w": (2, 2, 0)}
