import csv
import io
import random

import pytest

from loomline.operators import row_faults as R

EVENTS = R.Feed("block_events", ",", tuple("seq,event_time,pid,level,component,message,label".split(",")), "event_time")
RAS = R.Feed("ras_export", ";", tuple("label;unix_ts;date;node;type;component;level;message".split(";")), "unix_ts", plain=True)
LABELS = R.Feed("block_labels", ",", ("BlockId", "Label"))
FEEDS = [EVENTS, RAS, LABELS]


def reasons(spark, feed, raw):
    df = spark.createDataFrame([(1, feed, raw)], "row_id bigint, feed string, raw string")
    return sorted(r.reason for r in R.faulty_rows(df, FEEDS).collect())


OK = "1,{t},2,INFO,a.B,{m},Normal"


@pytest.mark.parametrize("raw,want", [
    (OK.format(t="2022-01-01 00:00:00", m="x blk_1"), []),
    (OK.format(t=" 1640995221 ", m='"x, ""y"" blk_-1\nmore"'), []),
    (OK.format(t="2022-01-01T00:00:00Z", m="blk_1 again blk_1"), []),
    (OK.format(t="2022-02-29 00:00:00", m="blk_1"), ["unparseable_timestamp"]),
    (OK.format(t="1999-12-31 00:00:00", m="blk_1"), ["unparseable_timestamp"]),
    (OK.format(t="2208988800", m="blk_1"), ["unparseable_timestamp"]),
    (OK.format(t="2022-01-01 00:00:00Z", m="blk_1"), ["unparseable_timestamp"]),
    (OK.format(t="bad", m="xblk_1"), ["no_blockid", "unparseable_timestamp"]),
    (OK.format(t="1640995221", m="blk_1 blk_2"), ["multiple_blockids"]),
    (OK.format(t="1640995221", m='"blk_1'), ["quoting"]),
    (OK.format(t="1640995221", m='"blk_1" x'), ["quoting"]),
    (OK.format(t="1640995221", m='x "blk_1"'), ["quoting"]),
    (OK.format(t="1640995221", m="x,blk_1"), ["column_count"]),
    (OK.format(t="1640995221", m="blk_1")[:-6] + " normal", ["bad_label"]),
    ("", ["column_count"]),
    (None, ["null_row"]),
])
def test_events(spark, raw, want):
    assert reasons(spark, "block_events", raw) == want


def test_other_feeds(spark):
    assert reasons(spark, "ras_export", "-;1640995210;2022.01.01;Q;RAS;T;E;no block") == []
    assert reasons(spark, "ras_export", "-;2022-01-01 00:00:00;2022.01.01;Q;RAS;T;E;x") == ["unparseable_timestamp"]
    assert reasons(spark, "block_labels", "blk_1, Anomaly ") == []
    assert reasons(spark, "unheard_of", "x") == ["unknown_feed"]
    assert reasons(spark, None, "x") == ["unknown_feed"]


def test_first_broken_field(spark):
    df = spark.createDataFrame([("block_events", 'a,b,"c')], "feed string, raw string")
    assert R.check_rows(df, FEEDS).first().broken_field == 3


@pytest.mark.parametrize("raw,field,reason", [
    ("blk_1", 2, "column_count"),
    ('"blk_1', 1, "quoting"),
    ('blk_1,x"y', 2, "quoting"),
    ("blk_1,Normal,more", 3, "column_count"),
    ('blk_1,Normal,more,"', 3, "quoting"),
])
def test_reason_comes_from_the_first_broken_field(spark, raw, field, reason):
    df = spark.createDataFrame([(1, "block_labels", raw)] * 2 + [(2, "block_labels", "blk_1,Normal"), (3, "block_labels", None)], "row_id bigint, feed string, raw string")
    assert [tuple(r) for r in R.broken_fields(df, FEEDS).collect()] == [(1, "block_labels", field, reason)]
    assert (1, reason) in [tuple(r) for r in R.faulty_rows(df, FEEDS).collect()]


def test_prefixes_are_part_of_the_faulty_rows(spark):
    df = spark.createDataFrame([], "row_id bigint, feed string, raw string")
    prefix = LABELS.prefix(2)
    assert prefix in R.faulty_rows(df, FEEDS)._jdf.queryExecution().optimizedPlan().toString()


def test_values_round_trip(spark):
    random.seed(3)
    rows = []
    for i in range(60):
        message = "".join(random.choice('ab,"\n ;') for _ in range(random.randrange(12))) + " blk_7"
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([str(i), "1640995221", "2", "INFO", "a.B", message, "Normal"])
        rows.append((i, "block_events", out.getvalue(), message))
    df = spark.createDataFrame([r[:3] for r in rows], "row_id bigint, feed string, raw string")
    got = {r.row_id: r.message for r in R.valid_rows(df, EVENTS).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_repeats_long_texts_and_empty(spark):
    schema = "row_id bigint, feed string, raw string"
    df = spark.createDataFrame([(1, "block_labels", "x"), (1, "block_labels", "x"), (2, "block_labels", '"' + '""' * 200_000 + '",Normal')], schema)
    assert sorted(tuple(r) for r in R.faulty_rows(df, FEEDS).collect()) == [(1, "column_count"), (2, "no_blockid")]
    assert R.faulty_rows(spark.createDataFrame([], schema), FEEDS).collect() == []
    counts = R.count_faults(df.selectExpr("*", "0 as batch_no"), FEEDS).first()
    assert (counts.total_lines_read, counts.valid, counts.column_count) == (2, 0, 1)


def test_specifications(spark):
    schema = "feed string, delimiter string, n_columns int, column_names string, time_column string"
    assert R.read_specs(spark.createDataFrame([("block_labels", ",", 2, "BlockId,Label", None)], schema)) == [LABELS]
    with pytest.raises(ValueError):
        R.read_specs(spark.createDataFrame([("x", ",", 3, "a,b", None)], schema))
