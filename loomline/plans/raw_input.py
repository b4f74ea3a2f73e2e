"""Queries over raw log lines and delimited rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import log_entries, row_faults
from loomline.sources import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return log_entries.severe_entries(table(spark, d, "log_lines"))


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return log_entries.entries(table(spark, d, "log_lines"))


def p5_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return log_entries.unreadable_times(table(spark, d, "log_lines"))


def p5_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return log_entries.unresolved_signatures(table(spark, d, "log_lines"))


def _feeds(spark: SparkSession, d: str) -> list[row_faults.Feed]:
    return row_faults.read_specs(table(spark, d, "feed_specs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = row_faults.faulty_rows(table(spark, d, "raw_rows"), _feeds(spark, d))
    return found.where(F.col("reason").isin(*row_faults.REASONS))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return row_faults.count_faults(table(spark, d, "raw_rows"), _feeds(spark, d))


def p7_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    return row_faults.broken_fields(table(spark, d, "raw_rows"), _feeds(spark, d))


def _valid(spark: SparkSession, d: str, feed: str) -> DataFrame:
    return row_faults.valid_rows(table(spark, d, "raw_rows"), {f.name: f for f in _feeds(spark, d)}[feed])


def p7_block_events(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d, "block_events")


def p7_ras_export(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d, "ras_export")


def p7_block_labels(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d, "block_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_entries, p5_unreadable, p5_unresolved, p7_found, p7_counts, p7_broken_fields, p7_block_events, p7_ras_export, p7_block_labels)}

_LAYOUT_SQL = {
    "ras": (r"^(?:-|[A-Z]+) (\S{10}) \S{10} \S+ RAS \S+ (\S+) ", 1, 2, r"^\d{10}$", ""),
    "glog": (r"^([A-Z])(\S{4} \S\S:\S\S:\S\S\.\S{6}) +\d+ \S+:\d+\] ", 2, 1, r"^\d{4} \d\d:\d\d:\d\d\.\d{6}$", "try_strptime('2000'||t, '%Y%m%d %H:%M:%S.%f')"),
    "session": (r"^(\S{6} \S{6}) \d+ ([A-Za-z]+) [\w.]+: ", 1, 2, r"^\d{6} \d{6}$", "try_strptime(t, '%d%m%y %H%M%S')"),
    "syslog": (r"^(?:<(\d+)>)?([A-Z][a-z]{2} [ \S]\S \S\S:\S\S:\S\S) \S+ [^\s\[]+\[\d+\]: ", 2, 1, r"^[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d$", "try_strptime('2000 '||replace(t,'  ',' '), '%Y %b %d %H:%M:%S')"),
    "bracket": (r"^\[(\S{10} \S{8})\] \((\w+)\) \S+ \| ", 1, 2, r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$", "try_strptime(t, '%Y/%m/%d %H:%M:%S')"),
    "threaded": (r"^(\S{10} \S{8},\S{3}) +([A-Z]+) +\[[^\]]+\] \S+ - ", 1, 2, r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}$", "try_strptime(left(t,19), '%Y-%m-%d %H:%M:%S')"),
    "pairs": (r"^ts=(\S+) (?:component=\S+ )?level=(\w+) ", 1, 2, r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$", "try_strptime(t, '%Y-%m-%dT%H:%M:%SZ')"),
}


def _p5_sql(result: str) -> str:
    """``result`` over g: entries with lv (level) and readable."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kind = " ".join(f"when regexp_matches(text, {quoted(p)}) then '{k}'" for k, (p, *_) in _LAYOUT_SQL.items())
    part = lambda at: " ".join(f"when '{k}' then regexp_extract(text, {quoted(x[0])}, {x[at]})" for k, x in _LAYOUT_SQL.items())
    real = " ".join(f"when '{k}' then regexp_matches(t, {quoted(x[3])})" + (f" and {x[4]} is not null" if x[4] else "") for k, x in _LAYOUT_SQL.items())
    iso = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
    return f"""
    with l as (select distinct log_file, line_no, text from log_lines),
    k as (select *, case when text like '{{"%' then 'json' when text = '{{' then 'open' {kind} end kind from l),
    e as (select *, max(case when kind is not null then line_no end) over (partition by log_file order by line_no) first_line_no from k),
    f as (select *, case kind when 'json' then json_extract_string(text, '$.time') {part(1)} end t,
          case kind when 'json' then json_extract_string(text, '$.severity') {part(2)} end lv from e where first_line_no is not null),
    g as (select log_file, first_line_no, max(line_no) last_line_no, max(kind) kind,
          coalesce(max(case when kind <> 'open' then t end), max(case when kind is null and text like '  "time":%' then regexp_extract(text, '": "(.*?)"', 1) end)) t,
          coalesce(max(case when kind <> 'open' then lv end), max(case when kind is null and text like '  "severity":%' then regexp_extract(text, '": "(.*?)"', 1) end)) lv
          from f group by 1, 2)
    , r as (select *, coalesce(case when regexp_matches(lv, '^\\d+$') then try_cast(lv as int) % 8 <= 3
           else lv <> '' and len(list_filter(['error','severe','failure','critical','alert','emergency','fatal'], lambda w: starts_with(w, lower(lv)))) > 0 end, false) severe,
      coalesce(case kind {real} else regexp_matches(t, '{iso}') and try_strptime(left(t,19), '%Y-%m-%dT%H:%M:%S') is not null end, false) readable from g)
    {result}"""


def _p7_sql(result: str = "select * from f") -> str:
    """``result`` over r (rows), v (their checked values) and f (row_id, reason)."""
    field = lambda d: rf'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    row = lambda d, n: rf"(?s)^{field(d)}(?:{d}{field(d)}){n}$"
    value = lambda d, at: rf"(?s)^(?:{field(d)}{d}){{{at}}}({field(d)})(?:{d}|$)"
    get = lambda d, at: f"(select case when v like '\"%' then replace(v[2:-2], '\"\"', '\"') else v end from (select regexp_extract(raw, '{value(d, at)}', 1) v))"
    unix = r"(regexp_matches(t, '^\d{10}$') and try_cast(t as bigint) between 1000000000 and 2208988799)"
    iso = r"(regexp_matches(t, '^20[0-3]\d-\d\d-\d\d( \d\d:\d\d:\d\d|T\d\d:\d\d:\d\dZ)$') and try_strptime(replace(replace(t,'T',' '),'Z',''), '%Y-%m-%d %H:%M:%S') is not null)"
    ids = r"len(list_distinct(regexp_extract_all(m, '\bblk_-?\d+\b')))"
    return f"""
    with r as (select distinct row_id, feed, raw, case when feed = 'ras_export' then ';' else ',' end d from raw_rows),
    s as (select *, case when feed = 'ras_export' then regexp_matches(raw, '{row(";", "*")}') else regexp_matches(raw, '{row(",", "*")}') end ok,
          case feed when 'ras_export' then regexp_matches(raw, '{row(";", "{7}")}') when 'block_events' then regexp_matches(raw, '{row(",", "{6}")}') else regexp_matches(raw, '{row(",", "{1}")}') end whole from r),
    v as (select row_id, feed, case feed when 'ras_export' then trim({get(";", 1)}) when 'block_events' then trim({get(",", 1)}) end t,
          case feed when 'block_events' then {get(",", 5)} when 'block_labels' then {get(",", 0)} end m,
          case feed when 'block_events' then trim({get(",", 6)}) when 'block_labels' then trim({get(",", 1)}) end lab from s where whole)
    , f as (select row_id, 'quoting' reason from s where not ok
    union all select row_id, 'column_count' from s where ok and not whole
    union all select row_id, 'unparseable_timestamp' from v where feed <> 'block_labels' and not (case when feed = 'ras_export' then {unix} else {unix} or {iso} end)
    union all select row_id, case when {ids} = 0 then 'no_blockid' else 'multiple_blockids' end from v where feed <> 'ras_export' and {ids} <> 1
    union all select row_id, 'bad_label' from v where feed <> 'ras_export' and lab not in ('Normal', 'Anomaly')) {result}"""


def _p7_valid_sql(feed: str, delimiter: str, columns: str) -> str:
    field = rf'(?:"(?:[^"]|"")*"|[^"{delimiter}]*)'
    raw = lambda at: rf"regexp_extract(raw, '(?s)^(?:{field}{delimiter}){{{at}}}({field})(?:{delimiter}|$)', 1)"
    bare = lambda x: f"case when {x} like '\"%' then replace(({x})[2:-2], '\"\"', '\"') else {x} end"
    values = ", ".join(f'{bare(raw(i))} as "{c}"' for i, c in enumerate(columns.split(",")))
    return _p7_sql(f"select row_id, {values} from (select distinct row_id, feed, raw from r) where feed = '{feed}' and row_id not in (select row_id from f)")


def _p7_broken_sql(feeds: dict[str, tuple[str, int]]) -> str:
    """The first field after which no row prefix of whole fields ends, by feed; the one behind the last if all do."""

    def first(delimiter: str, n: int) -> str:
        field = rf'(?:"(?:[^"]|"")*"|[^"{delimiter}]*)'
        ends = lambda k: rf"regexp_matches(raw, '(?s)^{field}(?:{delimiter}{field}){{{k - 1}}}(?:{delimiter}|$)')"
        return "case " + " ".join(f"when not {ends(k)} then {k}" for k in range(1, n + 1)) + f" else {n + 1} end"

    kinds = " ".join(f"when '{feed}' then {first(*x)}" for feed, x in feeds.items())
    return _p7_sql(f"select row_id, feed, cast(case feed {kinds} end as int) broken_field, reason from (select distinct row_id, feed, raw from r) join f using (row_id) where reason in ('quoting', 'column_count')")


_COUNTED = {"no_blockid": "no_blockid", "multiple_blockids": "lines_with_multiple_blockids", "unparseable_timestamp": "unparseable_timestamp", "column_count": "column_count", "quoting": "quoting", "bad_label": "bad_label"}

ORACLE_SQL: dict[str, str] = {
    "p5_found": _p5_sql("select log_file, first_line_no, last_line_no from r where severe and readable"),
    "p5_unreadable": _p5_sql("select log_file, count(*) n_entries, count(*) filter (not readable) unparseable_timestamp from r group by 1"),
    "p7_found": _p7_sql(),
    "p7_counts": _p7_sql("select feed, batch_no, count(*) total_lines_read, count(*) filter (row_id not in (select row_id from f)) valid, " + ", ".join(f"count(*) filter (row_id in (select row_id from f where reason = '{k}')) {n}" for k, n in _COUNTED.items()) + " from (select distinct row_id, feed, batch_no from raw_rows) group by 1, 2"),
    "p7_broken_fields": _p7_broken_sql({"ras_export": (";", 8), "block_events": (",", 7), "block_labels": (",", 2)}),
    "p7_block_events": _p7_valid_sql("block_events", ",", "seq,event_time,pid,level,component,message,label"),
    "p7_ras_export": _p7_valid_sql("ras_export", ";", "label,unix_ts,date,node,type,component,level,message"),
    "p7_block_labels": _p7_valid_sql("block_labels", ",", "BlockId,Label"),
}
