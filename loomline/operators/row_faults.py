"""Delimited rows into columns per feed, and faulty rows with the reason.

One anchored pattern per schema accepts whole rows. Only rows it refuses go through the field-prefix patterns, which
grow by a field at a time and so name the first broken field; then the values of well-formed rows are checked. The
specifications are a small fixed table, read once to build the patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomline.functions.text import entities, real_time

MAX_FEEDS = 1000
# Fixed values.
LABELS = ("Normal", "Anomaly")
ENTITY_COLUMNS, LABEL_COLUMNS = ("message", "BlockId"), ("label", "Label")
#: Feeds that carry Unix seconds only, no entity and no checked label.
PLAIN_FEEDS = ("ras_export",)
UNIX_RANGE, YEAR_RANGE = (1_000_000_000, 2_208_988_799), (2000, 2039)
REASONS = ("quoting", "column_count", "unparseable_timestamp", "no_blockid", "multiple_blockids", "bad_label")


@dataclass(frozen=True)
class Feed:
    name: str
    delimiter: str
    columns: tuple[str, ...]
    time_column: str | None = None
    plain: bool = False

    @property
    def field(self) -> str:
        """One field: quoted, with doubled quote marks inside, or free of quote marks and delimiters. Never backtracks."""
        return rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{self.escaped}]*+)'

    @property
    def escaped(self) -> str:
        return re.escape(self.delimiter) if self.delimiter != "^" else r"\^"

    def whole(self, n: int | None = None) -> str:
        n = len(self.columns) if n is None else n
        return rf"(?s)\A{self.field}(?:{self.escaped}{self.field}){{{n - 1}}}\z"

    @property
    def well_quoted(self) -> str:
        return rf"(?s)\A{self.field}(?:{self.escaped}{self.field})*+\z"

    def prefix(self, n: int) -> str:
        """The row's first ``n`` fields are whole."""
        return rf"(?s)\A{self.field}(?:{self.escaped}{self.field}){{{n - 1}}}(?={self.escaped}|\z)"

    def value(self, raw: Column, name: str) -> Column:
        """A field's value without its quotes; the row must fit :meth:`whole`."""
        at = self.columns.index(name)
        before, after = rf"(?:{self.field}{self.escaped}){{{at}}}", rf"(?:{self.escaped}|\z)"
        got = F.regexp_extract(raw, rf"(?s)\A{before}({self.field}){after}", 1)
        return F.when(got.startswith('"'), F.replace(F.substring(got, F.lit(2), F.length(got) - 2), F.lit('""'), F.lit('"'))).otherwise(got)


def read_specs(specs: DataFrame) -> list[Feed]:
    """The feeds of a specification table (feed, delimiter, n_columns, column_names, time_column); at most MAX_FEEDS rows."""
    rows: list[Row] = specs.where("feed is not null").limit(MAX_FEEDS + 1).collect()
    if len(rows) > MAX_FEEDS:
        raise ValueError(f"more than {MAX_FEEDS} feed specifications")
    out = []
    for r in sorted(rows, key=lambda r: r.feed):
        columns = tuple(r.column_names.split(r.delimiter))
        if len(columns) != r.n_columns:
            raise ValueError(f"{r.feed}: {r.n_columns} columns, but the names are {columns}")
        out.append(Feed(r.feed, r.delimiter, columns, r.time_column, r.feed in PLAIN_FEEDS))
    return out


def _time_ok(value: Column, plain: bool) -> Column:
    text = F.trim(value)
    low, high = UNIX_RANGE
    unix = text.rlike(r"^[0-9]{10}\z") & text.try_cast("bigint").between(low, high)
    if plain:
        return F.coalesce(unix, F.lit(False))
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?: ([0-9]{2}):([0-9]{2}):([0-9]{2})|T([0-9]{2}):([0-9]{2}):([0-9]{2})Z)\z"
    real = real_time(F.when(text.rlike(iso), F.regexp_replace(text, iso, "$1$2$3$4$5$6$7$8$9")))
    return F.coalesce(unix | (F.year(real).between(*YEAR_RANGE)), F.lit(False))


def _value_reasons(feed: Feed, raw: Column) -> Column:
    found = []
    if feed.time_column:
        found.append(F.when(~_time_ok(feed.value(raw, feed.time_column), feed.plain), "unparseable_timestamp"))
    if not feed.plain:
        for name in feed.columns:
            if name in ENTITY_COLUMNS:
                ids = F.size(entities(feed.value(raw, name)))
                found.append(F.when(ids == 0, "no_blockid").when(ids > 1, "multiple_blockids"))
            if name in LABEL_COLUMNS:
                found.append(F.when(~F.trim(feed.value(raw, name)).isin(*LABELS), "bad_label"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _layout_fault(feed: Feed, raw: Column) -> Column:
    """(broken_field, reasons) of a row that the whole pattern refuses: growing prefixes, tried in turn until one no longer fits.

    Where the prefix before ends the row, fields are missing; else the field itself is broken. Behind the last column
    stand surplus fields, of which one may be broken as well.
    """
    fault = lambda k, reason: F.struct(F.lit(k).alias("broken_field"), F.array(reason).alias("reasons"))
    n = len(feed.columns)
    out = fault(n + 1, F.when(raw.rlike(feed.well_quoted), "column_count").otherwise("quoting"))
    for k in reversed(range(1, n + 1)):
        ended = raw.rlike(feed.whole(k - 1)) if k > 1 else F.lit(False)
        out = F.when(~raw.rlike(feed.prefix(k)), fault(k, F.when(ended, "column_count").otherwise("quoting"))).otherwise(out)
    return out


def check_rows(rows: DataFrame, feeds: list[Feed]) -> DataFrame:
    """``rows`` with ``reasons`` (array of text, empty for a valid row) and ``broken_field`` (1-based; null unless the layout is at fault).

    Needs columns feed and raw; all others pass through. A feed without specification (or null) gets the reason
    ``unknown_feed``, a null raw ``null_row``. Repeated rows are all judged, each by itself; an empty table stays empty.
    """
    raw, feed = F.col("raw"), F.col("feed")
    sound = lambda reasons: F.struct(F.lit(None).cast("int").alias("broken_field"), reasons.alias("reasons"))
    judged = sound(F.array(F.lit("unknown_feed")))
    for x in feeds:
        judged = F.when(feed == x.name, F.when(raw.rlike(x.whole()), sound(_value_reasons(x, raw))).otherwise(_layout_fault(x, raw))).otherwise(judged)
    judged = F.when(raw.isNull(), sound(F.array(F.lit("null_row")))).otherwise(judged)
    return rows.withColumn("_judged", judged).withColumns({"reasons": F.col("_judged.reasons"), "broken_field": F.col("_judged.broken_field")}).drop("_judged")


def faulty_rows(rows: DataFrame, feeds: list[Feed], key: str = "row_id") -> DataFrame:
    """(key, reason): each fault of each row once, however often the row was delivered."""
    return check_rows(rows, feeds).select(key, F.explode("reasons").alias("reason")).distinct()


def broken_fields(rows: DataFrame, feeds: list[Feed], key: str = "row_id") -> DataFrame:
    """(key, feed, broken_field, reason): the first broken field of each row whose layout is at fault, once."""
    return check_rows(rows, feeds).where("broken_field is not null").select(key, "feed", "broken_field", F.get("reasons", F.lit(0)).alias("reason")).distinct()


def valid_rows(rows: DataFrame, feed: Feed, feeds: list[Feed] | None = None, key: str = "row_id") -> DataFrame:
    """The valid rows of one feed: the key and one text column per column of the feed, in its order. Each key once."""
    own = check_rows(rows.where(F.col("feed") == feed.name), [feed]).where(F.size("reasons") == 0)
    return own.dropDuplicates([key]).select(F.col(key).alias("row_key") if key in feed.columns else key, *(feed.value(F.col("raw"), c).alias(c) for c in feed.columns))


def count_faults(rows: DataFrame, feeds: list[Feed], key: str = "row_id") -> DataFrame:
    """Per feed and batch: distinct rows read, valid ones and faults by reason, under the names of the drop counters."""
    once = check_rows(rows, feeds).select("feed", "batch_no", key, "reasons").distinct()
    has = lambda *names: F.count_if(F.arrays_overlap("reasons", F.array(*map(F.lit, names))))
    return once.groupBy("feed", "batch_no").agg(
        F.count(F.lit(1)).alias("total_lines_read"),
        F.count_if(F.size("reasons") == 0).alias("valid"),
        has("no_blockid").alias("no_blockid"),
        has("multiple_blockids").alias("lines_with_multiple_blockids"),
        has("unparseable_timestamp").alias("unparseable_timestamp"),
        has("column_count").alias("column_count"),
        has("quoting").alias("quoting"),
        has("bad_label").alias("bad_label"),
    )
