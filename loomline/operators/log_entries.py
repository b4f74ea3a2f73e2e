"""Raw log lines of many programs into entries with time, level, component and message.

Shape signatures: the head of each line is collapsed to a short signature (word-like runs to ``w``); every *distinct*
signature is resolved once to a layout or to none, and the small table of signatures that begin an entry is broadcast.
Signatures that are long, and all of them where there are too many to broadcast, are resolved in place by the same
expression, so the rows are the same and no line is moved for it. Lines of no layout are attached to the entry
before them in their file. Files are cut into blocks of line numbers, so no task holds a whole file.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import MONTHS, real_time, shape

#: Fields of a line that its signature covers; no layout's signature looks further.
SIGNATURE_FIELDS = 8
#: What is broadcast at most: signatures, and characters of one. Others are resolved in place.
MAX_BROADCAST_SIGNATURES, MAX_SIGNATURE_LENGTH = 50_000, 100
#: Line numbers a block of a file covers.
BLOCK_LINES = 8192
# Names of the levels that count as error or worse; prefixes of them count too.
SEVERE = ("error", "severe", "failure", "critical", "alert", "emergency", "fatal")


@dataclass(frozen=True)
class Layout:
    """``signature`` is matched against a line's shape, ``line`` against the line itself; the rest are group numbers."""

    name: str
    signature: str
    line: str
    time: int
    level: int
    component: int
    message: int


# The layouts, by shape and by line. In a time, digits may be lost.
LAYOUTS = (
    Layout("ras", r"^w w w \S+ w \S+ \S+", r"^(?:-|[A-Z][A-Z0-9_]*) (\S{10}) \S{4}\.\S\S\.\S\S \S+ RAS (\S+) (\S+) ?(.*)$", 1, 3, 2, 4),
    Layout("glog", r"^w w:w:w w \S+:w\]", r"^([A-Z])(\S{4} \S\S:\S\S:\S\S\.\S{6}) +\d+ ([^\s\]]+:\d+)\] ?(.*)$", 2, 1, 3, 4),
    Layout("session", r"^w w w w \S+:", r"^(\S{6} \S{6}) \d+ ([A-Za-z]+) ([\w.$]+): ?(.*)$", 1, 2, 3, 4),
    Layout("syslog", r"^(<w>)?w w w:w:w \S+ \S+\[w\]:", r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \S]\S \S\S:\S\S:\S\S) \S+ ([^\s\[]+)\[\d+\]: ?(.*)$", 2, 1, 3, 4),
    Layout("bracket", r"^\[w w:w:w\] \(w\)", r"^\[(\S{4}/\S\S/\S\S \S\S:\S\S:\S\S)\] \((\w+)\) (\S+) \| ?(.*)$", 1, 2, 3, 4),
    Layout("threaded", r"^w w:w:w,w w \[", r"^(\S{10} \S\S:\S\S:\S\S,\S{3}) +([A-Za-z]+) +\[[^\]]+\] (\S+) - ?(.*)$", 1, 2, 3, 4),
    Layout("pairs", r"^w=w:w:w w=", r'^ts=(\S+)(?= )(?=(?: [a-z]+=[^"\s]+)*? level=(\w+))(?=(?: [a-z]+=[^"\s]+)*? component=([^"\s]+)).*? msg="(.*?)"(?: [a-z]+=\S*)*$', 1, 2, 3, 4),
)
#: JSON entries: on one line, or spread over lines from { to }.
_JSON, _OPEN, _KEY, _CLOSE = r'^\{ ?"w":', r"^\{ ?$", r'^ "w":', r"^\} ?$"
_KEYS = {"time": ("time", "ts", "timestamp"), "level": ("severity", "level"), "component": ("logger", "component"), "message": ("message", "msg")}


def is_severe(level: Column) -> Column:
    """Error or worse, in any spelling or abbreviation; a bare number is a priority, of which the lowest three bits count."""
    names = sorted({w[:n] for w in SEVERE for n in range(1, len(w) + 1)} | {w + "s" for w in SEVERE})
    word = F.lower(level).isin(*names)
    return F.coalesce(F.when(level.rlike(r"^[0-9]{1,3}$"), F.pmod(level.try_cast("int"), F.lit(8)) <= 3).otherwise(word), F.lit(False))


def read_time(layout: Column, text: Column) -> Column:
    """The time stamp of an entry as a timestamp, null where it is not a real date and time. Layouts without a year are read in 2000."""
    iso = r"^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.,][0-9]+)?Z?$"
    digits = lambda pattern, to: F.when(text.rlike(pattern), F.regexp_replace(text, pattern, to))
    month = (F.instr(F.lit(MONTHS), F.substring(text, 1, 3)) + 2) / 3
    syslog = F.when(
        text.rlike(r"^[A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}$") & (F.instr(F.lit(MONTHS), F.substring(text, 1, 3)) % 3 == 1),
        F.concat(F.lit("2000"), F.lpad(month.cast("int").cast("string"), 2, "0"), F.translate(F.substring(text, 5, 2), " ", "0"), F.translate(F.substring(text, 8, 8), ":", "")),
    )
    return (
        F.when(layout == "ras", F.when(text.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("bigint"))))
        .when(layout == "glog", real_time(digits(r"^([0-9]{4}) ([0-9]{2}):([0-9]{2}):([0-9]{2})\.[0-9]{6}$", "2000$1$2$3$4")))
        .when(layout == "session", real_time(digits(r"^([0-9]{2})([0-9]{2})([0-9]{2}) ([0-9]{6})$", "20$3$2$1$4")))
        .when(layout == "syslog", real_time(syslog))
        .otherwise(real_time(digits(iso, "$1$2$3$4$5$6")))
    )


def rule_of(signature: Column) -> Column:
    """The rule a signature resolves to, null for continuations."""
    rule = F.lit(None).cast("string")
    for name, pattern in (("json", _JSON), ("open", _OPEN), ("key", _KEY), ("close", _CLOSE), *((x.name, x.signature) for x in reversed(LAYOUTS))):
        rule = F.when(signature.rlike(pattern), name).otherwise(rule)
    return rule


def _resolved(lines: DataFrame) -> DataFrame:
    """``lines`` with ``signature`` and ``rule``."""
    signed = lines.withColumn("signature", shape("text", SIGNATURE_FIELDS))
    short = F.length("signature") <= MAX_SIGNATURE_LENGTH
    rules = signed.where(short).select("signature").distinct().select("signature", rule_of(F.col("signature")).alias("rule"))
    # Counted by collecting one more than may be broadcast.
    # No filter on the rule here: it would be pushed below the distinct and resolve every line.
    known = rules.limit(MAX_BROADCAST_SIGNATURES + 1).collect()
    if len(known) > MAX_BROADCAST_SIGNATURES:
        return signed.withColumn("rule", rule_of(F.col("signature")))
    known = [r for r in known if r.rule is not None]
    kept = pa.table({"signature": [r.signature for r in known], "rule": [r.rule for r in known]}, pa.schema([("signature", pa.string()), ("rule", pa.string())]))
    found = signed.join(F.broadcast(lines.sparkSession.createDataFrame(kept)), "signature", "left")
    return found.withColumn("rule", F.when(short, F.col("rule")).otherwise(rule_of(F.col("signature"))))


def _parts(rule: Column, text: Column) -> Column:
    """time, level, component and message of a line as its layout's own pattern gives them, in one match; shorter if it does not fit.

    No group can hold a line break, which parts them here.
    """
    cut = F.lit("")
    for x in LAYOUTS:
        cut = F.when(rule == x.name, F.regexp_replace(text, x.line, "\n" + "\n".join(f"${n}" for n in (x.time, x.level, x.component, x.message)))).otherwise(cut)
    return F.split(cut, "\n")


_FIELDS = ("time", "level", "component", "message")


def _fields(rule: Column, text: Column, parts: Column, fits: Column) -> dict[str, Column]:
    """time, level, component and message as text, null where the rule's own pattern does not fit the line."""
    out = {}
    for n, field in enumerate(_FIELDS, 1):
        one = F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in _KEYS[field]))
        key = F.nullif(F.regexp_extract(text, rf'^\s*"(?:{"|".join(_KEYS[field])})"\s*:\s*"((?:[^"\\]|\\.)*+)"', 1), F.lit(""))
        out[field] = F.when(rule == "json", one).when(rule == "key", key).when(fits, F.nullif(F.get(parts, F.lit(n)), F.lit("")))
    return out


def _begins(rule: Column, text: Column) -> Column:
    """Whether a line of this rule begins an entry: its layout's own pattern must fit too."""
    fits = F.lit(False)
    for x in LAYOUTS:
        fits = F.when(rule == x.name, text.rlike(x.line)).otherwise(fits)
    return F.coalesce(rule.isin("json", "open") | fits, F.lit(False))


def attach(lines: DataFrame, block_lines: int = BLOCK_LINES, starts: DataFrame | None = None) -> DataFrame:
    """Adds ``first_line_no``: that of the entry each line belongs to, null before a file's first entry.

    ``lines`` has log_file, line_no and begins. Within a block the last beginning so far is taken; what a block
    begins with comes from the blocks before it, through one row per block. ``starts``: the same three columns, where
    they come cheaper than with ``lines``.
    """
    block = F.floor(F.col("line_no") / block_lines)
    own = Window.partitionBy("log_file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("block", block).withColumn("own", F.max(F.when(F.col("begins"), F.col("line_no"))).over(own))
    before = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        (lines if starts is None else starts)
        .withColumn("block", block)
        .groupBy("log_file", "block")
        .agg(F.max(F.when(F.col("begins"), F.col("line_no"))).alias("last"))
        .select("log_file", "block", F.max("last").over(before).alias("carried"))
        .where("carried is not null")
    )
    joined = marked.join(carried, ["log_file", "block"], "left")
    return joined.withColumn("first_line_no", F.coalesce("own", "carried")).drop("block", "own", "carried")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Each line with the fields its layout gives and the first line of its entry.

    Input: log_file, line_no, text (others are ignored). Output: log_file, line_no, text, signature, begins, rule, time,
    level, component, message (texts), first_line_no. Lines without a file or number are left out, a null text is a
    continuation; a line delivered repeatedly comes out as often (:func:`entries` counts it once); an empty table
    gives an empty result.
    """
    source = lines.select(F.col("log_file"), F.col("line_no"), F.col("text")).where("log_file is not null and line_no is not null")
    rule, text = F.col("rule"), F.col("text")
    # Each line meets its layout's pattern once, in a step of its own.
    known = _resolved(source)
    cut = known.withColumn("_parts", _parts(rule, text))
    fits = F.coalesce(F.size("_parts") > len(_FIELDS), F.lit(False))
    begins = F.coalesce(rule.isin("json", "open"), F.lit(False)) | fits
    starts = known.select("log_file", "line_no", _begins(rule, text).alias("begins"))
    return attach(cut.withColumns({"begins": begins} | _fields(rule, text, F.col("_parts"), fits)).drop("_parts"), starts=starts)


def entries(lines: DataFrame) -> DataFrame:
    """One row per entry: log_file, first_line_no, last_line_no, layout, time, time_text, level, severe, component, message.

    A JSON entry spread over lines takes its fields from the lines up to its closing brace. ``time`` is null where the
    stamp is unreadable (``time_text`` keeps it). Repeated lines, nulls and empty tables: see :func:`parse_lines`.
    """
    parsed = parse_lines(lines).where("first_line_no is not null")
    fields = _FIELDS
    # Of the lines after the first, only the keys of a spread JSON entry speak for it.
    key = lambda c: F.min_by(c, F.when((F.col("rule") == "key") & F.col(c).isNotNull(), F.col("line_no")))
    grouped = parsed.groupBy("log_file", "first_line_no").agg(
        F.max("line_no").alias("last_line_no"),
        F.max(F.when(F.col("begins"), F.col("rule"))).alias("rule"),
        *(F.max(F.when(F.col("begins"), F.col(c))).alias(c) for c in fields),
        *(key(c).alias(f"key_{c}") for c in fields),
    )
    spread = F.col("rule") == "open"
    out = grouped.withColumns({c: F.when(spread, F.col(f"key_{c}")).otherwise(F.col(c)) for c in fields})
    layout = F.when(spread, "json").otherwise(F.col("rule"))
    return out.select(
        "log_file",
        "first_line_no",
        "last_line_no",
        layout.alias("layout"),
        read_time(layout, F.col("time")).alias("time"),
        F.col("time").alias("time_text"),
        "level",
        is_severe(F.col("level")).alias("severe"),
        "component",
        "message",
    )


def severe_entries(lines: DataFrame) -> DataFrame:
    """(log_file, first_line_no, last_line_no) of the entries of level error or worse whose time stamp can be read."""
    return entries(lines).where(F.col("severe") & F.col("time").isNotNull()).select("log_file", "first_line_no", "last_line_no")


def unreadable_times(lines: DataFrame) -> DataFrame:
    """Per file: entries, and entries whose time stamp cannot be read."""
    return (
        entries(lines)
        .groupBy("log_file")
        .agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("time").isNull()).alias("unparseable_timestamp"))
    )


def unresolved_signatures(lines: DataFrame) -> DataFrame:
    """(signature, n_lines, n_timed, n_leading): signatures of the lines that no layout knows, so that a new layout does not go unseen.

    Such a line counts as a continuation. ``n_timed`` of them hold a time of day or Unix seconds among the signature's
    fields, as the first line of an entry would; ``n_leading`` stand before their file's first entry and so belong to
    none. A line counts once, however often it was delivered.
    """
    lost = parse_lines(lines).where("not begins and (rule is null or rule not in ('key', 'close'))")
    once = lost.select("log_file", "line_no", "signature", "text", F.col("first_line_no").isNull().alias("leading")).distinct()
    timed = F.regexp_extract("text", rf"^(?:\s*+\S++){{0,{SIGNATURE_FIELDS}}}", 0).rlike(r"(?<![0-9:])[0-9]{2}:[0-9]{2}:[0-9]{2}(?![0-9:])|\b1[0-9]{9}\b")
    return once.groupBy("signature").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(timed).alias("n_timed"), F.count_if("leading").alias("n_leading"))


__all__ = ["Layout", "LAYOUTS", "attach", "entries", "is_severe", "parse_lines", "read_time", "rule_of", "severe_entries", "unreadable_times", "unresolved_signatures"]
