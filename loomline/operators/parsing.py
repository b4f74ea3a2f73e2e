"""Labelled, time-stamped lines: fields, failures and drop counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import words

#: A replaced character shows that a line was not valid UTF-8.
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
NORMAL_LABEL = "-"
MOST_LISTED = 100


def time_field(line: Column | str) -> Column:
    """The second word as a number; null unless there are three words and it is one."""
    w = words(line)
    return F.when(F.size(w) >= 3, F.get(w, 1).try_cast("bigint"))


def content_field(line: Column | str) -> Column:
    """What follows the first word, its time stamp included."""
    return F.regexp_replace(line, r"^\s*\S+\s+", "")


def anomaly_field(line: Column | str) -> Column:
    """1 for a line whose first word is a label other than NORMAL_LABEL, 0 for that one."""
    return (F.regexp_extract(line, r"^\s*(\S+)", 1) != NORMAL_LABEL).cast("int")


def has_replacement(line: Column | str) -> Column:
    return F.contains(F.col(line) if isinstance(line, str) else line, F.lit(REPLACEMENT))


def parse_labelled(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds label_field, ts, content, anomaly and failure.

    ``failure`` is null for a parsed line, ``missing_content`` for exactly two words (whatever the second), else
    ``unparseable_timestamp`` (blank, one word, no number). The other columns are null where it is set.
    """
    w = F.col("_words")
    ts = F.when(F.size(w) >= 3, F.get(w, 1).try_cast("bigint"))
    failure = F.when(F.size(w) == 2, "missing_content").when(ts.isNull(), "unparseable_timestamp")
    good = failure.isNull() & F.col(text).isNotNull()
    # Words are found once a line, in a step of their own.
    cut = lines.withColumn("_words", words(text))
    return cut.withColumns({
        "failure": F.when(F.col(text).isNull(), "unparseable_timestamp").otherwise(failure),
        "label_field": F.when(good, F.get(w, 0)),
        "ts": F.when(good, ts),
        "content": F.when(good, content_field(text)),
        "anomaly": F.when(good, (F.get(w, 0) != NORMAL_LABEL).cast("int")),
    }).drop("_words")


def drop_counters(parsed: DataFrame, text: str = "text") -> DataFrame:
    """One row of counts over lines that :func:`parse_labelled` read."""
    return parsed.agg(
        F.count(F.lit(1)).alias("total_lines_read"),
        F.count_if(has_replacement(text)).alias("encoding_replacements_seen"),
        F.count_if(F.col("failure") == "unparseable_timestamp").alias("unparseable_timestamp"),
        F.count_if(F.col("failure") == "missing_content").alias("lines_missing_content"),
        F.count_if(F.col("anomaly") == 1).alias("anomalous_lines"),
    )


def replaced_lines(lines: DataFrame, text: str = "text", line_no: str = "line_no", most: int = MOST_LISTED) -> DataFrame:
    """1-based numbers of the first lines with replaced characters (a report; ``line_no`` counts from 0)."""
    return lines.where(has_replacement(text)).select((F.col(line_no) + 1).alias("line_number")).orderBy("line_number").limit(most)


def first_lines(lines: DataFrame, most: int | None, line_no: str = "line_no") -> DataFrame:
    """Lines of a number below ``most`` (all, if None), good and bad alike."""
    return lines if most is None else lines.where(F.col(line_no) < most)
