"""Text logs with line numbers, and label files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.grouping import LABELS


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, text) of text files; line_no counts from 0 in each file.

    Bytes that are no UTF-8 become U+FFFD; ``\\n``, ``\\r\\n`` and ``\\r`` end a line. A line's number is its place in
    its split plus the lines of the file's earlier splits; only counts per split are gathered, the lines are not moved.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.make_valid_utf8("value").alias("text"))
    per = raw.groupBy("file", "split").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("file", "split", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return raw.join(base, ["file", "split"]).select("file", (F.col("base") + F.col("id") - F.col("least")).alias("line_no"), F.rtrim("text", F.lit("\r\n")).alias("text"))


def read_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(BlockId, Label) of a CSV file with that header (spaces around names and values ignored, case not).

    A wrong header raises; ``strict`` also raises for an unknown label, naming the first row of the file (the header is
    row 1) that has it.
    """
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip(): c for c in rows.columns}
    if not {"BlockId", "Label"} <= names.keys():
        raise ValueError(f"the header needs BlockId and Label, not {', '.join(rows.columns)}")
    out = rows.select(*(F.trim(F.col(f"`{names[c]}`")).alias(c) for c in ("BlockId", "Label")))
    if strict:
        bad = out.where(~F.col("Label").isin(*LABELS) | F.col("Label").isNull()).limit(1).collect()
        if bad:
            # Only now is it worth numbering the rows; blanks may surround the values.
            blank, value = r"^\s*", lambda x: re.escape(x or "")
            pattern = rf"{blank}\"?\s*{value(bad[0].BlockId)}\s*\"?\s*,.*{value(bad[0].Label)}"
            first = read_lines(spark, path).where(F.col("text").rlike(pattern)).agg(F.min("line_no")).first()[0]
            raise ValueError(f"unknown label {bad[0].Label!r} of {bad[0].BlockId}" + ("" if first is None else f" at row {first + 1}"))
    return out
