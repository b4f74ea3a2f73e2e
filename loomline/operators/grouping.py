"""Lines into paragraphs: sessions by entity id, tumbling windows by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.numeric import floor_div
from loomline.functions.text import entities

# Fixed values.
LABELS = {"Normal": 0, "Anomaly": 1}
USUAL_WINDOWS = (10, 30, 60)
DATASETS = ("bgl", "tbird")
LEAST_LINES = 2


class MissingLabel(ValueError):
    """An entity of the log has no label."""


def mentions(lines: DataFrame, text: str = "text", line_no: str = "line_no") -> DataFrame:
    """One row per line and distinct entity in it: the line's columns, pos (place in the line), block_id. Lines without are left out."""
    return lines.select("*", F.posexplode(entities(text)).alias("pos", "block_id"))


def entity_counters(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines read, lines without entity, lines with several."""
    n = F.coalesce(F.size(entities(text)), F.lit(0))
    return lines.agg(
        F.count(F.lit(1)).alias("total_lines_read"),
        F.count_if(n < 1).alias("no_blockid"),
        F.count_if(n > 1).alias("lines_with_multiple_blockids"),
    )


def label_table(rows: DataFrame) -> DataFrame:
    """(block_id, label 0/1, n_rows, n_labels) of label rows (BlockId, Label), spaces around values ignored.

    Names of columns may have spaces too, but keep their case. n_rows above 1 are repeats, n_labels above 1 conflicts
    (label is then null); unknown labels give a null label and n_labels 0.
    """
    named = rows.select(*(F.col(f"`{c}`").alias(c.strip()) for c in rows.columns))
    label = F.trim("Label")
    coded = F.when(label == "Normal", 0).when(label == "Anomaly", 1)
    per = named.select(F.trim("BlockId").alias("block_id"), coded.alias("label")).groupBy("block_id")
    n = F.count_distinct("label")
    return per.agg(F.when(n == 1, F.max("label")).alias("label"), F.count(F.lit(1)).alias("n_rows"), n.alias("n_labels"))


def missing_labels(mentioned: DataFrame, labels: DataFrame, line_no: str = "line_no") -> DataFrame:
    """(block_id, line_number): entities without label and the 1-based line of first mention."""
    absent = mentioned.join(labels.where("label is not null").select("block_id"), "block_id", "left_anti")
    return absent.groupBy("block_id").agg((F.min(line_no) + 1).alias("line_number"))


def session_paragraphs(lines: DataFrame, labels: DataFrame, text: str = "text", line_no: str = "line_no", strict: bool = False) -> DataFrame:
    """A paragraph per entity: all lines that mention it, in file order.

    Columns: paragraph_id, lines, label, source_blockid, first_line, first_pos; the last two give the order of first
    appearance (two entities of one line: as they stand in it). ``strict`` raises :class:`MissingLabel` for an entity
    without label; else it is left out. Labels never mentioned give nothing.
    """
    found = mentions(lines, text, line_no)
    known = labels.where("label is not null").select("block_id", "label")
    if strict:
        lost = missing_labels(found, labels, line_no).orderBy("line_number").limit(1).collect()
        if lost:
            raise MissingLabel(f"{lost[0].block_id} on line {lost[0].line_number} has no label")
    per = found.groupBy("block_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(line_no).alias("at"), F.col(text).alias("line")))).alias("rows"),
        F.min(F.struct(F.col(line_no).alias("line"), F.col("pos").alias("pos"))).alias("first"),
    )
    return per.join(known, "block_id").select(
        F.col("block_id").alias("paragraph_id"),
        F.transform("rows", lambda r: r["line"]).alias("lines"),
        "label",
        F.col("block_id").alias("source_blockid"),
        F.col("first.line").alias("first_line"),
        F.col("first.pos").alias("first_pos"),
    )


def check_window(seconds: int, dataset: str | None = None) -> list[str]:
    """Raises for a window that is not positive or an unknown data set; returns warnings for unusual windows."""
    if seconds <= 0:
        raise ValueError("a window needs a positive length")
    if dataset is not None and dataset not in DATASETS:
        raise ValueError(f"unknown data set {dataset}")
    return [] if seconds in USUAL_WINDOWS else [f"window of {seconds} s is none of {USUAL_WINDOWS}"]


def with_window(parsed: DataFrame, seconds: int, line_no: str = "line_no") -> DataFrame:
    """Parsed lines with their window: (ts - anchor) // seconds, the anchor being the first readable time in file order.

    Earlier times get negative windows. Lines that failed to parse are left out.
    """
    check_window(seconds)
    good = parsed.where("ts is not null")
    anchor = good.agg(F.min_by("ts", line_no).alias("anchor"))  # one row
    return good.crossJoin(F.broadcast(anchor)).withColumn("window_id", floor_div(F.col("ts") - F.col("anchor"), seconds)).drop("anchor")


def window_sizes(windowed: DataFrame) -> DataFrame:
    """Lines, label and first time of each window."""
    return windowed.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("anomaly").alias("label"), F.min("ts").cast("double").alias("start_timestamp"))


def window_paragraphs(parsed: DataFrame, seconds: int, dataset: str, line_no: str = "line_no", least: int = LEAST_LINES) -> DataFrame:
    """A paragraph per window of at least ``least`` lines: paragraph_id, lines (file order), label (any anomalous), source_window_id, start_timestamp."""
    check_window(seconds, dataset)
    per = with_window(parsed, seconds, line_no).groupBy("window_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(line_no).alias("at"), F.col("content").alias("line")))).alias("rows"),
        F.max("anomaly").alias("label"),
        F.min("ts").cast("double").alias("start_timestamp"),
    )
    return per.where(F.size("rows") >= least).select(
        F.concat(F.lit(f"{dataset}_{seconds}s_w"), F.col("window_id").cast("string")).alias("paragraph_id"),
        F.transform("rows", lambda r: r["line"]).alias("lines"),
        "label",
        F.col("window_id").alias("source_window_id"),
        "start_timestamp",
    )


def in_order(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs sorted as they appear: sessions by first mention, windows by number; others by id."""
    for keys in (["first_line", "first_pos"], ["source_window_id"]):
        if set(keys) <= set(paragraphs.columns):
            return paragraphs.orderBy(*keys)
    return paragraphs.orderBy("paragraph_id")


def dropped_windows(windowed: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """Windows kept and dropped for size, the latter by label."""
    small = F.col("n_lines") < least
    return window_sizes(windowed).agg(
        F.count_if(~small).alias("windows_kept"),
        F.count_if(small & (F.col("label") == 0)).alias("singleton_normal_dropped"),
        F.count_if(small & (F.col("label") == 1)).alias("singleton_anomaly_dropped"),
    )


def line_positions(windowed: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Each line's place (from 0) in its window and the window's size.

    A window is a stretch of time; the caller bounds it by ``seconds``.
    """
    order = Window.partitionBy("window_id").orderBy(line_no)
    return windowed.withColumn("idx", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("window_id")))
