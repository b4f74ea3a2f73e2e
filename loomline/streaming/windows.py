"""Time windows over a stream of labelled lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.numeric import floor_div
from loomline.operators.grouping import LEAST_LINES, check_window


def stream_windows(parsed: DataFrame, seconds: int, anchor: int, lateness: str = "10 minutes", least: int = LEAST_LINES) -> DataFrame:
    """Counts, label and first time of each window, emitted once the watermark has passed it.

    ``parsed``: event_time TIMESTAMP, ts, anomaly. A stream has no first line, so the anchor is given. Lines later than
    ``lateness`` are dropped, which a batch run does not do; others fall in the same windows as there.
    """
    check_window(seconds)
    slot = F.window(F.col("event_time"), f"{seconds} seconds", startTime=f"{anchor % seconds} seconds")
    per = parsed.withWatermark("event_time", lateness).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n_lines"), F.max("anomaly").alias("label"), F.min("ts").cast("double").alias("start_timestamp"))
    wid = floor_div(F.unix_seconds("slot.start") - anchor, seconds)
    return per.where(F.col("n_lines") >= least).select(wid.alias("source_window_id"), "n_lines", "label", "start_timestamp")
