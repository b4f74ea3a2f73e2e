"""Overlapping segments of long paragraphs, scored one by one and joined by their maximum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(paragraphs: DataFrame, lines_each: int, overlap: float = 0.5) -> DataFrame:
    """(paragraph_id, segment, first_line, lines): stretches of ``lines_each`` lines, each beginning before the last has ended."""
    step = max(1, int(lines_each * (1 - overlap)))
    n = F.size("lines")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - lines_each + step - 1), F.lit(step)))
    each = paragraphs.select("paragraph_id", "lines", F.posexplode(starts).alias("segment", "first_line"))
    return each.select("paragraph_id", "segment", "first_line", F.slice("lines", F.col("first_line") + 1, F.lit(lines_each)).alias("lines"))


def pooled(scores: DataFrame, value: str) -> DataFrame:
    """The largest value of a paragraph's segments."""
    return scores.groupBy("paragraph_id").agg(F.max(value).alias(value))
