"""Integer and threshold arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Threshold grids.
DELTA, POINTS = 0.10, 3
WIDE_BELOW, WIDE_ABOVE, WIDE_CAP, WIDE_POINTS = 0.05, 0.05, 0.995, 5


def floor_div(a: Column, b: Column | int) -> Column:
    """Floor division, also of negative numbers (SQL ``div`` truncates)."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return -floor_div(-a, b)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def linspace(low: float, high: float, n: int) -> list[float]:
    if n < 1:
        raise ValueError("a grid needs a point")
    if n == 1:
        return [high]
    step = (high - low) / (n - 1)
    return [low + step * i for i in range(n)]


def threshold_grid(top1: float, n: int = POINTS, delta: float = DELTA) -> list[float]:
    """``n`` thresholds from ``delta`` below a training accuracy up to it; never below 0."""
    if not 0.0 <= top1 <= 1.0:
        raise ValueError(f"accuracy {top1} is outside 0..1")
    if delta < 0:
        raise ValueError("delta is negative")
    return linspace(max(0.0, top1 - delta), top1, n)


def wide_threshold_grid(top1: float) -> list[float]:
    """Five thresholds around a training accuracy, up to 0.995; one where nothing is left between."""
    if not 0.0 <= top1 <= 1.0:
        raise ValueError(f"accuracy {top1} is outside 0..1")
    low, high = max(0.0, top1 - WIDE_BELOW), min(WIDE_CAP, top1 + WIDE_ABOVE)
    return [high] if low >= high else linspace(low, high, WIDE_POINTS)


def positive_list(text: str) -> list[int]:
    """``"5,9,12"`` to positive numbers."""
    out = [int(x) for x in text.split(",") if x.strip()]
    if not out or any(x < 1 for x in out):
        raise ValueError(f"no list of positive numbers: {text!r}")
    return out
