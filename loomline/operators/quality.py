"""Data-quality rules as rows: what was measured, against what, and whether it fired."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules; each fires strictly above its own.
BAD_LINES, MULTI_ENTITY, ENCODING, LENGTH_FACTOR = 0.001, 0.05, 1e-4, 5


class HardFailure(ValueError):
    """A rule that stops a run has fired."""


@dataclass(frozen=True)
class Rule:
    """``value`` is SQL over the measured row."""

    name: str
    value: str
    threshold: float
    hard: bool = False


def _share(part: str, whole: str) -> str:
    return f"coalesce(try_divide(cast({part} as double), cast({whole} as double)), 0D)"


#: Rules over a row of drop counters.
LINE_RULES = (
    Rule("bad_lines", _share("(unparseable_timestamp + lines_missing_content)", "total_lines_read"), BAD_LINES, hard=True),
    Rule("encoding", _share("encoding_replacements_seen", "total_lines_read"), ENCODING),
)
ENTITY_RULES = (Rule("multi_entity", _share("lines_with_multiple_blockids", "total_lines_read"), MULTI_ENTITY),)
WINDOW_RULES = (Rule("anomalous_singletons", "cast(singleton_anomaly_dropped as double)", 0.0),)
LABEL_RULES = (
    Rule("conflicting_labels", "cast(conflicts as double)", 0.0, hard=True),
    Rule("repeated_labels", "cast(repeats as double)", 0.0),
    Rule("missing_labels", "cast(missing as double)", 0.0, hard=True),
)
TRAINING_RULES = (Rule("training_failed", "cast(training_failed as double)", 0.0, hard=True),)
LENGTH_RULES = (
    Rule("longest", _share("max", "max_tokens"), float(LENGTH_FACTOR), hard=True),
    Rule("p95", _share("p95", "max_tokens"), 1.0),
)


def report(measured: DataFrame, rules: tuple[Rule, ...], keys: list[str] | None = None) -> DataFrame:
    """(keys, rule, value, threshold, severity, fired): a row per row of ``measured`` and rule."""
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).alias("value"), F.lit(r.threshold).alias("threshold"), F.lit("hard_fail" if r.hard else "flag").alias("severity")) for r in rules))
    return measured.select(*(keys or []), F.explode(each).alias("r")).select(*(keys or []), "r.*").withColumn("fired", F.col("value") > F.col("threshold"))


def enforce(reported: DataFrame, warn_only: bool = False) -> list[str]:
    """Runs the report; raises for hard rules that fired (unless ``warn_only``), returns the names of the others.

    However many rows fired, one row per rule is fetched, with its largest value and how many there were.
    """
    worst = F.max(F.struct("value", "threshold")).alias("w")
    fired = reported.where("fired").groupBy("rule", "severity").agg(worst, F.count(F.lit(1)).alias("n")).select("rule", "severity", "w.*", "n").orderBy("rule").collect()
    hard = [r for r in fired if r.severity == "hard_fail"]
    if hard and not warn_only:
        raise HardFailure("; ".join(f"{r.rule}: {r.value:.6g} > {r.threshold:.6g}" + (f" (largest of {r.n})" if r.n > 1 else "") for r in hard))
    return sorted({r.rule for r in fired})
