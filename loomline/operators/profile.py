"""Lengths, vocabularies and positions of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.numeric import ratio
from loomline.functions.text import word_count, words
from loomline.sources.shared import written

# Backbones by a part of their name, with limits and batch sizes.
LONG_MARK = "longformer"
LONG_LIMIT, SHORT_LIMIT = 4096, 512
LONG_BATCH, SHORT_BATCH = 2, 8
SHORT_BACKBONE, LONG_BACKBONE = "roberta-base", "allenai/longformer-base-4096"
QUANTILE_WORDS = 512
EARLY = (0.10, 0.25)
VERDICTS = ((0.10, "STRONGLY EARLY"), (0.30, "EARLY"), (0.70, "DISTRIBUTED / MIDDLE"))
LAST_VERDICT = "LATE"


def lines_words(lines: Column | str) -> Column:
    """Words of all lines together."""
    return F.coalesce(word_count(F.array_join(lines, "\n")), F.lit(0))


def lines_tokens(lines: Column | str) -> Column:
    """1 + the sum over lines of (tokens + 1), words standing for tokens; an empty paragraph is 2 for its two end marks."""
    kept = F.array_compact(lines)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) < 1, F.lit(2)).otherwise(1 + lines_words(kept) + F.size(kept)).cast("bigint")


def length_distribution(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """min, max and interpolated p50, p80, p95, p99; all 0 for no rows.

    Equal lengths are counted first, so the exact percentiles run over distinct lengths.
    """
    group = group or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.8, 0.95, 0.99))), F.col("_n"))
    at = lambda i: F.coalesce(F.get(F.col("p"), i), F.lit(0.0))
    out = counted.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("_n").alias("n"), p.alias("p"))
    return out.select(*group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lo", F.lit(0)).alias("min"), F.coalesce("hi", F.lit(0)).alias("max"), *(at(i).alias(f"p{q}") for i, q in enumerate((50, 80, 95, 99))))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, k): distinct values of a number column and their rows, written once for several readers."""
    return written(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k")), "values")


def quantiles(counts: DataFrame, shares: tuple[float, ...], buckets: int = 4096) -> DataFrame:
    """One row with ``p``: exact interpolated quantiles of :func:`value_counts`, in the order of ``shares``; null entries without values.

    The range of the values is cut into buckets, whose totals tell which of them hold the ranks asked for; only the
    values of those are put in order, so neither one task nor the driver holds all values.
    """
    counted = counts.select(F.col("v").alias("_v"), F.col("k").alias("_k"))
    span = counted.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_k").alias("_n"))  # one row
    place = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    cut = counted.crossJoin(F.broadcast(span)).withColumn("_b", F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int"))
    sums = cut.groupBy("_b").agg(F.sum("_k").alias("_s"), F.first("_n").alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # ``buckets`` rows
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(upto), F.lit(0)))
    at = [(F.floor(s * (F.col("_n") - 1)), F.ceil(s * (F.col("_n") - 1)), F.lit(s) * (F.col("_n") - 1)) for s in shares]
    holds = F.lit(False)
    for low, high, _ in at:
        for i in (low, high):
            holds = holds | ((F.col("_base") <= i) & (i < F.col("_base") + F.col("_s")))
    hit = base.where(holds).select("_b", "_base")  # at most two a share
    order = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.join(F.broadcast(hit), "_b").withColumn("_to", F.col("_base") + F.sum("_k").over(order))
    value_at = lambda i: F.min(F.when(F.col("_to") > i, F.col("_v")))
    out = placed.agg(F.first("_n").alias("_n"), *(value_at(i).alias(f"_{side}{n}") for n, (low, high, _) in enumerate(at) for side, i in (("l", low), ("h", high))))
    between = [F.col(f"_l{n}") + (F.col(f"_h{n}") - F.col(f"_l{n}")) * (exact - F.floor(exact)) for n, (_, _, exact) in enumerate(at)]
    return out.select(F.array(*between).alias("p"))


def label_counts(paragraphs: DataFrame, group: list[str]) -> DataFrame:
    """Paragraphs, normal and anomalous ones and the share of the latter."""
    normal, anomaly = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return paragraphs.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), normal.alias("normal"), anomaly.alias("anomaly"), ratio(anomaly, F.count(F.lit(1))).alias("anomaly_rate"))


def backbone_limit(name: Column | str) -> Column:
    return F.when(F.contains(F.lower(name), F.lit(LONG_MARK)), LONG_LIMIT).otherwise(SHORT_LIMIT)


def backbone_batch(name: Column | str) -> Column:
    return F.when(F.contains(F.lower(name), F.lit(LONG_MARK)), LONG_BATCH).otherwise(SHORT_BATCH)


def choose_backbone(p80: Column | str, most: int = QUANTILE_WORDS) -> Column:
    """The short backbone while 80 % of the paragraphs have at most ``most`` words."""
    return F.when((F.col(p80) if isinstance(p80, str) else p80) <= most, SHORT_BACKBONE).otherwise(LONG_BACKBONE)


def rationale(p80: Column | str, kind: str, most: int = QUANTILE_WORDS) -> Column:
    """The decision in words; ``kind``: word_length or token_length."""
    p80 = F.col(p80) if isinstance(p80, str) else p80
    sign = F.when(p80 <= most, "<=").otherwise(">")
    return F.concat(F.lit(f"p80({kind}) = "), F.format_string("%.1f", p80), F.lit(" "), sign, F.lit(f" threshold {most} → "), choose_backbone(p80, most))


def length_gate(paragraphs: DataFrame, limits: DataFrame, group: list[str]) -> DataFrame:
    """Per group and backbone: token lengths, the share over the limit and the two length rules."""
    sized = paragraphs.select(*group, lines_tokens("lines").alias("tokens"))
    spread = length_distribution(sized, "tokens", group)
    counts = sized.groupBy(*group, "tokens").agg(F.count(F.lit(1)).alias("k"))
    # Limits are a fixed small table; lengths are counted before they meet it.
    over = counts.crossJoin(F.broadcast(limits.select("backbone", "max_tokens"))).groupBy(*group, "backbone", "max_tokens").agg(ratio(F.sum(F.when(F.col("tokens") > F.col("max_tokens"), F.col("k")).otherwise(0)), F.sum("k")).alias("truncation_rate"))
    out = over.join(spread, group)
    return out.withColumn("hard_fail", F.col("max") > 5 * F.col("max_tokens")).withColumn("flag", F.col("p95") > F.col("max_tokens"))


def longest(paragraphs: DataFrame, group: list[str]) -> DataFrame:
    """The longest paragraph of each group by words (two end marks added), the first of ties by ord then id."""
    sized = paragraphs.select(*group, "paragraph_id", "ord", (lines_words("lines") + 2).alias("n"))
    best = F.max_by(F.col("paragraph_id"), F.struct(F.col("n"), -F.col("ord")))
    return sized.groupBy(*group).agg(best.alias("paragraph_id"), F.max("n").alias("n_tokens"))


def index_stats(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Mean, min, max and order statistics by index: sorted[n // 2] and sorted[min(n - 1, int(0.95 n))], not interpolated.

    Equal values are counted and ranked by running counts, so only distinct values meet.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    up = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_k").over(up)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*group)))
    at = lambda i: F.min(F.when(F.col("_to") > i, F.col("_v")))
    middle, high = F.floor(F.col("_n") / 2), F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95))
    return placed.groupBy(*group).agg(
        F.max("_n").alias("n"),
        ratio(F.sum(F.col("_v") * F.col("_k")), F.sum("_k")).alias("mean"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), at(middle).alias("p50"), at(high).alias("p95"),
    )


def vocabulary(paragraphs: DataFrame, group: list[str]) -> DataFrame:
    """(group, token, n, n_paragraphs): uses of each word and paragraphs with it. Null arrays have no words.

    A word is counted within its paragraph first.
    """
    exploded = paragraphs.select(*group, "paragraph_id", F.explode(words(F.array_join("lines", "\n"))).alias("token"))
    per = exploded.groupBy(*group, "paragraph_id", "token").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(*group, "token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_paragraphs"))


def vocabulary_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of two vocabularies (token), of what they share and of each one's own, and their Jaccard similarity."""
    a, b = left.select("token").distinct().withColumn("a", F.lit(1)), right.select("token").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "token", "full")
    n = lambda c: F.count_if(c)
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(n(in_a).alias("n_left"), n(in_b).alias("n_right"), n(in_a & in_b).alias("n_shared"), n(in_a & ~in_b).alias("only_left"), n(~in_a & in_b).alias("only_right"), ratio(n(in_a & in_b), F.count(F.lit(1))).alias("jaccard"))


def own_tokens(left: DataFrame, right: DataFrame, total: Column, most: int) -> DataFrame:
    """The ``most`` commonest tokens of ``left`` (token, n, n_paragraphs) that ``right`` lacks, with their share of paragraphs; ties by token, descending."""
    own = left.join(right.select("token"), "token", "left_anti")
    return own.orderBy(F.col("n").desc(), F.col("token").desc()).limit(most).select("token", "n", ratio(F.col("n_paragraphs"), total).alias("share"))


def shown(text: Column | str, most: int) -> Column:
    """A text for display: what is longer than ``most`` characters ends in three full stops."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def first_lines(lines: Column | str, n: int = 5, most: int = 150) -> Column:
    """The first ``n`` lines for display, each of at most ``most`` characters."""
    return F.transform(F.slice(lines, 1, n), lambda x: F.substring(x, 1, most))


def anomaly_positions(placed: DataFrame, least: int = 2) -> DataFrame:
    """Relative place idx / n of each anomalous line, and whether it is the first of its window (windows of ``least`` lines or more)."""
    hit = placed.where((F.col("n") >= least) & (F.col("anomaly") == 1))
    first = F.min("idx").over(Window.partitionBy("window_id"))
    return hit.select("window_id", "n", (F.col("idx") / F.col("n")).alias("position"), (F.col("idx") == first).alias("is_first"))


def position_stats(positions: DataFrame) -> DataFrame:
    """Quartiles and mean of positions, and the shares within the first tenth and quarter; 0 without any."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = value_counts(positions, "position")
    mean = lambda c: F.try_divide(F.sum(c * F.col("k")), F.sum("k"))
    out = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), mean(F.col("v")).alias("mean"), *(mean((F.col("v") <= t).cast("int")).alias(f"within_{int(t * 100)}") for t in EARLY))
    out = out.crossJoin(quantiles(counts, (0.25, 0.5, 0.75)))  # one row beside one row
    verdict = F.lit(LAST_VERDICT)
    for most, name in reversed(VERDICTS):
        verdict = F.when(F.col("p50") < most, name).otherwise(verdict)
    cols = [zero(F.get(F.col("p"), i)).alias(f"p{q}") for i, q in enumerate((25, 50, 75))]
    return out.select("n", *cols, zero(F.col("mean")).alias("mean"), *(zero(F.col(f"within_{int(t * 100)}")).alias(f"within_{int(t * 100)}") for t in EARLY)).withColumn("verdict", verdict)


def position_histogram(positions: DataFrame) -> DataFrame:
    """(bin 0..9, n): tenths of the window, the last closed; empty bins count 0."""
    spark = positions.sparkSession
    counts = positions.groupBy(F.least(F.floor(F.col("position") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def anomaly_density(windowed_sizes: DataFrame, least: int = 2) -> DataFrame:
    """Over anomalous windows (n_lines, n_anomalous): density mean and median, lines mean, median and maximum."""
    some = windowed_sizes.where((F.col("n_anomalous") > 0) & (F.col("n_lines") >= least)).select("n_lines", (F.col("n_anomalous") / F.col("n_lines")).alias("density"))
    some = written(some, "windows")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = some.agg(F.count(F.lit(1)).alias("windows"), zero(F.avg("density")).alias("density_mean"), zero(F.avg("n_lines")).alias("lines_mean"), F.coalesce(F.max("n_lines"), F.lit(0)).alias("lines_max"))
    for name in ("density", "n_lines"):
        out = out.crossJoin(quantiles(value_counts(some, name), (0.5,)).select(zero(F.get("p", F.lit(0))).alias(f"{name.removeprefix('n_')}_median")))  # one row beside one row
    return out.select("windows", "density_mean", "density_median", "lines_mean", "lines_median", "lines_max")
