"""Operating points: a grid of (k, threshold), its metrics and the best cell; folds and their spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.numeric import ratio

METRICS = ("precision", "recall", "f1", "specificity")
COUNTS = ("tp", "fp", "tn", "fn")
#: Values of k that scores may have.
MAX_TOP_K = 1000
#: A model whose last training accuracy is below this is not used.
LEAST_TOP1 = 0.5


def grid(spark, top_k: list[int], thresholds: list[float]) -> DataFrame:
    """All cells (top_k, threshold); a few dozen rows."""
    return spark.createDataFrame([(k, float(t)) for k in top_k for t in thresholds], "top_k int, threshold double")


def predicted(accuracy: Column | str, threshold: Column | str) -> Column:
    """1 (anomaly) strictly below the threshold."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return (col(accuracy) < col(threshold)).cast("int")


def _counts(only: Column | None = None) -> dict[str, Column]:
    """tp, fp, tn, fn of label and prediction, over the rows where ``only`` holds."""
    n = lambda a, b: F.count_if((F.col("label") == a) & (F.col("prediction") == b) & (F.lit(True) if only is None else only))
    return dict(zip(COUNTS, (n(1, 1), n(0, 1), n(0, 0), n(1, 0))))


def _rates(prefix: str = "") -> dict[str, Column]:
    """Precision, recall, F1 and specificity of counts named with ``prefix``, 0 where a denominator is."""
    tp, fp, tn, fn = (F.col(prefix + c) for c in COUNTS)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return dict(zip(METRICS, (p, r, ratio(2 * p * r, p + r), ratio(tn, tn + fp))))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, tn, fn and what follows from them. Needs label and prediction."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in _counts().items())).withColumns(_rates())


def scored_k(scores: DataFrame) -> list[int]:
    """The values of k in ``scores``, in order; more than MAX_TOP_K raise."""
    found = sorted(r[0] for r in scores.where("top_k is not null").select("top_k").distinct().limit(MAX_TOP_K + 1).collect())
    if len(found) > MAX_TOP_K:
        raise ValueError(f"more than {MAX_TOP_K} values of k")
    return found


def accuracy_at(records: Column | str, k: Column | int) -> Column:
    """The accuracy of one k in an array of (top_k, accuracy); raises, naming those there are, if it lacks."""
    hit = F.filter(records, lambda r: r["top_k"] == k)
    there = F.array_join(F.transform(records, lambda r: r["top_k"].cast("string")), ", ")
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(hit) > 0, F.get(hit, 0)["accuracy"]).otherwise(F.raise_error(F.concat(F.lit("no accuracy for k = "), k.cast("string"), F.lit("; there is "), there)).cast("double"))


def _each_cell(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """Scores at every cell of their k, with the prediction; those of a k outside the grid once, without threshold."""
    return scores.join(F.broadcast(cells), "top_k", "left").withColumn("prediction", predicted("accuracy", "threshold"))


def _grid_k(cells: DataFrame) -> Column:
    """The values of k of a grid (a few dozen rows)."""
    return F.array(*(F.lit(k).cast("int") for k in sorted({r[0] for r in cells.select("top_k").collect()})))


def _scored(k: Column, wanted: Column, there: Column) -> Column:
    """``k``, if all of ``wanted`` are ``there``; else raises, naming both."""
    lost = F.array_except(wanted, there)
    text = lambda x: F.array_join(F.array_sort(x).cast("array<string>"), ", ")
    return F.when(F.size(lost) == 0, k).otherwise(F.raise_error(F.concat(F.lit("no accuracy for k = "), text(lost), F.lit("; there is "), text(there))).cast("int"))


def grid_metrics(scores: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of every cell. ``scores``: keys, paragraph_id, label, top_k, accuracy; ``cells`` is a grid of fixed size.

    A k of the grid that some key was not scored with raises; without any scores the result is empty.
    """
    measured = metrics(_each_cell(scores, cells), [*keys, "top_k", "threshold"])
    # The cells of one key, which are few.
    there = F.collect_set(F.when(F.col("threshold").isNotNull(), F.col("top_k").cast("int"))).over(Window.partitionBy(*keys))
    checked = measured.withColumn("_there", there).where("threshold is not null or size(_there) = 0")
    return checked.withColumn("top_k", _scored(F.col("top_k"), _grid_k(cells), F.col("_there"))).drop("_there")


def tuned_metrics(scores: DataFrame, cells: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Test metrics of each fold at the cell its tuning scores choose, as :func:`grid_metrics`, :func:`best_cell` and :func:`fold_metrics` give.

    ``scores``: keys, split (tune, test), label, top_k, accuracy. Both splits are counted at every cell in one pass, so
    scores are computed once. F1 is compared to ``digits`` places. A fold without scores of either split gives no row;
    a k of the grid that a fold was not scored with raises.
    """
    tune, test = F.col("split") == "tune", F.col("split") == "test"
    both = {f"{s}_{n}": c for s, on in (("tune", tune), ("test", test)) for n, c in _counts(on).items()}
    # Of a k outside the grid there is no prediction and so no count.
    cell = _each_cell(scores.where(tune | test), cells).groupBy(*keys, "top_k", "threshold").agg(*(c.alias(n) for n, c in both.items()))
    total = lambda s: sum((F.col(f"{s}_{c}") for c in COUNTS[1:]), F.col(f"{s}_{COUNTS[0]}"))
    rated = cell.withColumn("f1", F.round(_rates("tune_")["f1"], digits))
    at = F.struct(F.col("f1"), (-F.col("top_k")).alias("k"), F.col("threshold"), *(F.col(f"test_{c}") for c in COUNTS))
    there = F.collect_set(F.when(F.col("threshold").isNotNull(), F.col("top_k").cast("int")))
    best = rated.groupBy(*keys).agg(F.max(F.when(total("tune") > 0, at)).alias("b"), there.alias("_there"))
    wanted = _grid_k(cells)
    k = _scored((-F.col("b.k")).cast("int"), wanted, F.col("_there"))
    out = best.select(*keys, k.alias("top_k"), F.col("b.threshold").alias("best_threshold"), *(F.col(f"b.test_{c}").alias(f"test_{c}") for c in COUNTS), F.size(F.array_except(wanted, "_there")).alias("_lost"))
    return out.where((F.col("_lost") > 0) | (total("test") > 0)).select(*keys, "top_k", "best_threshold", *(F.col(f"test_{c}").alias(c) for c in COUNTS)).withColumns(_rates())


def best_cell(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best_top_k, best_threshold, best_f1: highest F1, then the smaller k, then the larger threshold."""
    best = F.max(F.struct(F.col("f1"), (-F.col("top_k")).alias("k"), F.col("threshold")))
    return measured.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.k")).alias("best_top_k"), F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"))


def fold_metrics(scores: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of each fold's test scores at its own operating point."""
    at = scores.join(best.withColumnRenamed("best_top_k", "top_k"), [*keys, "top_k"])
    return metrics(at.withColumn("prediction", predicted("accuracy", "best_threshold")), [*keys, "top_k", "best_threshold"])


def across_folds(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for a single fold) of each metric."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"std_{m}")]
    return measured.groupBy(*keys).agg(*aggs)


def fold_lists(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, per_fold (metric -> values in order of fold) and points (fold_id, top_k, threshold)."""
    rows = F.sort_array(F.collect_list(F.struct("fold_id", "top_k", "best_threshold", *METRICS)))
    out = measured.groupBy(*keys).agg(rows.alias("r"))
    values = F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*(F.col(f"r.{m}") for m in METRICS)))
    return out.select(*keys, values.alias("per_fold"), F.transform("r", lambda x: F.struct(x["fold_id"].alias("fold_id"), x["top_k"].alias("top_k"), x["best_threshold"].alias("threshold"))).alias("points"))


def missing_folds(found: DataFrame, n_folds: int) -> DataFrame:
    """Numbers below ``n_folds`` that no row of ``found`` (fold_id) has."""
    return found.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold_id")).join(found.select("fold_id"), "fold_id", "left_anti")


def epoch_losses(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last loss of each rounded epoch. ``log``: keys, seq, epoch, loss (null where a row has none)."""
    return log.where("loss is not null and epoch is not null").groupBy(*keys, F.bround("epoch").cast("int").alias("epoch")).agg(F.max_by("loss", "seq").alias("loss"))


def last_accuracy(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last training accuracy, 0 where no row has any."""
    value = F.max_by("train_top1_acc", F.when(F.col("train_top1_acc").isNotNull(), F.col("seq")))
    return log.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("train_top1_acc"))


def training_gate(log: DataFrame, keys: list[str], least: float = LEAST_TOP1) -> DataFrame:
    """keys, train_top1_acc (the last, 0 without any) and training_failed: whether it is below ``least``.

    The report is a table of its own, so it can be stored before anything raises on it.
    """
    return last_accuracy(log, keys).withColumn("training_failed", F.col("train_top1_acc") < least)


def rate_subset(train: DataFrame, pos: str = "pos", most: int = 500) -> DataFrame:
    """The rows a search of learning rates trains on: the first ``most`` of the training order."""
    return train.where(F.col(pos) < most)


def best_rate(trials: DataFrame, keys: list[str]) -> DataFrame:
    """The learning rate of least loss, the smaller of ties."""
    return trials.groupBy(*keys).agg(F.min(F.struct("loss", "lr")).alias("b")).select(*keys, F.col("b.lr").alias("lr"), F.col("b.loss").alias("loss"))


def divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, divergence): largest difference of two sets of named weights (name, idx, value); a name or place of one side alone raises."""
    a, b = left.select("name", "idx", F.col("value").alias("a")), right.select("name", "idx", F.col("value").alias("b"))
    both = a.join(b, ["name", "idx"], "full")
    gap = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("weights differ in names or shape"))).otherwise(F.abs(F.col("a") - F.col("b")))
    return both.groupBy("name").agg(F.max(gap.cast("double")).alias("divergence"))


def digest(parts: DataFrame) -> DataFrame:
    """SHA-256 over (name, bytes), in order of name; ``parts`` are the few named arrays of a model."""
    each = F.sort_array(F.collect_list(F.struct("name", F.sha2(F.concat(F.encode("name", "utf-8"), F.col("bytes")), 256).alias("h"))))
    return parts.agg(F.sha2(F.array_join(F.transform(each, lambda x: x["h"]), ""), 256).alias("sha256"))
