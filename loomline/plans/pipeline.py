"""The stages from raw logs to results, each reading and writing a folder.

Tables go to parquet, reports of a few rows to JSON. Rules are checked before anything is written.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomline.operators import grouping, parsing, profile, quality, sampling, scoring, substitution, tuning
from loomline.sources import artifacts, text_log


def _plain(row: Row | None) -> dict:
    return {} if row is None else row.asDict(recursive=True)


def _summary(paragraphs: DataFrame, counters: dict, replaced: DataFrame) -> dict:
    one = paragraphs.withColumn("all", F.lit(1))
    labels = _plain(profile.label_counts(one, ["all"]).drop("all").first()) or {"total": 0, "normal": 0, "anomaly": 0, "anomaly_rate": 0.0}
    lengths = profile.length_distribution(paragraphs.select(profile.lines_words("lines").alias("n_words")), "n_words")
    return labels | {"drop_counters": counters, "encoding_lines": [r[0] for r in replaced.collect()], "word_length_distribution": _plain(lengths.first())}


def prepare_sessions(spark: SparkSession, log: str, label_file: str, out: str, warn_only: bool = False) -> dict:
    """Paragraphs per entity of a log, and the summary; an entity without label or with two raises."""
    lines = text_log.read_lines(spark, log)
    labels = grouping.label_table(text_log.read_labels(spark, label_file))
    mentioned = grouping.mentions(lines)
    faults = labels.agg(F.count_if(F.col("n_labels") > 1).alias("conflicts"), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("repeats"))
    faults = faults.crossJoin(grouping.missing_labels(mentioned, labels).agg(F.count(F.lit(1)).alias("missing")))  # one row beside one row
    counters = grouping.entity_counters(lines).crossJoin(lines.agg(F.count_if(parsing.has_replacement("text")).alias("encoding_replacements_seen"))).withColumns({"unparseable_timestamp": F.lit(0), "lines_missing_content": F.lit(0)})
    flags = quality.enforce(quality.report(faults, quality.LABEL_RULES), warn_only)
    flags += quality.enforce(quality.report(counters, quality.ENTITY_RULES + quality.LINE_RULES), warn_only)
    path = f"{out}/paragraphs"
    made = grouping.session_paragraphs(lines, labels).withColumnsRenamed({"first_line": "ord", "first_pos": "ord_in_line"})
    artifacts.write_table(made, path, mode="overwrite")
    summary = _summary(spark.read.parquet(path), _plain(counters.first()), parsing.replaced_lines(lines)) | {"flags": flags}
    artifacts.save_json(summary, Path(out) / "preparation_summary.json")
    return summary


def prepare_windows(spark: SparkSession, log: str, dataset: str, seconds: int, out: str, max_lines: int | None = None, warn_only: bool = False) -> dict:
    """Paragraphs per time window of a log, and the summary; too many unreadable lines raise."""
    warnings = grouping.check_window(seconds, dataset)
    lines = parsing.first_lines(text_log.read_lines(spark, log), max_lines)
    parsed = parsing.parse_labelled(lines)
    counters = parsing.drop_counters(parsed)
    flags = warnings + quality.enforce(quality.report(counters, quality.LINE_RULES), warn_only)
    dropped = grouping.dropped_windows(grouping.with_window(parsed, seconds))
    flags += quality.enforce(quality.report(dropped, quality.WINDOW_RULES), warn_only)
    path = f"{out}/paragraphs"
    made = grouping.window_paragraphs(parsed, seconds, dataset).withColumn("ord", F.col("source_window_id"))
    artifacts.write_table(made, path, mode="overwrite")
    summary = _summary(spark.read.parquet(path), _plain(counters.first()) | _plain(dropped.first()), parsing.replaced_lines(lines)) | {"flags": flags}
    artifacts.save_json(summary, Path(out) / "preparation_summary.json")
    return summary


def gate(spark: SparkSession, prepared: str, backbone: str, warn_only: bool = False) -> dict:
    """Token lengths against a backbone's limit, added to the preparation summary."""
    paragraphs = spark.read.parquet(f"{prepared}/paragraphs").withColumn("all", F.lit(1))
    limits = spark.createDataFrame([(backbone,)], "backbone string").withColumn("max_tokens", profile.backbone_limit("backbone"))
    measured = profile.length_gate(paragraphs, limits, ["all"])
    flags = quality.enforce(quality.report(measured, quality.LENGTH_RULES), warn_only)
    found = _plain(measured.drop("all").first())
    out = {"tokenizer": backbone, "truncation_rate_at_backbone_limit": found.get("truncation_rate", 0.0), "distribution": {k: found.get(k, 0) for k in ("min", "max", "p50", "p80", "p95", "p99")}, "flags": flags}
    artifacts.upsert_json(Path(prepared) / "preparation_summary.json", "token_length_distribution", out, Path(prepared) / "token_length.json")
    return out


def choose(spark: SparkSession, prepared: str, tokens: bool = False) -> dict:
    """The backbone by the 80th percentile of word (or token) lengths, as a decision file."""
    lengths = artifacts.length_summary(Path(prepared) / "preparation_summary.json", tokens)
    kind = "token_length" if tokens else "word_length"
    row = spark.createDataFrame([(float(lengths["p80"]),)], "p80 double").select(profile.choose_backbone("p80").alias("chosen_backbone"), profile.rationale("p80", kind).alias("rationale")).first()
    out = _plain(row) | {"distribution_kind": kind, "distribution": lengths, "quantile_threshold": profile.QUANTILE_WORDS}
    artifacts.save_json(out, Path(prepared) / "backbone_decision.json")
    return out


def subsample(spark: SparkSession, prepared: str, out: str, max_normal: int = 25_000, max_anomaly: int = 2_000, seed: int = 42) -> dict:
    """At most so many paragraphs of each label, and how many there were."""
    paragraphs = spark.read.parquet(f"{prepared}/paragraphs").withColumn("all", F.lit(1))
    caps = spark.createDataFrame([(1, seed, max_normal, max_anomaly)], "all int, seed bigint, max_normal bigint, max_anomaly bigint")
    artifacts.write_table(sampling.capped(paragraphs, caps, ["all"]).drop("all"), f"{out}/paragraphs", mode="overwrite")
    summary = _plain(sampling.cap_summary(paragraphs, caps, ["all"]).drop("all").first()) | {"seed": seed, "max_normal": max_normal, "max_anomaly": max_anomaly}
    artifacts.save_json(summary, Path(out) / "subsample_summary.json")
    return summary


def make_splits(spark: SparkSession, prepared: str, out: str, n_folds: int = 5, budgets: tuple[int, int, int, int] = (5000, 1000, 1000, 1000), seed: int = 42) -> DataFrame:
    """Folds in long form, written and returned."""
    paragraphs = spark.read.parquet(f"{prepared}/paragraphs").withColumn("all", F.lit(1))
    names = ", ".join(f"{b} bigint" for b in sampling.BUDGETS)
    plan = spark.createDataFrame([(1, seed, n_folds, *budgets)], f"all int, seed bigint, n_folds bigint, {names}")
    artifacts.write_table(sampling.create_splits(paragraphs, plan, ["all"]).drop("all"), f"{out}/splits", mode="overwrite")
    return spark.read.parquet(f"{out}/splits")


def fold(splits: DataFrame, fold_id: int) -> DataFrame:
    """One fold's rows; raises for a fold that is not there."""
    own = splits.where(F.col("fold_id") == fold_id)
    if own.isEmpty():
        raise ValueError(f"no fold {fold_id}")
    return own


def score(spark: SparkSession, prepared: str, splits: DataFrame, fold_id: int, scorer: scoring.Scorer, out: str, n_passes: int = 1, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Top-k accuracies of a fold's tuning and test paragraphs, by split. Missing or repeated ids raise."""
    from loomline.operators.masking import masked_positions

    paragraphs, own = spark.read.parquet(f"{prepared}/paragraphs"), fold(splits, fold_id)
    every = None
    for name in ("tune", "test"):
        ids = scoring.split_ids(own, name, [])
        faults = scoring.id_faults(ids, paragraphs, []).where("n_missing > 0 or n_repeated > 0").first()
        if faults:
            raise ValueError(f"fold {fold_id}, {name}: {faults.n_missing} ids without paragraph (first: {', '.join(faults.missing)}), {faults.n_repeated} repeated (first: {', '.join(faults.repeated)})")
        chosen = scoring.evaluation_set(ids, paragraphs)
        masked = masked_positions(chosen, n_passes, seed, limit)
        pooled = scoring.pooled_accuracy(chosen, scorer.rank(masked, max(scoring.TOP_K)), n_passes=n_passes).withColumns({"split": F.lit(name), "fold_id": F.lit(fold_id)})
        every = pooled if every is None else every.unionByName(pooled)
    artifacts.write_table(every, f"{out}/scores_fold_{fold_id}", ["split"], mode="overwrite")
    return spark.read.parquet(f"{out}/scores_fold_{fold_id}")


def evaluate(scores: DataFrame, thresholds: list[float], n_folds: int, keys: list[str] | None = None, top_k: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per fold metrics at its own operating point, and their spread. ``scores``: keys, fold_id, split, ...

    A fold without scores raises, and so does a k of ``top_k`` (those scored, if None) that was not scored.
    """
    keys = keys or []
    lost = [r[0] for r in tuning.missing_folds(scores.select("fold_id").distinct(), n_folds).collect()]
    if lost:
        raise ValueError(f"no scores of folds {lost}")
    known = tuning.scored_k(scores)
    cells = tuning.grid(scores.sparkSession, known if top_k is None else top_k, thresholds)
    measured = tuning.tuned_metrics(scores, cells, [*keys, "fold_id"])
    return measured, tuning.across_folds(measured, keys)


def vary(train: DataFrame, paragraphs: DataFrame, lexicon: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """``paragraphs`` with the ``k`` commonest verbs of ``train`` replaced by the lexicon, and the report."""
    verbs = [r.verb for r in substitution.top_verbs(train, lexicon, k).collect()]
    kinds = {r.verb.lower(): r for r in substitution.classify(lexicon).where(F.lower("verb").isin(verbs)).collect()}
    rules = [(v, kinds[v].lemma) for v in verbs if kinds[v].kind == "accepted"]
    out = substitution.substitute(paragraphs, rules)
    counts = _plain(substitution.substitution_counts(out).first())
    skipped = {kind: [v for v in verbs if kinds[v].kind == kind] for kind in ("no_lemma", "multi_word", "identity")}
    return out, {"top_verbs": verbs, "rules": dict(rules), **skipped} | counts
