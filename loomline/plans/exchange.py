"""Queries that write an artifact and read it back, and those over parts of an example or a rule, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import numeric
from loomline.operators import grouping, masking, parsing, profile, quality, scoring, tuning
from loomline.plans import reference as base
from loomline.sources import artifacts, table, text_log
from loomline.sources.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- files written and read back


@_query("select count(*) n_lines, sum(length(rtrim(text, chr(13) || chr(10)))) n_chars, count(distinct rtrim(text, chr(13) || chr(10))) n_distinct from (select distinct line_id, text from log_lines where text is not null)")
def log_files(spark: SparkSession, d: str) -> DataFrame:
    """The log lines as text files, read with their numbers."""
    path = scratch(spark, "log")
    table(spark, d, "log_lines").select("line_id", "text").where("text is not null").dropDuplicates(["line_id"]).select("text").write.text(path)
    lines = text_log.read_lines(spark, path)
    # Numbers are whole and without gaps in each file, or the count of lines would differ.
    per = lines.groupBy("file").agg((F.max("line_no") + 1).alias("n"))
    return lines.agg(F.sum(F.length("text")).alias("n_chars"), F.count_distinct("text").alias("n_distinct")).crossJoin(per.agg(F.sum("n").alias("n_lines")))  # one row beside one row


@_query("select source_blockid block_id, case when count(distinct label) = 1 then max(label) end as label, count(*) n_rows from paragraphs where dataset = 'hdfs' and source_blockid is not null and label is not null group by 1")
def label_files(spark: SparkSession, d: str) -> DataFrame:
    """Labels of sessions as CSV with blanks around names and values, read back and checked."""
    path = scratch(spark, "labels")
    rows = table(spark, d, "paragraphs").where("dataset = 'hdfs' and source_blockid is not null and label is not null")
    named = rows.select(F.concat(F.lit(" "), "source_blockid").alias("BlockId "), F.when(F.col("label") == 0, "Normal ").otherwise("Anomaly").alias(" Label"))
    named.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return grouping.label_table(text_log.read_labels(spark, path)).select("block_id", "label", "n_rows")


@_query("""select artifact_id, cast(fold_id as int) fold_id, seed, stream, cast(row_number() over (partition by artifact_id, fold_id, stream order by pos, paragraph_id) - 1 as int) pos, paragraph_id
 from (select distinct artifact_id, fold_id, seed, stream, pos, paragraph_id from fold_splits)""")
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """Splits as one JSON file an artifact, read back."""
    path = scratch(spark, "splits")
    rows = table(spark, d, "fold_splits").select("artifact_id", "fold_id", "seed", "stream", "pos", "paragraph_id").distinct()
    artifacts.splits_json(rows, ["artifact_id"]).write.partitionBy("artifact_id").text(path)
    back = artifacts.read_splits(spark, f"{path}/*/*.txt")
    return back.select(F.regexp_extract("file", "artifact_id=([^/]+)/", 1).alias("artifact_id"), "fold_id", "seed", "stream", "pos", "paragraph_id")


_SIZED = f"{base._P}, sz as (select paragraph_id, dataset, label, ord, case when lines is null then 0 else len(regexp_extract_all(array_to_string(lines, chr(10)), '\\S+')) end words from par where label is not null)"


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"]).where("label is not null").select("paragraph_id", "dataset", "label", "ord", profile.lines_words("lines").cast("int").alias("words"))


@_query(f"with {_SIZED} select cast(ord % 2 as int) fold_id, dataset split_name, paragraph_id, label, k top_k, (words + k) % 100 / 100 accuracy, words n_masked_total from sz, (select unnest([5, 9]) k)")
def score_files(spark: SparkSession, d: str) -> DataFrame:
    """Scores as JSON in the layout of folds, read back; word counts stand in for accuracies."""
    path = scratch(spark, "scores")
    accuracies = F.array(*(F.struct(F.lit(k).alias("top_k"), ((F.col("words") + k) % 100 / 100).alias("accuracy")) for k in (5, 9)))
    one = F.struct("paragraph_id", "label", accuracies.alias("topk_accuracies"), F.col("words").alias("n_masked_total"), F.lit(1).alias("n_passes"))
    for k in range(2):
        own = _sized(spark, d).where(F.col("ord") % 2 == k).groupBy("dataset").agg(F.collect_list(one).alias("scores"))
        value = F.to_json(F.struct(F.col("dataset").alias("split_name"), F.array(F.lit(5), F.lit(9)).alias("topk_grid"), F.lit(1).alias("n_passes"), "scores"))
        own.select("dataset", value.alias("value")).repartition("dataset").write.partitionBy("dataset").text(f"{path}/parts_{k}")
    # The number of the fold is that of the folder, as fold_of reads it from fold_<k>/.
    found = artifacts.read_scores(spark, [f"{path}/parts_{k}/*/*.txt" for k in range(2)])
    fold = artifacts.fold_of(F.regexp_replace("file", r"parts_(\d+)/[^/]+/", r"fold_$1/"))
    return found.select(fold.alias("fold_id"), "split_name", "paragraph_id", "label", "top_k", "accuracy", "n_masked_total")


@_query(f"""with {_SIZED}, t(threshold) as (values (20), (50), (100)), c as (select dataset, threshold, count(*) filter (label = 1 and words < threshold) tp, count(*) filter (label = 0 and words < threshold) fp, count(*) filter (label = 0 and words >= threshold) tn, count(*) filter (label = 1 and words >= threshold) fn from sz, t group by 1, 2)
 select dataset, cast(threshold as double) threshold, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) recall from c""")
def grid_files(spark: SparkSession, d: str) -> DataFrame:
    """Tuning grids as JSON, one file a data set, read back; word counts stand in for accuracies."""
    path = scratch(spark, "grids")
    each = _sized(spark, d).withColumn("top_k", F.lit(5)).withColumn("accuracy", F.col("words").cast("double"))
    measured = tuning.grid_metrics(each, tuning.grid(spark, [5], [20.0, 50.0, 100.0]), ["dataset"])
    cell = F.struct("top_k", "threshold", *tuning.METRICS, *tuning.COUNTS)
    per = measured.groupBy("dataset").agg(F.to_json(F.struct(F.lit(5).alias("best_top_k"), F.lit(20.0).alias("best_threshold"), F.lit(0.9).alias("train_top1_acc"), F.collect_list(cell).alias("cells"))).alias("value"))
    per.repartition("dataset").write.partitionBy("dataset").text(path)
    back = artifacts.read_grids(spark, f"{path}/*/*.txt")
    return back.select(F.regexp_extract("file", "dataset=([^/]+)/", 1).alias("dataset"), "threshold", "tp", "fp", "tn", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@_query("select paragraph_id, len(lines) n_lines, md5(array_to_string(lines, chr(10))) digest from (select distinct on (paragraph_id) * from paragraphs) where lines is not null")
def paragraph_files(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs written by data set and read back."""
    path = scratch(spark, "paragraphs")
    artifacts.write_table(table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"]).where("lines is not null"), path, ["dataset"])
    return spark.read.parquet(path).select("paragraph_id", F.size("lines").cast("bigint").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


# ---- parts of examples


@_query(f"""{base.ORACLE_SQL['truncated_lines'].split(' select paragraph_id, count(*) n_lines')[0]}
 select paragraph_id, cast(line_no as int) line_no, cast(seen as int) start_, cast(least(510, seen + m) as int) end_ from bs join pa using (paragraph_id) where seen < 510""")
def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each line of a cut paragraph begins and ends among its tokens."""
    flat = masking.flattened(table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"]).where("lines is not null"), profile.SHORT_LIMIT - masking.RESERVED)
    return flat.select("paragraph_id", F.posexplode("spans").alias("line_no", "s")).select("paragraph_id", "line_no", F.col("s.start").alias("start_"), F.col("s.end").alias("end_"))


_PASSES = f"""{base._P}, ml as (select paragraph_id, generate_subscripts(lines, 1) - 1 line_no, unnest(lines) text from par where lines is not null),
 mt as (select *, regexp_extract_all(text, '\\S+') t from ml),
 mc as (select *, row_number() over (partition by pass, paragraph_id order by md5(concat_ws(':', 42, pass, paragraph_id, line_no)), line_no) r, count(*) over (partition by pass, paragraph_id) n from mt, (values (0), (1), (2)) x(pass)),
 mk as (select * from mc where r <= least(n, greatest(1, cast(round_even(n * 0.5, 0) as int)))),
 mp as (select pass, paragraph_id, line_no, t, generate_subscripts(t, 1) - 1 pos, unnest(t) token, len(t) m from mk),
 mr as (select *, row_number() over (partition by pass, paragraph_id, line_no order by md5(concat_ws(':', 42, pass, paragraph_id, line_no, pos)), pos) r from mp),
 ms as (select pass, paragraph_id, line_no, pos, token, t from mr where r <= least(m, greatest(1, cast(round_even(m * 0.8, 0) as int))))"""


@_query(f"""with {_PASSES}, h as (select paragraph_id, count(*) n, count(*) filter (length(token) <= 5) k5, count(*) filter (length(token) <= 9) k9 from ms group by 1)
 select paragraph_id, label, k top_k, round(coalesce(case k when 5 then k5 else k9 end / n, 1.0), 9) accuracy, coalesce(n, 0) n_masked_total from par left join h using (paragraph_id), (select unnest([5, 9]) k)""")
def pooled_passes(spark: SparkSession, d: str) -> DataFrame:
    """Accuracies over three passes; a token's length stands in for its rank."""
    paragraphs = table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"])
    ranked = masking.masked_positions(paragraphs, n_passes=3).withColumn("hit_rank", F.length("token"))
    return scoring.pooled_accuracy(paragraphs, ranked, (5, 9), 3).select("paragraph_id", "label", "top_k", F.round("accuracy", 9).alias("accuracy"), "n_masked_total")


_IDS = "list_transform(t, lambda x: length(x) + 10)"
_EXAMPLE = f"""{_PASSES}, ex as (select paragraph_id, line_no, any_value(t) t, list(pos order by pos) places from ms where pass = 0 group by 1, 2),
 ids as (select paragraph_id, line_no, places, {_IDS} v from ex),
 pe as (select paragraph_id, line_no, list_concat([0], list_transform(v, lambda x, i: case when list_contains(places, i - 1) then 3 else x end), [2]) inputs, list_concat([-100], list_transform(v, lambda x, i: case when list_contains(places, i - 1) then x else -100 end), [-100]) labels from ids)"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Each masked line as an example; a token's length and ten stand in for its id."""
    paragraphs = table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"])
    at = masking.masked_positions(paragraphs).groupBy("paragraph_id", "line_no").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    lines = masking.boundaries(paragraphs.where("lines is not null"), None).join(at, ["paragraph_id", "line_no"])
    ids = F.transform("tokens", lambda x: F.length(x) + 10)
    names = ("input_ids", "labels", "attention_mask")
    return lines.select("paragraph_id", "line_no", ids.alias("ids"), "at").select("paragraph_id", "line_no", *(c.alias(n) for c, n in zip(masking.masked_example(F.col("ids"), F.col("at")), names)))


@_query(f"with {_EXAMPLE} select paragraph_id, cast(line_no as int) line_no, array_to_string(inputs, ' ') inputs, array_to_string(labels, ' ') labels, len(inputs) attended from pe")
def masked_examples(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return _examples(spark, d).select("paragraph_id", "line_no", joined("input_ids").alias("inputs"), joined("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("attended"))


@_query(f"""with {_EXAMPLE}, lo as (select paragraph_id, max(len(inputs)) m from pe group by 1)
 select paragraph_id, cast(line_no as int) line_no, m as size, m - len(inputs) n_pad, m - len(inputs) + len(list_filter(labels, lambda x: x = -100)) n_ignored from pe join lo using (paragraph_id)""")
def padded_examples(spark: SparkSession, d: str) -> DataFrame:
    """A paragraph's examples padded to the longest of them."""
    out = masking.padded(_examples(spark, d), "paragraph_id")
    n = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("bigint")
    return out.select("paragraph_id", "line_no", F.size("input_ids").cast("bigint").alias("size"), n("attention_mask", 0).alias("n_pad"), n("labels", masking.IGNORED).alias("n_ignored"))


@_query(f"with {_SIZED} select paragraph_id, (words + 9) % 100 / 100 accuracy from sz")
def accuracy_of_k(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy of one k looked up among those of a paragraph."""
    records = F.array(*(F.struct(F.lit(k).alias("top_k"), ((F.col("words") + k) % 100 / 100).alias("accuracy")) for k in (5, 9, 12)))
    return _sized(spark, d).select("paragraph_id", tuning.accuracy_at(records, 9).alias("accuracy"))


# ---- rules, grids and weights


@_query(rf"""with {base._P}, {base._SES}, e as (select len(list_distinct(regexp_extract_all(text, '\bblk_-?\d+\b'))) n from ses), c as (select count(*) filter (n > 1) / count(*) v from e)
 select 'multi_entity' as rule, round(v, 9) as value, cast(0.05 as double) as threshold, 'flag' severity, v > 0.05 fired from c""")
def entity_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(grouping.entity_counters(base._session_lines(spark, d)), quality.ENTITY_RULES).withColumn("value", F.round("value", 9))


@_query(f"with {base._WIN}, c as (select cast(count(*) filter (n_lines < 2 and label = 1) as double) v from siz) select 'anomalous_singletons' as rule, v as value, cast(0 as double) as threshold, 'flag' severity, v > 0 fired from c")
def window_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(grouping.dropped_windows(base._windowed(spark, d)), quality.WINDOW_RULES)


@_query(f"with {base._PARSED} select line_no, ts, case when w[1] <> '-' then 1 else 0 end anomaly from parsed where failure is null")
def line_times(spark: SparkSession, d: str) -> DataFrame:
    """Time and label of each readable line, without its content."""
    lines = base._lines(spark, d)
    return lines.select("line_no", parsing.time_field("text").alias("ts"), parsing.anomaly_field("text").alias("anomaly")).where("ts is not null")


@_query("select doc_id + 1 line_number from (select distinct doc_id, text from documents) where contains(text, chr(65533)) order by 1 limit 100")
def damaged_texts(spark: SparkSession, d: str) -> DataFrame:
    """The audit of replaced characters over texts, where log lines have none."""
    return parsing.replaced_lines(table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]), line_no="doc_id")


_TOP1 = (0.0, 0.5, 0.86, 0.97, 1.0)


@_query(" union all ".join(f"select cast({t} as double) top1, cast(i as int) nth, round(case when {min(0.995, t + 0.05)!r} <= {max(0.0, t - 0.05)!r} then {min(0.995, t + 0.05)!r} else {max(0.0, t - 0.05)!r} + i * ({min(0.995, t + 0.05)!r} - {max(0.0, t - 0.05)!r}) / 4 end, 9) threshold from range(5) r(i)" for t in _TOP1))
def wide_grid(spark: SparkSession, d: str) -> DataFrame:
    """The wide grid around several training accuracies."""
    rows = [(t, i, round(x, 9)) for t in _TOP1 for i, x in enumerate(numeric.wide_threshold_grid(t))]
    return spark.createDataFrame(rows, "top1 double, nth int, threshold double")


@_query("""with e as (select vec_id, generate_subscripts(embedding, 1) - 1 idx, cast(unnest(embedding) as double) v from embeddings), p as (select a.vec_id, max(abs(a.v - coalesce(b.v, 0))) d from e a left join e b on b.vec_id = a.vec_id and b.idx = a.idx + 1 group by 1)
 select vec_id as name, round(d, 6) divergence from p""")
def weight_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Largest difference of each embedding and itself moved by one place, as two sets of weights."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("v"))
    weights = lambda v: vectors.select("name", F.posexplode(v).alias("idx", "value"))
    moved = F.transform("v", lambda _, i: F.coalesce(F.get("v", i + 1), F.lit(0.0)))
    return tuning.divergence(weights(F.col("v")), weights(moved)).withColumn("divergence", F.round("divergence", 6))


@_query("select sha256(string_agg(h, '' order by name)) sha256 from (select name, sha256(name || cast(n as varchar)) h from (select event_type as name, count(*) n from events group by 1))")
def weight_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of named arrays: counts of events as the bytes of their type."""
    parts = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.encode(F.count(F.lit(1)).cast("string"), "utf-8").alias("bytes"))
    return tuning.digest(parts)


@_query("""with e as (select user_id run, event_id seq, case when event_type = 'click' then value / 100 end acc from events), l as (select run, coalesce(arg_max(acc, seq) filter (acc is not null), 0) a from e group by 1)
 select run, round(a, 6) train_top1_acc, a < 0.5 training_failed from l""")
def training_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last accuracy of a run is too low; clicks stand in for the rows of a log that have one."""
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("value") / 100).alias("train_top1_acc"))
    return tuning.training_gate(log, ["run"]).withColumn("train_top1_acc", F.round("train_top1_acc", 6))


@_query("select artifact_id, fold_id, pos, paragraph_id from (select distinct artifact_id, fold_id, pos, paragraph_id from fold_splits where stream = 'train_normal_ids') where pos < 500")
def rate_subset(spark: SparkSession, d: str) -> DataFrame:
    """What a search of learning rates trains on: the first 500 of each fold's training order."""
    rows = table(spark, d, "fold_splits").where("stream = 'train_normal_ids'").select("artifact_id", "fold_id", "pos", "paragraph_id").distinct()
    return tuning.rate_subset(rows)
