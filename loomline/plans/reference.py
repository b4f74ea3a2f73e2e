"""Queries over the project tables for each operator of the pipeline, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import numeric
from loomline.operators import grouping, masking, parsing, profile, quality, ranking, sampling, scoring, segments, substitution, tuning
from loomline.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOW_SECONDS = 60
TOP1 = 0.86
#: Verbs with a lemma, in the order of their use: (verb, lemma or None).
LEXICON = (
    ("answered", "replied"), ("waiting", "wait"), ("cleaned", "clean"), ("recorded", "record"), ("elected", "elect"), ("opened", "open"), ("released", "let_go"),
    ("parked", "parked"), ("skipped", None), ("swapped", "swap"), ("moved", "shift"), ("sent", "dispatched"),
)


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines in order of line_id, each once."""
    return table(spark, d, "log_lines").select("line_id", "text").dropDuplicates(["line_id"]).select((F.col("line_id") - 1).alias("line_no"), "text")


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, each once."""
    return table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"])


def _session_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of session paragraphs as one log: line_no by paragraph and place."""
    p = _paragraphs(spark, d).where("dataset = 'hdfs' and lines is not null")
    # An array has fewer than 2^31 elements.
    return p.select("ord", F.posexplode("lines").alias("at", "text")).select((F.col("ord") * 2**31 + F.col("at")).alias("line_no"), "text")


def _session_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paragraphs").where("dataset = 'hdfs' and source_blockid is not null")
    return grouping.label_table(p.select(F.col("source_blockid").alias("BlockId"), F.when(F.col("label") == 0, "Normal").when(F.col("label") == 1, "Anomaly").alias("Label")))


# Fixed SQL parts.
_L = "lines_ as (select distinct line_id - 1 as line_no, text from log_lines)"
_W = r"regexp_extract_all(text, '[^\s]+')"
_PARSED = rf"""{_L}, tok as (select *, {_W} w from lines_),
 parsed as (select *, case when len(w) >= 3 then try_cast(case when regexp_matches(w[2], '^[+-]?\d+$') then w[2] end as bigint) end ts,
   case when len(w) = 2 then 'missing_content' when len(w) < 3 or try_cast(case when regexp_matches(w[2], '^[+-]?\d+$') then w[2] end as bigint) is null then 'unparseable_timestamp' end failure from tok)"""
_WIN = f"""{_PARSED}, good as (select *, case when w[1] <> '-' then 1 else 0 end anomaly from parsed where failure is null),
 anchor as (select arg_min(ts, line_no) a from good),
 win as (select *, cast((ts - a - (((ts - a) % {WINDOW_SECONDS}) + {WINDOW_SECONDS}) % {WINDOW_SECONDS}) / {WINDOW_SECONDS} as bigint) window_id from good, anchor),
 siz as (select window_id, count(*) n_lines, max(anomaly) label, sum(anomaly) n_anomalous, cast(min(ts) as double) start_timestamp from win group by 1)"""
_P = "par as (select distinct on (paragraph_id) * from paragraphs)"
_PW = "pw as (select *, case when lines is null then 0 else len(regexp_extract_all(array_to_string(lines, chr(10)), '\\S+')) end words, case when coalesce(len(list_filter(lines, lambda x: x is not null)), 0) < 1 then 2 else 1 + len(regexp_extract_all(array_to_string(lines, chr(10)), '\\S+')) + len(list_filter(lines, lambda x: x is not null)) end tokens from par)"
_SES = "ses as (select ord * 2147483648 + nth - 1 line_no, text from (select ord, unnest(lines) text, generate_subscripts(lines, 1) nth from (select * from par where dataset = 'hdfs' and lines is not null)))"
_MEN = rf"men as (select line_no, text, block_id, min(pos) - 1 pos from (select line_no, text, unnest(regexp_extract_all(text, '\bblk_-?\d+\b')) block_id, generate_subscripts(regexp_extract_all(text, '\bblk_-?\d+\b'), 1) pos from ses) group by 1, 2, 3)"


# ---- parsing and drop counters


@_query(f"with {_PARSED} select line_no, w[1] label_field, ts, regexp_replace(text, '^\\s*\\S+\\s+', '') as content, case when w[1] <> '-' then 1 else 0 end anomaly from parsed where failure is null")
def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_labelled(_lines(spark, d)).where("failure is null").select("line_no", "label_field", "ts", "content", "anomaly")


@_query(f"with {_PARSED} select count(*) total_lines_read, count(*) filter (contains(text, chr(65533))) encoding_replacements_seen, count(*) filter (failure = 'unparseable_timestamp') unparseable_timestamp, count(*) filter (failure = 'missing_content') lines_missing_content, count(*) filter (failure is null and w[1] <> '-') anomalous_lines from parsed")
def drop_counters(spark: SparkSession, d: str) -> DataFrame:
    return parsing.drop_counters(parsing.parse_labelled(_lines(spark, d)))


@_query(f"with {_L} select line_no + 1 line_number from lines_ where contains(text, chr(65533)) order by 1 limit 100")
def replaced_lines(spark: SparkSession, d: str) -> DataFrame:
    return parsing.replaced_lines(_lines(spark, d))


@_query("select count(*) n from (select distinct line_id from log_lines) where line_id - 1 < 100000")
def line_cap(spark: SparkSession, d: str) -> DataFrame:
    return parsing.first_lines(_lines(spark, d), 100_000).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""with {_PARSED}, c as (select count(*) n, count(*) filter (failure is not null) bad, count(*) filter (contains(text, chr(65533))) enc from parsed)
 select 'bad_lines' as rule, round(bad / n, 9) as value, cast(0.001 as double) as threshold, 'hard_fail' severity, bad / n > 0.001 fired from c union all select 'encoding', round(enc / n, 9), cast(0.0001 as double), 'flag', enc / n > 0.0001 from c""")
def line_rules(spark: SparkSession, d: str) -> DataFrame:
    out = quality.report(parsing.drop_counters(parsing.parse_labelled(_lines(spark, d))), quality.LINE_RULES)
    return out.withColumn("value", F.round("value", 9))


# ---- sessions


@_query(f"with {_P}, {_SES}, {_MEN} select line_no, pos, block_id from men")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    out = grouping.mentions(_session_lines(spark, d)).select("line_no", "pos", "block_id")
    # Places among distinct entities; the first mention of each is what counts for order.
    return out


@_query(rf"with {_P}, {_SES}, e as (select len(list_distinct(regexp_extract_all(text, '\bblk_-?\d+\b'))) n from ses) select count(*) total_lines_read, count(*) filter (n < 1) no_blockid, count(*) filter (n > 1) lines_with_multiple_blockids from e")
def entity_counters(spark: SparkSession, d: str) -> DataFrame:
    return grouping.entity_counters(_session_lines(spark, d))


@_query("select source_blockid block_id, case when count(distinct label) = 1 then max(label) end as label, count(*) n_rows, count(distinct label) n_labels from paragraphs where dataset = 'hdfs' and source_blockid is not null group by 1")
def session_labels(spark: SparkSession, d: str) -> DataFrame:
    return _session_labels(spark, d)


@_query(f"""with {_P}, {_SES}, {_MEN}, lab as (select source_blockid block_id, max(label) as label from paragraphs where dataset = 'hdfs' and label is not null group by 1)
 select block_id, min(line_no) + 1 line_number from men where block_id not in (select block_id from lab) group by 1""")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return grouping.missing_labels(grouping.mentions(_session_lines(spark, d)), _session_labels(spark, d))


@_query(f"""with {_P}, {_SES}, {_MEN}, lab as (select source_blockid block_id, max(label) as label from paragraphs where dataset = 'hdfs' and label is not null group by 1),
 f as (select block_id, min((line_no, pos)) fst, string_agg(text, chr(10) order by line_no) body, count(*) n from men group by 1)
 select block_id paragraph_id, md5(body) digest, n n_lines, label, fst[1] first_line, fst[2] first_pos from f join lab using (block_id)""")
def session_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    out = grouping.session_paragraphs(_session_lines(spark, d), _session_labels(spark, d))
    return out.select("paragraph_id", F.md5(F.array_join("lines", "\n")).alias("digest"), F.size("lines").cast("bigint").alias("n_lines"), "label", "first_line", "first_pos")


# ---- windows


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    return grouping.with_window(parsing.parse_labelled(_lines(spark, d)), WINDOW_SECONDS)


@_query(f"""with {_WIN} select 'bgl_{WINDOW_SECONDS}s_w' || window_id paragraph_id, md5(string_agg(regexp_replace(text, '^\\s*\\S+\\s+', ''), chr(10) order by line_no)) digest, count(*) n_lines, max(anomaly) as label, window_id source_window_id, cast(min(ts) as double) start_timestamp from win group by window_id having count(*) >= 2""")
def window_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    out = grouping.window_paragraphs(parsing.parse_labelled(_lines(spark, d)), WINDOW_SECONDS, "bgl")
    return out.select("paragraph_id", F.md5(F.array_join("lines", "\n")).alias("digest"), F.size("lines").cast("bigint").alias("n_lines"), "label", "source_window_id", "start_timestamp")


@_query(f"with {_WIN} select count(*) filter (n_lines >= 2) windows_kept, count(*) filter (n_lines < 2 and label = 0) singleton_normal_dropped, count(*) filter (n_lines < 2 and label = 1) singleton_anomaly_dropped from siz")
def dropped_windows(spark: SparkSession, d: str) -> DataFrame:
    return grouping.dropped_windows(_windowed(spark, d))


@_query(f"with {_WIN} select line_no, window_id, row_number() over (partition by window_id order by line_no) - 1 idx, count(*) over (partition by window_id) n from win")
def line_positions(spark: SparkSession, d: str) -> DataFrame:
    return grouping.line_positions(_windowed(spark, d)).select("line_no", "window_id", "idx", "n")


_POS = f"""{_WIN}, placed as (select *, row_number() over (partition by window_id order by line_no) - 1 idx, count(*) over (partition by window_id) n from win),
 hit as (select window_id, idx / n as pos_, idx = min(idx) over (partition by window_id) is_first from placed where n >= 2 and anomaly = 1)"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return profile.anomaly_positions(grouping.line_positions(_windowed(spark, d)))


def _stats_sql(name: str, where: str) -> str:
    return f"""select '{name}' kind, count(*) n, round(coalesce(quantile_cont(pos_, 0.25), 0), 6) p25, round(coalesce(quantile_cont(pos_, 0.5), 0), 6) p50, round(coalesce(quantile_cont(pos_, 0.75), 0), 6) p75, round(coalesce(avg(pos_), 0), 6) mean,
 round(coalesce(avg(case when pos_ <= 0.1 then 1 else 0 end), 0), 6) within_10, round(coalesce(avg(case when pos_ <= 0.25 then 1 else 0 end), 0), 6) within_25,
 case when coalesce(quantile_cont(pos_, 0.5), 0) < 0.1 then 'STRONGLY EARLY' when coalesce(quantile_cont(pos_, 0.5), 0) < 0.3 then 'EARLY' when coalesce(quantile_cont(pos_, 0.5), 0) < 0.7 then 'DISTRIBUTED / MIDDLE' else 'LATE' end verdict from hit where {where}"""


@_query(f"with {_POS} {_stats_sql('first', 'is_first')} union all {_stats_sql('all', 'true')}")
def position_stats(spark: SparkSession, d: str) -> DataFrame:
    at = _positions(spark, d)
    both = [profile.position_stats(x).withColumn("kind", F.lit(k)) for k, x in (("first", at.where("is_first")), ("all", at))]
    out = both[0].unionByName(both[1])
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "mean", "within_10", "within_25")), "verdict")


@_query(f"with {_POS} select cast(r as int) bin, count(pos_) n from range(10) t(r) left join (select pos_, least(floor(pos_ * 10), 9) b from hit) on b = r group by 1")
def position_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.position_histogram(_positions(spark, d))


@_query(f"""with {_WIN}, s as (select *, n_anomalous / n_lines dens from siz where n_lines >= 2 and n_anomalous > 0)
 select count(*) windows, round(coalesce(avg(dens), 0), 6) density_mean, round(coalesce(quantile_cont(dens, 0.5), 0), 6) density_median, round(coalesce(avg(n_lines), 0), 6) lines_mean, round(coalesce(quantile_cont(n_lines, 0.5), 0), 6) lines_median, coalesce(max(n_lines), 0) lines_max from s""")
def anomaly_density(spark: SparkSession, d: str) -> DataFrame:
    sizes = _windowed(spark, d).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("anomaly").alias("n_anomalous"))
    out = profile.anomaly_density(sizes)
    return out.select("windows", *(F.round(c, 6).alias(c) for c in ("density_mean", "density_median", "lines_mean", "lines_median")), "lines_max")


# ---- lengths, gates, backbones


@_query(f"with {_P}, {_PW} select dataset, count(*) n, min(words) as min, max(words) as max, round(quantile_cont(words, 0.5), 6) p50, round(quantile_cont(words, 0.8), 6) p80, round(quantile_cont(words, 0.95), 6) p95, round(quantile_cont(words, 0.99), 6) p99 from pw group by 1")
def word_lengths(spark: SparkSession, d: str) -> DataFrame:
    sized = _paragraphs(spark, d).select("dataset", profile.lines_words("lines").alias("words"))
    return profile.length_distribution(sized, "words", ["dataset"]).select("dataset", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("p50", "p80", "p95", "p99")))


@_query(f"with {_P} select dataset, count(*) total, count(*) filter (label = 0) normal, count(*) filter (label = 1) anomaly, round(count(*) filter (label = 1) / count(*), 9) anomaly_rate from par group by 1")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.label_counts(_paragraphs(spark, d), ["dataset"]).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


@_query(f"""with {_P}, {_PW}, g as (select dataset, backbone, max_tokens, avg(case when tokens > max_tokens then 1 else 0 end) r, max(tokens) mx, quantile_cont(tokens, 0.95) p95 from pw, backbone_limits group by 1, 2, 3)
 select dataset, backbone, max_tokens, round(r, 9) truncation_rate, mx as max, round(p95, 6) p95, mx > 5 * max_tokens hard_fail, p95 > max_tokens flag from g""")
def length_gate(spark: SparkSession, d: str) -> DataFrame:
    out = profile.length_gate(_paragraphs(spark, d), table(spark, d, "backbone_limits"), ["dataset"])
    return out.select("dataset", "backbone", "max_tokens", F.round("truncation_rate", 9).alias("truncation_rate"), "max", F.round("p95", 6).alias("p95"), "hard_fail", "flag")


@_query(f"""with {_P}, {_PW}, g as (select dataset, quantile_cont(words, 0.8) p80 from pw group by 1), c as (select dataset, p80, case when p80 <= 512 then 'roberta-base' else 'allenai/longformer-base-4096' end backbone from g)
 select dataset, round(p80, 6) p80, backbone, case when backbone like '%longformer%' then 4096 else 512 end token_limit, case when backbone like '%longformer%' then 2 else 8 end batch_size, format('p80(word_length) = {{:.1f}} {{}} threshold 512 → {{}}', p80, case when p80 <= 512 then '<=' else '>' end, backbone) rationale from c""")
def backbone_choice(spark: SparkSession, d: str) -> DataFrame:
    sized = _paragraphs(spark, d).select("dataset", profile.lines_words("lines").alias("words"))
    out = profile.length_distribution(sized, "words", ["dataset"]).withColumn("backbone", profile.choose_backbone("p80"))
    return out.select("dataset", F.round("p80", 6).alias("p80"), "backbone", profile.backbone_limit("backbone").alias("token_limit"), profile.backbone_batch("backbone").alias("batch_size"), profile.rationale("p80", "word_length").alias("rationale"))


@_query(f"with {_P}, {_PW} select dataset, arg_max(paragraph_id, (words + 2, -ord)) paragraph_id, max(words + 2) n_tokens from pw group by 1")
def longest_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return profile.longest(_paragraphs(spark, d), ["dataset"])


@_query(f"""with {_P}, {_PW}, o as (select dataset, words, row_number() over (partition by dataset order by words) - 1 i, count(*) over (partition by dataset) n from pw)
 select dataset, max(n) n, round(avg(words), 6) mean, min(words) as min, max(words) as max, max(words) filter (i = n // 2) p50, max(words) filter (i = least(n - 1, cast(floor(n * 0.95) as bigint))) p95 from o group by 1""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    sized = _paragraphs(spark, d).select("dataset", profile.lines_words("lines").alias("words"))
    return profile.index_stats(sized, "words", ["dataset"]).withColumn("mean", F.round("mean", 6))


# ---- vocabularies

_VOC = f"{_P}, tk as (select dataset, label, paragraph_id, unnest(regexp_extract_all(array_to_string(lines, chr(10)), '\\S+')) token from par where label is not null and lines is not null), voc as (select dataset, label, token, count(*) n, count(distinct paragraph_id) np from tk group by 1, 2, 3)"


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return profile.vocabulary(_paragraphs(spark, d).where("label is not null"), ["dataset", "label"])


@_query(f"with {_VOC} select dataset, label, count(*) n_tokens, cast(sum(n) as bigint) n_uses, max(n) most from voc group by 1, 2")
def vocabulary_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(spark, d).groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("n").alias("n_uses"), F.max("n").alias("most"))


@_query(f"""with {_VOC}, a as (select distinct token from voc where label = 0), b as (select distinct token from voc where label = 1), f as (select a.token a, b.token b from a full join b using (token))
 select count(a) n_left, count(b) n_right, count(*) filter (a is not null and b is not null) n_shared, count(*) filter (b is null) only_left, count(*) filter (a is null) only_right, round(count(*) filter (a is not null and b is not null) / count(*), 9) jaccard from f""")
def vocabulary_overlap(spark: SparkSession, d: str) -> DataFrame:
    v = _vocabulary(spark, d)
    return profile.vocabulary_overlap(v.where("label = 0"), v.where("label = 1")).withColumn("jaccard", F.round("jaccard", 9))


@_query(f"""with {_VOC}, a as (select token, cast(sum(n) as bigint) n, cast(sum(np) as bigint) np from voc where label = 1 group by 1), t as (select count(*) c from par where label = 1)
 select token, n, round(np / c, 9) as share from a, t where token not in (select token from voc where label = 0) order by n desc, token desc limit 30""".replace("select token, n,", "select case when length(token) > 60 then left(token, 57) || '...' else token end as token, n,"))
def anomaly_tokens(spark: SparkSession, d: str) -> DataFrame:
    v = _vocabulary(spark, d).groupBy("label", "token").agg(F.sum("n").alias("n"), F.sum("n_paragraphs").alias("n_paragraphs"))
    total = _paragraphs(spark, d).where("label = 1").count()
    return profile.own_tokens(v.where("label = 1"), v.where("label = 0"), F.lit(total), 30).withColumns({"share": F.round("share", 9), "token": profile.shown("token", 60)})


# ---- caps, folds, splits: for every artifact, over the paragraphs of its data set and batches

_OWN = f"{_P}, own as (select a.artifact_id, p.paragraph_id, p.label, p.ord from par p join splits_artifacts a on p.dataset = a.dataset and p.batch_no between a.batch_from and a.batch_to)"


def _own_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with artifact_id, once for each artifact whose data set and batches hold them."""
    a = table(spark, d, "splits_artifacts").where("batch_from <= batch_to")
    # A row per batch, so that the join is on equal keys; an artifact has few batches.
    batches = a.select("artifact_id", "dataset", F.explode(F.sequence("batch_from", "batch_to")).alias("batch_no"))
    once = table(spark, d, "paragraphs").select("dataset", "batch_no", "paragraph_id", "label", "ord").dropDuplicates(["paragraph_id"])
    return once.join(batches, ["dataset", "batch_no"]).select("artifact_id", "paragraph_id", "label", "ord")


def _caps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subsample_summaries").select("artifact_id", "seed", "max_normal", "max_anomaly")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "splits_artifacts").drop("dataset")


@_query(f"""with {_OWN}, r as (select artifact_id, label, paragraph_id, max_normal, max_anomaly, row_number() over (partition by artifact_id, label order by md5(concat_ws(':', seed + case when label = 1 then 1000 else 0 end, paragraph_id)), paragraph_id) r from own join subsample_summaries using (artifact_id) where label is not null)
 select artifact_id, label, paragraph_id from r where r <= coalesce(case when label = 0 then max_normal else max_anomaly end, r)""")
def capped_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.capped(_own_paragraphs(spark, d).select("artifact_id", "label", "paragraph_id"), _caps(spark, d), ["artifact_id"])


@_query(f"""with {_OWN}, c as (select artifact_id, count(*) filter (label = 0) n, count(*) filter (label = 1) a, any_value(max_normal) mn, any_value(max_anomaly) ma from own join subsample_summaries using (artifact_id) group by 1)
 select artifact_id, n input_normal, a input_anomaly, least(n, coalesce(mn, n)) output_normal, least(a, coalesce(ma, a)) output_anomaly, least(n, coalesce(mn, n)) < n normal_was_capped, least(a, coalesce(ma, a)) < a anomaly_was_capped from c""")
def cap_summary(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cap_summary(_own_paragraphs(spark, d), _caps(spark, d), ["artifact_id"])


_FOLD = f"{_OWN}, plan as (select * from splits_artifacts), nf as (select p.artifact_id, paragraph_id, p.ord, plan.* exclude (artifact_id), cast((row_number() over (partition by p.artifact_id order by md5(concat_ws(':', seed, paragraph_id)), paragraph_id) - 1) % n_folds as int) fold from own p join plan using (artifact_id) where p.label = 0)"


@_query(f"with {_FOLD} select artifact_id, paragraph_id, fold from nf")
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return sampling.assign_folds(_own_paragraphs(spark, d).select("artifact_id", "label", "paragraph_id"), _plan(spark, d), ["artifact_id"]).select("artifact_id", "paragraph_id", "fold")


def _carve_sql(pool: str, a: str, b: str, one: int, two: int, streams: tuple[str, str], tag: str) -> str:
    order = lambda off: f"row_number() over (partition by artifact_id, fold_id order by md5(concat_ws(':', seed + {off} + fold_id, paragraph_id)), paragraph_id) - 1"
    return f"""{tag}0 as (select *, count(*) over (partition by artifact_id, fold_id) pool from {pool}),
 {tag}1 as (select *, case when pool < {a} + {b} and {a} + {b} > 0 then pool * {a} // ({a} + {b}) else {a} end ea, case when pool < {a} + {b} and {a} + {b} > 0 then pool - pool * {a} // ({a} + {b}) else {b} end eb, {order(one)} pos from {tag}0),
 {tag}2 as (select * exclude (pos), {order(two)} pos from {tag}1 where pos >= ea),
 {tag} as (select '{streams[0]}' stream, artifact_id, fold_id, seed, pos, paragraph_id from {tag}1 where pos < ea union all select '{streams[1]}', artifact_id, fold_id, seed, pos, paragraph_id from {tag}2 where pos < eb)"""


_SPLITS = f"""{_FOLD}, nx as (select nf.*, k fold_id from nf, (select unnest(range(100)) k) where k < n_folds and fold <> k),
 ax as (select p.artifact_id, p.paragraph_id, plan.* exclude (artifact_id), k fold_id from own p join plan using (artifact_id), (select unnest(range(100)) k) where k < n_folds and p.label = 1),
 {_carve_sql("nx", "train_normal_per_fold", "tune_normal_per_fold", 0, 2000, ("train_normal_ids", "tune_normal_ids"), "nc")},
 {_carve_sql("ax", "tune_anomaly_per_fold", "test_anomaly_per_fold", 3000, 4000, ("tune_anomaly_ids", "test_anomaly_ids"), "ac")},
 spl as (select stream, artifact_id, cast(fold_id as int) fold_id, seed + fold_id seed, pos, paragraph_id from (select * from nc union all select * from ac union all select 'test_normal_ids', artifact_id, fold, seed, ord, paragraph_id from nf))"""


@_query(f"with {_SPLITS} select * from spl")
def created_splits(spark: SparkSession, d: str) -> DataFrame:
    return sampling.create_splits(_own_paragraphs(spark, d), _plan(spark, d), ["artifact_id"])


_FS = "fs as (select distinct artifact_id, fold_id, stream, pos, paragraph_id from fold_splits)"


@_query(f"""with {_FS}, w as (select artifact_id, fold_id, count(*) filter (stream = 'train_normal_ids') train_normal, count(*) filter (stream = 'tune_normal_ids') tune_normal, count(*) filter (stream = 'tune_anomaly_ids') tune_anomaly, count(*) filter (stream = 'test_normal_ids') test_normal, count(*) filter (stream = 'test_anomaly_ids') test_anomaly from fs group by 1, 2)
 select *, tune_normal + tune_anomaly tune_total, test_normal + test_anomaly test_total, round(coalesce(tune_anomaly / nullif(tune_normal + tune_anomaly, 0), 0), 9) tune_anomaly_rate, round(coalesce(test_anomaly / nullif(test_normal + test_anomaly, 0), 0), 9) test_anomaly_rate from w""")
def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.fold_sizes(table(spark, d, "fold_splits").select("artifact_id", "fold_id", "stream", "pos", "paragraph_id").distinct(), ["artifact_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("tune_anomaly_rate", "test_anomaly_rate")})


@_query("""with s as (select distinct artifact_id, fold_id, stream, paragraph_id from fold_splits) select a.artifact_id, a.fold_id, a.stream as "left", b.stream as "right", count(*) n from s a join s b on a.artifact_id = b.artifact_id and a.fold_id = b.fold_id and a.paragraph_id = b.paragraph_id and a.stream < b.stream group by 1, 2, 3, 4""")
def stream_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stream_overlaps(table(spark, d, "fold_splits"), ["artifact_id"])


# ---- evaluation sets


def _test_ids(spark: SparkSession, d: str) -> DataFrame:
    return scoring.split_ids(table(spark, d, "fold_splits"), "test", ["artifact_id"])


@_query(f"""with {_FS}, {_P} select artifact_id, fold_id, case when stream = 'test_anomaly_ids' then 1 else 0 end "class", pos, paragraph_id, label from fs join par using (paragraph_id) where stream in ('test_normal_ids', 'test_anomaly_ids')""")
def evaluation_set(spark: SparkSession, d: str) -> DataFrame:
    return scoring.evaluation_set(_test_ids(spark, d), table(spark, d, "paragraphs").select("paragraph_id", "label"))


@_query(f"""with {_FS}, i as (select artifact_id, fold_id, paragraph_id, count(*) k from (select distinct artifact_id, fold_id, stream, pos, paragraph_id from fs where stream in ('test_normal_ids', 'test_anomaly_ids')) group by 1, 2, 3)
 select artifact_id, fold_id, count(*) filter (paragraph_id not in (select paragraph_id from paragraphs)) n_missing, count(*) filter (k > 1) n_repeated from i group by 1, 2""")
def evaluation_faults(spark: SparkSession, d: str) -> DataFrame:
    return scoring.id_faults(_test_ids(spark, d), table(spark, d, "paragraphs"), ["artifact_id"]).drop("missing", "repeated")


@_query(f"""with {_FS}, i as (select artifact_id, fold_id, paragraph_id, count(*) k from fs where stream in ('test_normal_ids', 'test_anomaly_ids') group by 1, 2, 3),
 m as (select *, case when paragraph_id not in (select paragraph_id from paragraphs) then paragraph_id end lost, case when k > 1 then paragraph_id end twice from i)
 select artifact_id, fold_id, array_to_string((list(lost order by lost) filter (lost is not null))[1:5], ' ') missing, array_to_string((list(twice order by twice) filter (twice is not null))[1:5], ' ') repeated from m group by 1, 2""")
def evaluation_fault_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first ids of each kind of fault."""
    found = scoring.id_faults(_test_ids(spark, d), table(spark, d, "paragraphs"), ["artifact_id"])
    text = lambda c: F.nullif(F.array_join(c, " "), F.lit("")).alias(c)
    return found.select("artifact_id", "fold_id", text("missing"), text("repeated"))


# ---- masks, scores, operating points

_MASK = f"""{_P}, ml as (select paragraph_id, generate_subscripts(lines, 1) - 1 line_no, unnest(lines) text from par where lines is not null),
 mt as (select *, regexp_extract_all(text, '\\S+') t from ml),
 mc as (select *, row_number() over (partition by paragraph_id order by md5(concat_ws(':', 42, 0, paragraph_id, line_no)), line_no) r, count(*) over (partition by paragraph_id) n from mt),
 mk as (select * from mc where r <= least(n, greatest(1, cast(round_even(n * 0.5, 0) as int)))),
 mp as (select paragraph_id, line_no, t, generate_subscripts(t, 1) - 1 pos, unnest(t) token, len(t) m from mk),
 mr as (select *, row_number() over (partition by paragraph_id, line_no order by md5(concat_ws(':', 42, 0, paragraph_id, line_no, pos)), pos) r from mp),
 ms as (select paragraph_id, line_no, pos, token, t from mr where r <= least(m, greatest(1, cast(round_even(m * 0.8, 0) as int)))),
 msk as (select paragraph_id, line_no, pos, token, case when pos > 0 and not exists (select 1 from ms b where b.paragraph_id = a.paragraph_id and b.line_no = a.line_no and b.pos = a.pos - 1) then t[pos] end previous from ms a)"""


@_query(f"with {_MASK} select paragraph_id, cast(0 as int) pass, cast(line_no as int) line_no, cast(pos as int) pos, token, previous from msk")
def masked_positions(spark: SparkSession, d: str) -> DataFrame:
    return masking.masked_positions(_paragraphs(spark, d))


@_query(f"""with {_P}, bl as (select paragraph_id, generate_subscripts(lines, 1) - 1 line_no, unnest(lines) text from par where lines is not null), bt as (select *, len(regexp_extract_all(text, '\\S+')) m from bl),
 bs as (select *, coalesce(sum(m) over (partition by paragraph_id order by line_no rows between unbounded preceding and 1 preceding), 0) seen from bt), pa as (select paragraph_id, min(line_no) filter (seen >= 510) stop from bs group by 1)
 select paragraph_id, count(*) n_lines, cast(sum(least(m, 510 - seen)) as bigint) n_tokens from bs join pa using (paragraph_id) where seen < 510 group by 1""")
def truncated_lines(spark: SparkSession, d: str) -> DataFrame:
    cut = masking.boundaries(_paragraphs(spark, d).where("lines is not null"), profile.SHORT_LIMIT - masking.RESERVED)
    return cut.groupBy("paragraph_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"))


_SCORE = f"""{_MASK}, lt as (select regexp_extract_all(text, '\\S+') t from (select unnest(lines) text from par where label = 0 and lines is not null)),
 pr as (select case when i > 1 then t[i - 1] end previous, t[i] token, i from (select t, unnest(range(1, len(t) + 1)) i from lt)),
 fo as (select previous, token, row_number() over (partition by previous order by count(*) desc, token) r from pr where i > 1 group by 1, 2),
 al as (select token, row_number() over (order by count(*) desc, token) r from pr group by 1),
 kn as (select distinct previous from fo),
 rk as (select m.*, case when kn.previous is not null then fo.r else al.r end hit_rank from msk m left join kn on kn.previous = m.previous left join fo on fo.previous = m.previous and fo.token = m.token left join al on al.token = m.token),
 hit as (select paragraph_id, count(*) n, count(*) filter (hit_rank <= 5) k5, count(*) filter (hit_rank <= 9) k9, count(*) filter (hit_rank <= 12) k12 from rk group by 1),
 kk(top_k) as (values (5), (9), (12)),
 sc as (select dataset, paragraph_id, label, top_k, coalesce(case top_k when 5 then k5 when 9 then k9 else k12 end / n, 1.0) accuracy, coalesce(n, 0) n_masked_total from par left join hit using (paragraph_id), kk where label is not null)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = _paragraphs(spark, d)
    scorer = scoring.BigramScorer(paragraphs.where("label = 0 and lines is not null"))
    return scorer.rank(masking.masked_positions(paragraphs), max(scoring.TOP_K))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = _paragraphs(spark, d).where("label is not null")
    return scoring.pooled_accuracy(paragraphs, _ranked(spark, d), keep=("dataset",))


@_query(f"with {_SCORE} select paragraph_id, label, top_k, round(accuracy, 9) accuracy, n_masked_total from sc")
def paragraph_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("paragraph_id", "label", "top_k", F.round("accuracy", 9).alias("accuracy"), "n_masked_total")


@_query(f"with {_SCORE} select count(*) n, round(avg(case when coalesce(hit_rank, 99) <= 1 then 1 else 0 end), 9) accuracy from rk")
def top1_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.overall_accuracy(_ranked(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


_THETA = ", ".join(f"({x!r})" for x in numeric.threshold_grid(TOP1))
_MET = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9)", "round(coalesce(tp / nullif(tp + fn, 0), 0), 9)", "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9)", "round(coalesce(tn / nullif(tn + fp, 0), 0), 9)"
_GRID = f"""{_SCORE}, th(threshold) as (values {_THETA}), cell as (select dataset, top_k, threshold, count(*) filter (label = 1 and accuracy < threshold) tp, count(*) filter (label = 0 and accuracy < threshold) fp, count(*) filter (label = 0 and accuracy >= threshold) tn, count(*) filter (label = 1 and accuracy >= threshold) fn from sc, (select cast(threshold as double) threshold from th) group by 1, 2, 3),
 gm as (select dataset, top_k, round(threshold, 6) threshold, tp, fp, tn, fn, {_MET[0]} as precision, {_MET[1]} recall, {_MET[2]} f1, {_MET[3]} specificity from cell)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    cells = tuning.grid(spark, list(scoring.TOP_K), numeric.threshold_grid(TOP1))
    return tuning.grid_metrics(_scores(spark, d), cells, ["dataset"])


@_query(f"with {_GRID} select * from gm")
def tuning_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumns({c: F.round(c, 9) for c in tuning.METRICS} | {"threshold": F.round("threshold", 6)})


@_query(f"with {_GRID} select dataset, -b[2] best_top_k, b[3] best_threshold, b[1] best_f1 from (select dataset, max((f1, -top_k, threshold)) b from gm group by 1)")
def best_cells(spark: SparkSession, d: str) -> DataFrame:
    out = tuning.best_cell(_grid(spark, d).withColumns({"f1": F.round("f1", 9), "threshold": F.round("threshold", 6)}), ["dataset"])
    return out


_EVAL = f"""{_SCORE}, th(threshold) as (values {_THETA}), fx as (select distinct artifact_id, fold_id, stream, paragraph_id from fold_splits),
 sf as (select artifact_id, fold_id, stream, sc.* from fx join sc using (paragraph_id)),
 cell as (select artifact_id, fold_id, top_k, threshold, count(*) filter (label = 1 and accuracy < threshold) tp, count(*) filter (label = 0 and accuracy < threshold) fp, count(*) filter (label = 1 and accuracy >= threshold) fn from sf, (select cast(threshold as double) threshold from th) where stream like 'tune%' group by 1, 2, 3, 4),
 best as (select artifact_id, fold_id, -b[2] top_k, b[3] threshold from (select artifact_id, fold_id, max((round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9), -top_k, threshold)) b from cell group by 1, 2)),
 tc as (select artifact_id, fold_id, top_k, threshold, count(*) filter (label = 1 and accuracy < threshold) tp, count(*) filter (label = 0 and accuracy < threshold) fp, count(*) filter (label = 0 and accuracy >= threshold) tn, count(*) filter (label = 1 and accuracy >= threshold) fn from sf join best using (artifact_id, fold_id, top_k) where stream like 'test%' group by 1, 2, 3, 4),
 fm as (select artifact_id, fold_id, top_k, round(threshold, 6) best_threshold, tp, fp, tn, fn, {_MET[0]} as precision, {_MET[1]} recall, {_MET[2]} f1, {_MET[3]} specificity from tc)"""


def _fold_scores(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "fold_splits").withColumn("split", F.split_part("stream", F.lit("_"), F.lit(1))).where("split in ('tune', 'test')").select("artifact_id", "fold_id", "stream", "split", "paragraph_id").distinct()
    return ids.join(_scores(spark, d), "paragraph_id")


def _fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    keys = ["artifact_id", "fold_id"]
    cells = tuning.grid(spark, list(scoring.TOP_K), numeric.threshold_grid(TOP1))
    return tuning.tuned_metrics(_fold_scores(spark, d), cells, keys).withColumns({c: F.round(c, 9) for c in tuning.METRICS} | {"best_threshold": F.round("best_threshold", 6)})


@_query(f"with {_EVAL} select * from fm")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _fold_metrics(spark, d)


@_query(f"with {_EVAL} select artifact_id, count(*) n_folds, " + ", ".join(f"round(avg({m}), 6) mean_{m}, round(coalesce(stddev_samp({m}), 0), 6) std_{m}" for m in tuning.METRICS) + " from fm group by 1")
def across_folds(spark: SparkSession, d: str) -> DataFrame:
    out = tuning.across_folds(_fold_metrics(spark, d), ["artifact_id"])
    return out.select("artifact_id", "n_folds", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@_query(f"with {_EVAL} select artifact_id, string_agg(printf('%d:%d', fold_id, top_k), ',' order by fold_id) points, round(sum(f1), 6) f1_sum from fm group by 1")
def fold_points(spark: SparkSession, d: str) -> DataFrame:
    out = tuning.fold_lists(_fold_metrics(spark, d), ["artifact_id"])
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["fold_id"], p["top_k"])), ",")
    return out.select("artifact_id", text.alias("points"), F.round(F.aggregate(F.col("per_fold")["f1"], F.lit(0.0), lambda a, b: a + b), 6).alias("f1_sum"))


# ---- substitution


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "verb string, lemma string")


_LEX = "lex(verb, lemma) as (values " + ", ".join(f"('{v}', {'null' if x is None else repr(x)})" for v, x in LEXICON) + ")"


@_query(f"with {_LEX} select verb, lemma, case when lemma is null then 'no_lemma' when lemma = '' or regexp_matches(lemma, '[_\\s\\-]') then 'multi_word' when lower(lemma) = lower(verb) then 'identity' else 'accepted' end kind from lex")
def lexicon_kinds(spark: SparkSession, d: str) -> DataFrame:
    return substitution.classify(_lexicon(spark))


@_query(f"""with {_P}, {_LEX}, tk as (select ord, generate_subscripts(t, 1) nth, unnest(t) w from (select ord, regexp_extract_all(array_to_string(lines, chr(10)), '\\S+') t from par where lines is not null))
 select lower(w) verb, count(*) n from tk where regexp_matches(w, '^[A-Za-z]+$') and lower(w) in (select verb from lex) group by 1 order by n desc, min((ord, nth)) limit 10""")
def top_verbs(spark: SparkSession, d: str) -> DataFrame:
    return substitution.top_verbs(_paragraphs(spark, d), _lexicon(spark), 10)


_RULES = [(v, x) for v, x in LEXICON if x and "_" not in x and x != v]


def _replace_sql() -> str:
    out = "text"
    for v, x in _RULES:
        out = f"regexp_replace(regexp_replace(regexp_replace({out}, '\\b{v.upper()}\\b', '{x.upper()}', 'g'), '\\b{v.capitalize()}\\b', '{x.capitalize()}', 'g'), '\\b{v}\\b', '{x}', 'g')"
    return out


@_query(f"""with {_P}, ml as (select paragraph_id, generate_subscripts(lines, 1) nth, unnest(lines) text from par where lines is not null)
 select paragraph_id, md5(string_agg({_replace_sql()}, chr(10) order by nth)) digest, cast(sum(len(regexp_extract_all(lower(text), '\\b({"|".join(v for v, _ in _RULES)})\\b'))) as bigint) n_replaced from ml group by 1""")
def substituted(spark: SparkSession, d: str) -> DataFrame:
    out = substitution.substitute(_paragraphs(spark, d).where("lines is not null").select("paragraph_id", "lines"), _RULES)
    return out.select("paragraph_id", F.md5(F.array_join("lines", "\n")).alias("digest"), F.col("n_replaced").cast("bigint").alias("n_replaced"))


# ---- others


@_query("select paragraph_id, cast(s as int) segment, cast(s * 5 as int) first_line, least(10, n - s * 5) n_lines from (select distinct on (paragraph_id) paragraph_id, len(lines) n from paragraphs where lines is not null) p, (select unnest(range(1000)) s) where s * 5 <= greatest(0, n - 6)")
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    out = segments.segments(_paragraphs(spark, d).where("lines is not null"), 10)
    return out.select("paragraph_id", "segment", "first_line", F.size("lines").cast("bigint").alias("n_lines"))


@_query(f"""with {_P}, r as (select dataset, paragraph_id, row_number() over (partition by dataset, label order by md5(concat_ws(':', 7, paragraph_id)), paragraph_id) r, label, lines from par where label is not null)
 select dataset, label, paragraph_id, coalesce(array_to_string(list_transform(lines[1:5], lambda x: left(x, 150)), chr(10)), '') first_lines from r where r <= 3""")
def examples(spark: SparkSession, d: str) -> DataFrame:
    few = ranking.shuffle_rank(_paragraphs(spark, d).where("label is not null"), ["dataset", "label"], F.lit(7), "paragraph_id", "r").where("r < 3")
    return few.select("dataset", "label", "paragraph_id", F.coalesce(F.array_join(profile.first_lines("lines"), "\n"), F.lit("")).alias("first_lines"))


@_query("""with e as (select user_id, event_id seq, cast(date_part('day', ts) as double) / 2 epoch, value loss from events) select user_id, cast(round_even(epoch, 0) as int) epoch, round(arg_max(loss, seq), 6) loss from e where loss is not null group by 1, 2""")
def epoch_losses(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), (F.dayofmonth("ts") / 2.0).alias("epoch"), F.col("value").alias("loss"))
    return tuning.epoch_losses(log, ["user_id"]).withColumn("loss", F.round("loss", 6))


@_query("select event_type, b[2] user_id, round(b[1], 6) loss from (select event_type, min((value, user_id)) b from events where value is not null group by 1)")
def least_loss(spark: SparkSession, d: str) -> DataFrame:
    trials = table(spark, d, "events").where("value is not null").select("event_type", F.col("value").alias("loss"), F.col("user_id").alias("lr"))
    return tuning.best_rate(trials, ["event_type"]).select("event_type", F.col("lr").alias("user_id"), F.round("loss", 6).alias("loss"))


@_query("select artifact_id, string_agg(stream || ':' || n, ',' order by stream) streams from (select artifact_id, stream, count(*) n from (select distinct artifact_id, fold_id, stream, pos, paragraph_id from fold_splits) group by 1, 2) group by 1")
def exported_streams(spark: SparkSession, d: str) -> DataFrame:
    """Splits as JSON and back: rows of each stream."""
    from loomline.sources import artifacts

    rows = table(spark, d, "fold_splits").select("artifact_id", "fold_id", "seed", "stream", "pos", "paragraph_id").distinct()
    back = artifacts.splits_json(rows, ["artifact_id"]).select("artifact_id", F.explode(F.from_json("value", artifacts.SPLITS)["folds"]).alias("f"))
    sizes = back.select("artifact_id", F.explode(F.array(*(F.struct(F.lit(s).alias("stream"), F.size(F.col(f"f.{s}")).alias("n")) for s in artifacts.STREAMS))).alias("x")).groupBy("artifact_id", "x.stream").agg(F.sum("x.n").alias("n")).where("n > 0")
    return sizes.groupBy("artifact_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stream", "n"))), lambda x: F.concat_ws(":", x["stream"], x["n"])), ",").alias("streams"))

