"""Queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

import os

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import category_sample, leakage, mixing, permanent_sample, reading_level, repeated_events, split_overlap, splitting, tokens
from loomline.sources import table



def tokenizer() -> str:
    """The tokenizer file of the queries: $LOOMLINE_TOKENIZER, else a usual place."""
    return os.environ.get("LOOMLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """For every seed, a tenth of the paragraphs of its datasets, loaded in two halves of the batches."""
    seeds = table(spark, d, "splits_artifacts").select("artifact_id", "dataset", "seed")
    more = table(spark, d, "subsample_summaries").select("artifact_id", F.col("seed").alias("own")).join(seeds.drop("seed"), "artifact_id")
    each = seeds.select("dataset", "seed").union(more.select("dataset", "own")).where("seed is not null").distinct()
    paragraphs = table(spark, d, "paragraphs").select(F.col("paragraph_id").alias("id"), "dataset", "batch_no")
    last = paragraphs.agg(F.max("batch_no")).first()[0] or 0
    out = permanent_sample.grow(paragraphs.join(each, "dataset"), [(0, last // 2), (0, last)])
    return out.where("selected").select("seed", F.col("id").alias("paragraph_id"), F.round("number", 9).alias("number"), "first_load")


def p1_sample_by_artifact(spark: SparkSession, d: str) -> DataFrame:
    """For each artifact's own seed and that of its caps, a tenth of the paragraphs of its data set and batches, loaded in two halves of the batches."""
    artifacts = table(spark, d, "splits_artifacts").select("artifact_id", "dataset", "seed", "batch_from", "batch_to")
    caps = table(spark, d, "subsample_summaries").select("artifact_id", F.col("seed").alias("own"))
    covers = artifacts.unionByName(artifacts.drop("seed").join(caps.withColumnRenamed("own", "seed"), "artifact_id"))
    each = covers.where("seed is not null and batch_from <= batch_to").select("dataset", "seed", F.explode(F.sequence("batch_from", "batch_to")).alias("batch_no")).distinct()
    paragraphs = table(spark, d, "paragraphs").select(F.col("paragraph_id").alias("id"), "dataset", "batch_no")
    last = paragraphs.agg(F.max("batch_no")).first()[0] or 0
    out = permanent_sample.grow(paragraphs.join(each, ["dataset", "batch_no"]), [(0, last // 2), (0, last)])
    return out.where("selected").select("seed", F.col("id").alias("paragraph_id"), F.round("number", 9).alias("number"), "first_load")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_events.runs(table(spark, d, "paragraphs"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return repeated_events.collapse(table(spark, d, "paragraphs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return category_sample.unmet(table(spark, d, "paragraphs"), table(spark, d, "sample_requests"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return category_sample.sample(table(spark, d, "paragraphs"), table(spark, d, "sample_requests"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return category_sample.quotas(table(spark, d, "paragraphs"), table(spark, d, "sample_requests")).select("request_id", "dataset", "label", "available", "supply", F.round("wanted", 6).alias("wanted"), "met")


def p3_quotas(spark: SparkSession, d: str) -> DataFrame:
    """The same with what is taken of each category and what it lacks."""
    found = category_sample.quotas(table(spark, d, "paragraphs"), table(spark, d, "sample_requests"))
    return found.select("request_id", "dataset", "label", "supply", "quota", F.round("shortfall", 6).alias("shortfall"), "met")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "paragraphs"), table(spark, d, "backbone_limits"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "paragraphs"), table(spark, d, "backbone_limits"))


def p4_token_pieces(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The same by tokens of a public tokenizer."""
    return splitting.split_oversized(table(spark, d, "paragraphs"), table(spark, d, "backbone_limits"), measure=tokens.word_measure(path or tokenizer()))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.found(table(spark, d, "paragraphs"), table(spark, d, "fold_splits"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.per_stream(table(spark, d, "paragraphs"), table(spark, d, "fold_splits"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.pairs_per_stream(table(spark, d, "paragraphs"), table(spark, d, "fold_splits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), weight=mixing.intactness("text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), weight=mixing.intactness("text"))


def p9_reached(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(table(spark, d, "documents"), table(spark, d, "mix_targets"), weight=mixing.intactness("text"))


def p9_token_mix(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The mixes by tokens of a public tokenizer."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokens.token_count("text", path or tokenizer()), mixing.intactness("text"))


def p9_tokens(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The shares reached by tokens of a public tokenizer."""
    return mixing.reached(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokens.token_count("text", path or tokenizer()), mixing.intactness("text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.for_specialists(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.profile_by_source(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_sample, p1_sample_by_artifact, p2_found, p2_collapsed, p3_found, p3_sample, p3_report, p3_quotas, p4_found, p4_pieces, p4_token_pieces, p6_found, p6_counts, p6_pairs, p8_found, p8_items, p9_found, p9_mix, p9_reached, p9_token_mix, p9_tokens, p10_found, p10_levels, p10_sources)
}

_BARE = "regexp_replace(lower(w), '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g')"
# DuckDB counts edits in bytes; a damaged character is one.
_SAME = """len(a) = len(b) and len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2])) <= 1 and len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2]
 and not (z[1] <> '#' and z[2] <> '#' and length(z[1]) >= 5 and length(z[2]) >= 5 and levenshtein(regexp_replace(z[1], '[^ -~]', '?', 'g'), regexp_replace(z[2], '[^ -~]', '?', 'g')) <= 2))) = 0"""

_MIX = r"""with d as (select distinct on (doc_id) doc_id, batch_no, lower(trim(source)) source, len(regexp_extract_all(text, '\S+')) n, greatest(0.1, 1.0 - 20.0 * len(regexp_extract_all(text, '[\x{FFFD}ÃÂâ\x00-\x08]')) / greatest(length(text), 1)) weight from documents where text is not null and source is not null and doc_id is not null),
 t as (select distinct mix_id, batch_from, batch_to, lower(trim(source)) source, target_share * total_words budget, greatest(coalesce(max_repeats, 1), 0) most from mix_targets where mix_id is not null and source is not null),
 s as (select t.*, (select coalesce(sum(n), 0) from d where d.source = t.source and d.batch_no between t.batch_from and t.batch_to) supply from t),
 e as (select *, most * supply >= budget - 1e-6 met, case when most * supply < budget - 1e-6 then most when supply > 0 then least(floor((budget + 1e-6) / supply), most) else 0 end epochs from s),
 p as (select *, case when met and epochs < most then greatest(budget - epochs * supply, 0) else 0 end rest from e),
 k as (select p.mix_id, p.source, p.epochs, p.rest, d.doc_id, d.n, 1 - pow(('0x' || sha256('0' || chr(31) || mix_id || chr(31) || doc_id)[1:13])::bigint / 4503599627370496.0, 1 / weight) as sort_key from p join d on d.source = p.source and d.batch_no between p.batch_from and p.batch_to),
 o as (select *, coalesce(sum(n) over (partition by mix_id, source order by sort_key, doc_id rows between unbounded preceding and 1 preceding), 0) seen from k),
 u as (select mix_id, source, doc_id, n as size, cast(epochs + case when rest > 0 and seen + n <= rest + 1e-6 then 1 else 0 end as int) repeats from o)"""
_OVERLAP_SQL = """with t as (select paragraph_id, word, row_number() over (partition by paragraph_id, word) k from (select paragraph_id, unnest(regexp_extract_all(lower(line), '\\S+')[3:]) word from (select paragraph_id, unnest(lines) line from (select distinct on (paragraph_id) * from paragraphs)))),
 n as (select paragraph_id, count(*) n from t group by 1),
 f as (select distinct artifact_id, fold_id, stream, case when stream = 'train_normal_ids' then 'train' else 'test' end side, paragraph_id from fold_splits where stream in ('train_normal_ids', 'test_normal_ids', 'test_anomaly_ids')),
 ids as (select distinct artifact_id, paragraph_id from f),
 tt as (select artifact_id, paragraph_id, word, k, count(*) over (partition by artifact_id, word, k) df from t join ids using (paragraph_id)),
 o as (select *, row_number() over (partition by artifact_id, paragraph_id order by df, word, k) r from tt),
 pre as (select o.* from o join n using (paragraph_id) where r <= n - cast(ceil(0.8 * n - 1e-9) as bigint) + 1 and df > 1),
 c as (select distinct a.artifact_id, a.paragraph_id a, b.paragraph_id b from pre a join pre b on a.artifact_id = b.artifact_id and a.word = b.word and a.k = b.k and a.paragraph_id < b.paragraph_id),
 sim as (select c.artifact_id, c.a, c.b from c join t x on x.paragraph_id = c.a join t y on y.paragraph_id = c.b and y.word = x.word and y.k = x.k join n na on na.paragraph_id = c.a join n nb on nb.paragraph_id = c.b group by 1, 2, 3 having count(*) >= 0.8 * greatest(any_value(na.n), any_value(nb.n)) - 1e-9),
 w as (select artifact_id, a, b from sim union all select artifact_id, b, a from sim union all select artifact_id, paragraph_id, paragraph_id from ids),
 ds as (select paragraph_id, min(dataset) dataset from paragraphs group by 1),
 m as (select x.artifact_id, x.fold_id, least(x.paragraph_id, y.paragraph_id) paragraph_id_a, greatest(x.paragraph_id, y.paragraph_id) paragraph_id_b, y.stream, y.paragraph_id, ds.dataset
  from f x join w on w.artifact_id = x.artifact_id and w.a = x.paragraph_id join f y on y.artifact_id = x.artifact_id and y.fold_id = x.fold_id and y.paragraph_id = w.b left join ds on ds.paragraph_id = y.paragraph_id where x.side = 'train' and y.side = 'test')"""

ORACLE_SQL: dict[str, str] = {
    "p1_sample": """with ids as (select distinct p.paragraph_id, p.batch_no, e.seed from paragraphs p join (select dataset, seed from splits_artifacts union select a.dataset, s.seed from subsample_summaries s join splits_artifacts a using (artifact_id)) e using (dataset) where e.seed is not null and p.paragraph_id is not null),
 m as (select max(batch_no) // 2 half from paragraphs), n as (select seed, paragraph_id, ('0x' || sha256(seed || chr(31) || paragraph_id)[1:13])::bigint / 4503599627370496.0 number, case when min(batch_no) <= any_value(half) then 0 else 1 end first_load from ids, m group by 1, 2)
 select seed, paragraph_id, round(number, 9) as number, first_load from n where number < 0.1""",
    "p1_sample_by_artifact": """with a as (select dataset, batch_from, batch_to, seed from splits_artifacts union select a.dataset, a.batch_from, a.batch_to, s.seed from subsample_summaries s join splits_artifacts a using (artifact_id)),
 ids as (select distinct p.paragraph_id, p.batch_no, a.seed from paragraphs p join a on p.dataset = a.dataset and p.batch_no between a.batch_from and a.batch_to where a.seed is not null and p.paragraph_id is not null),
 m as (select max(batch_no) // 2 half from paragraphs), n as (select seed, paragraph_id, ('0x' || sha256(seed || chr(31) || paragraph_id)[1:13])::bigint / 4503599627370496.0 number, case when min(batch_no) <= any_value(half) then 0 else 1 end first_load from ids, m group by 1, 2)
 select seed, paragraph_id, round(number, 9) as number, first_load from n where number < 0.1""",
    "p2_found": f"""with l as (select paragraph_id, generate_subscripts(lines, 1) - 1 i, unnest(lines) line from (select distinct on (paragraph_id) * from paragraphs) where lines is not null),
 e as (select paragraph_id, i, list_transform(list_filter(list_transform(regexp_extract_all(coalesce(line, ''), '\\S+'), lambda w: {_BARE}), lambda w: w <> ''), lambda w: case when regexp_matches(w, '[0-9]') then '#' else w end) b from l),
 p as (select *, lag(b) over (partition by paragraph_id order by i) a from e), q as (select paragraph_id, i, coalesce(len(a) > 0 and len(b) > 0 and {_SAME}, false) same from p),
 g as (select *, sum(case when same then 0 else 1 end) over (partition by paragraph_id order by i) run from q)
 select paragraph_id, min(i) first_line, max(i) last_line from g group by paragraph_id, run having count(*) > 1""",
    "p3_found": """with r as (select distinct request_id, batch_from, batch_to, sample_size, max_normal, max_anomaly, dataset, label, target_share, min_rows from sample_requests),
 n as (select r.*, (select count(distinct p.paragraph_id) from paragraphs p where p.dataset = r.dataset and p.label = r.label and p.batch_no between r.batch_from and r.batch_to) available from r)
 select request_id, dataset, label from n where least(available, case when label = 0 then max_normal else max_anomaly end) < greatest(min_rows, target_share * sample_size) - 1e-9""",
    "p3_report": """with r as (select distinct request_id, batch_from, batch_to, sample_size, max_normal, max_anomaly, dataset, label, target_share, min_rows from sample_requests),
 n as (select r.*, (select count(distinct p.paragraph_id) from paragraphs p where p.dataset = r.dataset and p.label = r.label and p.batch_no between r.batch_from and r.batch_to) available from r),
 s as (select *, least(available, case when label = 0 then max_normal else max_anomaly end) supply, greatest(min_rows, target_share * sample_size) wanted from n)
 select request_id, dataset, label, available, supply, round(wanted, 6) wanted, supply >= wanted - 1e-9 met from s""",
    "p4_found": """with p as (select paragraph_id, max(1 + len(regexp_extract_all(array_to_string(lines, chr(10)), '\\S+')) + len(list_filter(lines, lambda x: x is not null))) n from paragraphs where lines is not null group by 1)
 select paragraph_id, backbone from p, backbone_limits where n > max_tokens""",
    "p6_found": f"{_OVERLAP_SQL} select distinct artifact_id, fold_id, paragraph_id_a, paragraph_id_b from m",
    "p6_counts": f"{_OVERLAP_SQL} select dataset, stream, count(*) n_ids from (select distinct artifact_id, fold_id, stream, paragraph_id, dataset from m) group by 1, 2",
    "p6_pairs": f"{_OVERLAP_SQL} select dataset, stream, count(*) n_pairs from (select distinct artifact_id, fold_id, paragraph_id_a, paragraph_id_b, stream, dataset from m) group by 1, 2",
    "p9_mix": f"{_MIX} select * from u where repeats > 0",
    "p9_reached": f"""{_MIX}, g as (select mix_id, source, sum(size * repeats) reached, count(*) n_documents, max(repeats) most_repeats from u where repeats > 0 group by 1, 2)
 select mix_id, source, budget, supply, met, coalesce(reached, 0) reached, coalesce(n_documents, 0) n_documents, coalesce(most_repeats, 0) most_repeats, coalesce(reached / nullif(sum(reached) over (partition by mix_id), 0), 0) share_reached, coalesce(reached, 0) >= most * supply exhausted from p left join g using (mix_id, source)""",
    "p9_found": """with d as (select distinct on (doc_id) batch_no, lower(trim(source)) source, len(regexp_extract_all(text, '\\S+')) n from documents where text is not null and source is not null),
 t as (select distinct mix_id, batch_from, batch_to, total_words, lower(trim(source)) source, target_share, max_repeats from mix_targets)
 select mix_id, source from t where max_repeats * (select coalesce(sum(n), 0) from d where d.source = t.source and d.batch_no between t.batch_from and t.batch_to) < target_share * total_words - 1e-6""",
}
