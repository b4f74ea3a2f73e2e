"""Artifacts between stages: parquet for tables, JSON for reports, and their checks."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = "struct<split_name:string,topk_grid:array<int>,n_passes:int,scores:array<struct<paragraph_id:string,label:int,topk_accuracies:array<struct<top_k:int,accuracy:double>>,n_masked_total:bigint,n_passes:int>>>"
CELLS = "struct<best_top_k:int,best_threshold:double,train_top1_acc:double,cells:array<struct<top_k:int,threshold:double,precision:double,recall:double,f1:double,specificity:double,tp:bigint,fp:bigint,tn:bigint,fn:bigint>>>"
SPLITS = "struct<n_folds:int,seed:bigint,folds:array<struct<fold_id:int,seed:bigint,train_normal_ids:array<string>,tune_normal_ids:array<string>,tune_anomaly_ids:array<string>,test_normal_ids:array<string>,test_anomaly_ids:array<string>>>>"
STREAMS = ("train_normal_ids", "tune_normal_ids", "tune_anomaly_ids", "test_normal_ids", "test_anomaly_ids")


def _json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", "value", F.from_json("value", schema).alias("j"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Split files in long form: file, fold_id, seed, stream, pos, paragraph_id."""
    fold = _json(spark, path, SPLITS).select("file", F.explode("j.folds").alias("f"))
    streams = F.array(*(F.struct(F.lit(s).alias("stream"), F.col(f"f.{s}").alias("ids")) for s in STREAMS))
    each = fold.select("file", "f.fold_id", "f.seed", F.explode(streams).alias("s"))
    return each.select("file", "fold_id", "seed", "s.stream", F.posexplode("s.ids").alias("pos", "paragraph_id"))


def splits_json(splits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): one JSON text per artifact; the inverse of :func:`read_splits`, at export size."""
    ids = splits.groupBy(*keys, "fold_id", "seed", "stream").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "paragraph_id"))), lambda x: x["paragraph_id"]).alias("ids"))
    fold = ids.groupBy(*keys, "fold_id", "seed").agg(*(F.coalesce(F.max(F.when(F.col("stream") == s, F.col("ids"))), F.array().cast("array<string>")).alias(s) for s in STREAMS))
    folds = fold.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("fold_id", "seed", *STREAMS))).alias("folds"))
    return folds.select(*keys, F.to_json(F.struct(F.size("folds").alias("n_folds"), "folds")).alias("value"))


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Score files as rows: file, split_name, paragraph_id, label, top_k, accuracy, n_masked_total, n_passes.

    A file without scores, or with accuracies that are no list (an older shape), raises.
    """
    raw = _json(spark, path, SCORES)
    shape = F.get_json_object("value", "$.scores[0].topk_accuracies")
    old = F.col("j.scores").isNull() | (shape.isNotNull() & ~F.startswith(F.ltrim(shape), F.lit("[")))
    # The check stands inside what is exploded: there no plan can leave it out.
    scores = F.when(old, F.raise_error(F.concat(F.lit("no scores in the shape expected: "), F.col("file")))).otherwise(F.col("j.scores"))
    rows = raw.select("file", "j.split_name", F.explode(scores).alias("s"))
    each = rows.select("file", "split_name", "s.paragraph_id", "s.label", F.explode_outer("s.topk_accuracies").alias("a"), "s.n_masked_total", "s.n_passes")
    return each.select("file", "split_name", "paragraph_id", "label", "a.top_k", "a.accuracy", "n_masked_total", "n_passes")


def read_grids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tuning grids as rows: file, best_top_k, best_threshold, train_top1_acc and the cells; absent counts are 0, absent keys raise."""
    raw = _json(spark, path, CELLS)
    lacks = F.concat_ws(", ", *(F.when(F.col(f"j.{k}").isNull(), k) for k in ("best_top_k", "best_threshold", "train_top1_acc", "cells")))
    checked = raw.select("file", F.when(lacks != "", F.raise_error(F.concat(F.lit("a tuning grid lacks "), lacks)).cast("int")).otherwise(F.col("j.best_top_k")).alias("best_top_k"), "j.best_threshold", "j.train_top1_acc", F.explode_outer("j.cells").alias("c"))
    zero = [F.coalesce(f"c.{n}", F.lit(0)).alias(n) for n in ("tp", "fp", "tn", "fn")]
    return checked.select("file", "best_top_k", "best_threshold", "train_top1_acc", "c.top_k", "c.threshold", "c.precision", "c.recall", "c.f1", "c.specificity", *zero)


def fold_of(path: str = "file"):
    """Number of the fold in a layout ``.../fold_<k>/...``."""
    return F.regexp_extract(path, r"fold_(\d+)/[^/]*$", 1).try_cast("int")


def target_file(output: str | Path, name: str) -> Path:
    """``output`` itself if it is a JSON file, else ``name`` in it."""
    output = Path(output)
    return output if output.suffix == ".json" else output / name


def save_json(data: object, path: str | Path) -> Path:
    """Indented JSON, folders made as needed; dataclasses and paths allowed."""

    def plain(x: object) -> object:
        if is_dataclass(x) and not isinstance(x, type):
            return asdict(x)
        if isinstance(x, Path):
            return str(x)
        raise TypeError(f"{type(x).__name__} has no JSON form")

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2, default=plain), encoding="utf-8")
    return path


def load_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def upsert_json(path: str | Path, field: str, value: object, otherwise: str | Path | None = None) -> Path:
    """Sets a field of a JSON file; where the file does not exist, the value goes to ``otherwise``."""
    path = Path(path)
    if path.exists():
        return save_json(load_json(path) | {field: value}, path)
    return save_json(value, otherwise or path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def length_summary(path: str | Path, tokens: bool = False) -> dict:
    """The length distribution a preparation summary holds, of words or of tokens."""
    field = "token_length_distribution" if tokens else "word_length_distribution"
    found = load_json(path).get(field)
    if found is None:
        raise ValueError(f"{path} has no {field}")
    return found.get("distribution", found) if tokens else found
