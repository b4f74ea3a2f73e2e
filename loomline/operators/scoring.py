"""Top-k accuracy of masked tokens. A scorer proposes ranked candidates; the rest does not know the model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import words
from loomline.operators.ranking import top_rows

TOP_K = (5, 9, 12)
#: Keys that rows without a visible token before are spread over.
NULL_KEYS = 4096
#: Faulty ids that are listed of each fold.
LISTED = 5
#: Streams of a split, normal ids first.
STREAMS = {s: (f"{s}_normal_ids", f"{s}_anomaly_ids") for s in ("train", "tune", "test")}


class Scorer(Protocol):
    def rank(self, masked: DataFrame, most: int) -> DataFrame:
        """``masked`` with ``hit_rank``: the place (from 1) of the true token among the candidates, null beyond ``most``."""
        ...


class BigramScorer:
    """Candidates by how often they followed the token before, or by how often they occur where that is hidden or new.

    A surrogate for a language model, fitted on the lines of ``train`` (paragraph_id, lines); ties go by token. A
    model of another kind plugs in through ``rank``.
    """

    def __init__(self, train: DataFrame, most: int = max(TOP_K)) -> None:
        self.most = most
        tokens = train.select(F.explode(F.array_compact("lines")).alias("line")).select(words("line").alias("t"))
        order = [F.col("n").desc(), F.col("token")]
        pairs = tokens.select(F.posexplode("t").alias("i", "token"), "t").select(F.get("t", F.col("i") - 1).alias("previous"), "token", "i")
        follow = pairs.where("i > 0").groupBy("previous", "token").agg(F.count(F.lit(1)).alias("n"))
        best = top_rows(follow, ["previous"], order, most, F.col("token"), "hit_rank")
        # A row per token before, with its candidates in order (``most`` at most).
        self.follow = best.groupBy("previous").agg(F.transform(F.sort_array(F.collect_list(F.struct("hit_rank", "token"))), lambda x: x["token"]).alias("next"))
        # The window has no key, but sees ``most`` rows.
        alone = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        first = alone.orderBy(*order).limit(most).withColumn("alone_rank", F.row_number().over(Window.orderBy(*order)))
        self.alone = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("alone_rank", "token"))), lambda x: x["token"]).alias("alone"))

    def rank(self, masked: DataFrame, most: int) -> DataFrame:
        # Most tokens before are hidden and null: their rows are spread over keys that no token has (a word holds no line break).
        spread = F.concat(F.lit("\n"), F.pmod(F.xxhash64(*(c for c in masked.columns if c != "previous")), F.lit(NULL_KEYS)).cast("string"))
        found = masked.withColumn("_key", F.coalesce("previous", spread)).join(self.follow.withColumnRenamed("previous", "_key"), "_key", "left")
        found = found.crossJoin(F.broadcast(self.alone))  # one row
        rank = F.array_position(F.coalesce("next", "alone"), F.col("token")).cast("int")
        return found.withColumn("hit_rank", F.when((rank > 0) & (rank <= most), rank)).drop("_key", "next", "alone")


def pooled_accuracy(paragraphs: DataFrame, ranked: DataFrame, top_k: tuple[int, ...] = TOP_K, n_passes: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(paragraph_id, label, top_k, accuracy, n_masked_total, n_passes) over all passes of each of ``paragraphs``, and its columns ``keep``.

    The candidates' order is found once; each k is a prefix of it. A paragraph without masked tokens has accuracy 1.
    """
    hits = ranked.groupBy("paragraph_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("hit_rank") <= k).alias(f"k{k}") for k in top_k))
    rows = F.array(*(F.struct(F.lit(k).alias("top_k"), F.coalesce(F.col(f"k{k}") / F.col("n"), F.lit(1.0)).alias("accuracy")) for k in top_k))
    joined = paragraphs.select("paragraph_id", "label", *keep).join(hits, "paragraph_id", "left")
    return joined.select("paragraph_id", "label", *keep, F.explode(rows).alias("r"), F.coalesce("n", F.lit(0)).alias("n_masked_total")).select("paragraph_id", "label", "r.top_k", "r.accuracy", "n_masked_total", *keep, F.lit(n_passes).alias("n_passes"))


def overall_accuracy(ranked: DataFrame, top_k: int = 1) -> DataFrame:
    """Share of all masked tokens whose rank is within ``top_k``; 0 without any."""
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.coalesce("hit_rank", F.lit(2**31 - 1)) <= top_k).cast("int")), F.lit(0.0)).alias("accuracy"))


def split_ids(splits: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Ids of a fold's training, tuning or test split, normal ids first: keys, fold_id, class (0, 1), pos, paragraph_id."""
    if name not in STREAMS:
        raise ValueError(f"no split {name}; there are {', '.join(STREAMS)}")
    normal, anomaly = STREAMS[name]
    kept = splits.where(F.col("stream").isin(normal, anomaly))
    return kept.select(*keys, "fold_id", (F.col("stream") == anomaly).cast("int").alias("class"), "pos", "paragraph_id").distinct()


def evaluation_set(ids: DataFrame, paragraphs: DataFrame, in_order: bool = False) -> DataFrame:
    """The paragraphs of ``ids``, which are many beside few folds; ``in_order``: sorted by paragraph_id, as they are read."""
    once = paragraphs.dropDuplicates(["paragraph_id"])
    found = ids.join(once, "paragraph_id")
    return found.orderBy("paragraph_id") if in_order else found


def id_faults(ids: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Per fold: ids without paragraph and ids that stand twice, with the first five of each.

    Columns: keys, fold_id, n_missing, n_repeated, missing, repeated (the LISTED least ids, in order; a null id counts
    as missing and is not listed).
    """
    fold = [*keys, "fold_id"]
    n = ids.groupBy(*fold, "paragraph_id").agg(F.count(F.lit(1)).alias("k"))
    there = n.join(paragraphs.select("paragraph_id").distinct().withColumn("there", F.lit(True)), "paragraph_id", "left")
    missing, twice = F.col("there").isNull(), F.col("k") > 1
    counted = there.groupBy(*fold).agg(F.count_if(missing).alias("n_missing"), F.count_if(twice).alias("n_repeated"))
    for name, fault in (("missing", missing), ("repeated", twice)):
        least = top_rows(there.where(fault & F.col("paragraph_id").isNotNull()), fold, [F.col("paragraph_id")], LISTED, F.col("paragraph_id"), "_nth")
        listed = least.groupBy(*fold).agg(F.sort_array(F.collect_list("paragraph_id")).alias(name))
        counted = counted.join(listed, fold, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return counted.select(*fold, "n_missing", "n_repeated", "missing", "repeated")
