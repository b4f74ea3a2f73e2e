"""Problem 6: records of evaluation splits that also occur, exactly or almost, in the training split.

Records are canonicalised and hashed; equal hashes make a class of copies, and evaluation and training sides meet through
their class. Hashes alone cannot find records that are almost the same, so classes are also joined by a prefix-filtered
set-similarity join over their words (each repeated word counted): two records that share 80 % of the longer one's words
share a word among the rarest fifth of each. Rarity is that of the whole table, held in a count sketch of fixed size; any order
gives the same result, a better one fewer candidates. A bitmap of 256 bits drops candidates that cannot reach the
share, and the rest are verified word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import TABLE_PARTS, summed_table, table_parts, written

#: Share of the longer record's words, as a fraction.
SHARE = (4, 5)
SKETCH = 1 << 22
_CHUNK = 4096
#: Ids that are broadcast at most (about 20 MB).
MAX_BROADCAST_IDS = 250_000
_CACHE_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
TRAIN, TEST = ("train_normal_ids",), ("test_normal_ids", "test_anomaly_ids")


class _Tokens:
    """64-bit numbers of a record's words, the k-th use of a word having its own."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, lines: list[str | None]) -> np.ndarray:
        words = Counter(w for x in lines if x for w in x.lower().split()[2:])
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        known = self.known
        hashes = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
        times = np.fromiter(words.values(), np.int64, len(words))
        if len(words) == times.sum():
            return hashes
        first = np.cumsum(times) - times
        use = (np.arange(times.sum()) - np.repeat(first, times)).astype(np.uint64)
        out = np.repeat(hashes, times) + use * _MIX
        return out ^ (out >> np.uint64(29)) * (use > 0)


def canonical_words(lines: list[str | None]) -> list[str]:
    """Words in lower case, without the first two of each line."""
    return [w for x in lines if x for w in x.lower().split()[2:]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, tokens = np.zeros(SKETCH, np.uint32), _Tokens()
    for batch in batches:
        for lines in batch.column(0).to_pylist():
            np.add.at(own, (tokens.of(lines) % np.uint64(SKETCH)).astype(np.int64), 1)
    yield table_parts(own, _CHUNK)


def _frequency(records: DataFrame) -> np.ndarray:
    """Uses of each sketch slot over all records, as SKETCH 32-bit counts (16 MB, whatever the table's size)."""
    lines = records.select("lines")
    return summed_table(lines.mapInArrow(_count, TABLE_PARTS), lines.rdd.getNumPartitions(), SKETCH, _CHUNK, np.uint32)


_SIGNATURE = "id string, class binary, n int, prefix array<bigint>, b0 bigint, b1 bigint, b2 bigint, b3 bigint"


def _sign(frequency):
    schema = pa.schema([("id", pa.string()), ("class", pa.binary()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), *((f"b{i}", pa.int64()) for i in range(4))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, count = _Tokens(), frequency.value
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = tokens.of(lines)
                n = len(t)
                if n == 0:
                    continue
                use = count[(t % np.uint64(SKETCH)).astype(np.int64)]
                order = np.lexsort((t, use))[: n - -(-n * SHARE[0] // SHARE[1]) + 1]
                # A slot used once is a word no other record has; it keeps its place but need not be looked up.
                prefix = np.where(use[order] > 1, t[order].view(np.int64), 0)
                bits = np.zeros(256, np.uint8)
                bits[(t >> np.uint64(56)).astype(np.int64)] = 1
                row = (key, xxhash.xxh3_128_digest(np.sort(t).tobytes()), n, prefix, *np.packbits(bits).view(np.int64))
                for c, x in zip(out, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return sign


#: A fold's bit (folds 62 apart share one: the mask only rules pairs out).
_FOLD_BIT = "shiftleft(1L, cast(pmod(fold_id, 62) as int))"


def signatures(records: DataFrame) -> DataFrame:
    """(id, class, n, prefix, b0..b3) of each record with words, once: hash of its canonical form, rarest words, bitmap."""
    kept = records.where("id is not null and lines is not null").select("id", "lines")
    frequency = records.sparkSession.sparkContext.broadcast(_frequency(kept))
    return kept.mapInArrow(_sign(frequency), _SIGNATURE).dropDuplicates(["id"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, words = [], None, Counter()
        for a, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
            if a != last:
                last, words = a, Counter(canonical_words(x))
            other = Counter(canonical_words(y))
            shared = sum(min(n, words[w]) for w, n in other.items() if w in words)
            keep.append(shared * SHARE[1] >= SHARE[0] * max(words.total(), other.total()))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2])


def near_classes(classes: DataFrame, records: DataFrame) -> DataFrame:
    """(block, a, b), a < b: records of one block that share enough words and stand on opposite sides of some fold.

    ``classes``: num, block, id, n, prefix, b0..b3, train, test (fold masks), one row per class of copies; num is any
    number of its own. Words meet as one hash of block and word with that number alone; what else a pair needs is
    joined once per pair. A collision of hashes only adds a candidate.
    """
    words = classes.select("num", "n", F.posexplode("prefix").alias("at", "word"), "block").where("word <> 0").select("num", "n", "at", F.xxhash64("block", "word").alias("key"))
    a, b = (words.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("num", "n", "at"))) for s in "ab")
    need = lambda n: F.floor((n * SHARE[0] + SHARE[1] - 1) / SHARE[1])
    longer = F.greatest("n_a", "n_b")
    met = (
        a.join(b, "key")
        .where(F.col("num_a") < F.col("num_b"))
        .where(F.least("n_a", "n_b") * SHARE[1] >= longer * SHARE[0])
        # Where a pair meets first, no earlier word of either is shared: what is left must be enough.
        .where(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need(longer))
        .select("num_a", "num_b")
        .distinct()
    )
    own = ("block", "id", "n", "b0", "b1", "b2", "b3", "train", "test")
    facts = lambda s: classes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("num", *own)))
    both = met.join(facts("a"), "num_a").join(facts("b"), "num_b").where("block_a = block_b")
    opposite = both.where("(train_a & test_b) | (test_a & train_b) <> 0")
    # Each bit that only one side has is a word the other lacks.
    lone = lambda x, y: " + ".join(f"bit_count(b{i}_{x} & ~b{i}_{y})" for i in range(4))
    possible = opposite.where((F.col("n_a") - F.expr(lone("a", "b")) >= need(longer)) & (F.col("n_b") - F.expr(lone("b", "a")) >= need(longer)))
    pairs = written(possible.select(F.col("block_a").alias("block"), F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    # Few ids beside the records: broadcast after counting them; past the bound the records are shuffled to them.
    if wanted.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = written(records.join(wanted, "id", "left_semi").select("id", "lines").dropDuplicates(["id"]), "texts")
    full = pairs.join(texts.select(F.col("id").alias("b"), F.col("lines").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("lines").alias("x")), "a")
    return full.select("block", "a", "b", "x", "y").mapInArrow(_verify, "block string, a string, b string")


def _sides(paragraphs: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows (block, fold_id, of_train, id_train), test rows (block, fold_id, of_test, id_test, stream) and ways (block, of_train, of_test).

    ``of`` is the id that stands for all copies of a record; a way leads from one to a nearly equal one, in both directions.
    """
    side = F.when(F.col("stream").isin(*TRAIN), "train").when(F.col("stream").isin(*TEST), "test")
    rows = splits.withColumn("side", side).where("side is not null and artifact_id is not null and fold_id is not null and paragraph_id is not null")
    rows = rows.select(F.col("artifact_id").alias("block"), "fold_id", "side", "stream", F.col("paragraph_id").alias("id")).distinct()
    mask = lambda s: F.coalesce(F.bit_or(F.when(F.col("side") == s, F.expr(_FOLD_BIT))), F.lit(0).cast("bigint")).alias(s)
    roles = rows.groupBy("block", "id").agg(mask("train"), mask("test"))
    records = paragraphs.select(F.col("paragraph_id").alias("id"), "lines").where("id is not null and lines is not null")
    signed = written(roles.join(signatures(records), "id"), "signatures")
    copies = signed.groupBy("block", "class").agg(
        F.min("id").alias("id"),
        *(F.min_by(c, "id").alias(c) for c in ("n", "prefix", "b0", "b1", "b2", "b3")),
        F.bit_or("train").alias("train"),
        F.bit_or("test").alias("test"),
    )
    classes = written(copies.withColumn("num", F.monotonically_increasing_id()), "classes")
    near = written(near_classes(classes, records), "near")
    # Every id with the class that stands for it; ids without words stand for themselves.
    first = classes.select("block", "class", F.col("id").alias("of"))
    standing = signed.select("block", "class", "id").join(first, ["block", "class"]).where("id <> of").select("block", "id", "of")
    placed = rows.join(standing, ["block", "id"], "left").withColumn("of", F.coalesce("of", "id"))
    train = placed.where("side = 'train'").select("block", "fold_id", F.col("of").alias("of_train"), F.col("id").alias("id_train"))
    test = placed.where("side = 'test'").select("block", "fold_id", F.col("of").alias("of_test"), F.col("id").alias("id_test"), "stream")
    ways = near.select("block", F.col("a").alias("of_train"), F.col("b").alias("of_test")).union(near.select("block", "b", "a"))
    return train, test, ways


def overlaps(paragraphs: DataFrame, splits: DataFrame) -> DataFrame:
    """(artifact_id, fold_id, paragraph_id_a, paragraph_id_b, stream, id_test): pairs with one id in training, the other in a test stream.

    Same or nearly: without the first two words of each line and letter case, they share at least 80 % of the words of the
    longer one. a <= b; an id on both sides pairs with itself, also if its lines are null or it has no words (it then
    pairs with nothing else). Rows delivered again and repeated split rows count once; null ids and folds are left out;
    other columns are ignored; empty tables give an empty result.
    """
    train, test, ways = _sides(paragraphs, splits)
    almost = train.join(ways, ["block", "of_train"]).join(test, ["block", "fold_id", "of_test"])
    same = train.join(test.withColumnRenamed("of_test", "of_train"), ["block", "fold_id", "of_train"])
    shape = (F.col("block").alias("artifact_id"), "fold_id", F.least("id_train", "id_test").alias("paragraph_id_a"), F.greatest("id_train", "id_test").alias("paragraph_id_b"), "stream", "id_test")
    return almost.select(*shape).union(same.select(*shape))


def found(paragraphs: DataFrame, splits: DataFrame) -> DataFrame:
    """(artifact_id, fold_id, paragraph_id_a, paragraph_id_b) of :func:`overlaps`, each pair once."""
    return overlaps(paragraphs, splits).select("artifact_id", "fold_id", "paragraph_id_a", "paragraph_id_b").distinct()


def overlapping_ids(paragraphs: DataFrame, splits: DataFrame) -> DataFrame:
    """(artifact_id, fold_id, stream, paragraph_id): test ids that :func:`overlaps` pairs with any training id of the fold, each once."""
    train, test, ways = _sides(paragraphs, splits)
    # Only whether a class is trained on counts, so a group of copies is not multiplied out.
    trained = train.select("block", "fold_id", "of_train").distinct()
    near = trained.join(ways, ["block", "of_train"]).select("block", "fold_id", F.col("of_test"))
    reached = trained.withColumnRenamed("of_train", "of_test").select("block", "fold_id", "of_test").union(near).distinct()
    met = test.join(reached, ["block", "fold_id", "of_test"], "left_semi")
    return met.select(F.col("block").alias("artifact_id"), "fold_id", "stream", F.col("id_test").alias("paragraph_id")).distinct()


def _datasets(paragraphs: DataFrame, key: str) -> DataFrame:
    return paragraphs.where("paragraph_id is not null").groupBy(F.col("paragraph_id").alias(key)).agg(F.min("dataset").alias("dataset"))


def per_stream(paragraphs: DataFrame, splits: DataFrame) -> DataFrame:
    """Per test stream and dataset of the test paragraph: overlapping test ids, counted once per fold."""
    ids = overlapping_ids(paragraphs, splits).join(_datasets(paragraphs, "paragraph_id"), "paragraph_id", "left")
    return ids.groupBy("dataset", "stream").agg(F.count(F.lit(1)).alias("n_ids"))


def pairs_per_stream(paragraphs: DataFrame, splits: DataFrame) -> DataFrame:
    """Per test stream and dataset of the test paragraph: pairs, counted once per fold."""
    pairs = overlaps(paragraphs, splits).join(_datasets(paragraphs, "id_test"), "id_test", "left").drop("id_test").distinct()
    return pairs.groupBy("dataset", "stream").agg(F.count(F.lit(1)).alias("n_pairs"))
