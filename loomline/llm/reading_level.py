"""Problem 10: the reading level of each document, from 1 (easiest) to 5 (hardest).

A Rasch-style model links the level t of a document with the difficulty of the words that occur in it: the log of a
word's share of the occurrences at level t is c_w + s_w * t, s_w being the word's latent difficulty. Alternating
optimisation: given the documents' levels, word difficulties are fitted (Poisson likelihood with a ridge) from counts
per word and level; given these, each document takes the level of greatest likelihood. Both steps run over all
documents; what meets the driver is a table of fixed size, words being hashed into VOCABULARY slots. Rated documents
anchor the scale.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import TABLE_PARTS, summed_table, table_parts, uniform, written
from loomline.llm.prose import sentences

VOCABULARY = 1 << 18
GRID = np.arange(1.0, 5.01, 0.5)
FINE = np.arange(1.0, 5.01, 0.05)
ROUNDS = 2
RIDGE, RATING_SPREAD, LEVEL_SPREAD = 4.0, 0.5, 1.5
#: Ratings from here on are for specialists.
SPECIALIST = 4
LONG_LENGTH = 10
#: Documents with a language label that the language model is fitted on, and words it keeps (the commonest of the sample).
LANGUAGE_SAMPLE, LANGUAGE_WORDS = 5_000, 20_000
#: Languages whose labels begin so are the one sought.
LANGUAGE = "en"
_CHUNK = 4096
_CACHE_WORDS = 500_000
_WORDS = re.compile(r"[^\W\d_]+")


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, own, other): documents of a batch of labelled ones that hold each word; the empty word stands for all."""
    for batch in batches:
        n: dict[str, list[int]] = {}
        for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in {"", *_WORDS.findall("\n".join(sentences(text)).lower())}:
                n.setdefault(w, [0, 0])[not own] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(n.keys(), pa.string()), "own": pa.array([x for x, _ in n.values()], pa.int64()), "other": pa.array([x for _, x in n.values()], pa.int64())})


def language_odds(documents: DataFrame, language: str = LANGUAGE) -> dict[str, float]:
    """Log odds that a document is of the language, by word it holds ("" for the prior): naive Bayes on the labels of a sample.

    Labels (column lang) may be misspelt or wrong for some; the sample is LANGUAGE_SAMPLE documents by a digest of
    their id. Empty where the labels do not name this language and another, or there are none.
    """
    if "lang" not in documents.columns:
        return {}
    label = F.lower(F.trim("lang"))
    labelled = documents.select("doc_id", "text", label.alias("label")).where("doc_id is not null and label <> ''")
    # Counted without the texts, which this way are not read for it.
    n = labelled.agg(F.count(F.lit(1))).first()[0]
    chosen = labelled.where((uniform("doc_id") < LANGUAGE_SAMPLE / max(n, 1)) & F.col("text").isNotNull()).select("text", F.startswith("label", F.lit(language)).alias("own"))
    counts = chosen.mapInArrow(_label_counts, "word string, own bigint, other bigint").groupBy("word").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    rows = counts.orderBy((F.col("own") + F.col("other")).desc(), "word").limit(LANGUAGE_WORDS).collect()
    all_ = next((r for r in rows if r.word == ""), None)
    if all_ is None or not all_.own or not all_.other:
        return {}
    odds = {r.word: math.log((r.own + 0.5) / (all_.own + 1)) - math.log((r.other + 0.5) / (all_.other + 1)) for r in rows if r.word}
    return odds | {"": math.log(all_.own / all_.other)}


def in_language(words: set[str], odds: dict[str, float]) -> bool:
    """Whether the words a document holds speak for the language; where nothing is known of languages, any words do."""
    return bool(words) and (not odds or odds[""] + sum(odds[w] for w in words & odds.keys()) > 0)


def _profile(odds: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in _PROFILE]
            for doc, text, rating in zip(*(c.to_pylist() for c in batch.columns)):
                found = sentences(text)
                words = _WORDS.findall("\n".join(found).lower())
                own = set(words)
                if len(known) > _CACHE_WORDS:
                    known.clear()
                for w in own - known.keys():
                    known[w] = xxhash.xxh32_intdigest(w) % VOCABULARY
                n = len(found)
                size = sum([len(s.split()) for s in found]) / n if n else 0.0
                long = len([1 for w in words if len(w) >= LONG_LENGTH]) / len(words) if words else 0.0
                for c, x in zip(out, (doc, n, size, long, in_language(own, odds), list({known[w] for w in own}), rating)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PROFILE)], schema=_PROFILE)

    return run


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int32()), ("sentence_words", pa.float64()), ("long_share", pa.float64()), ("english", pa.bool_()), ("words", pa.list_(pa.int32())), ("rating", pa.float64())])


class Model:
    """Difficulty of each slot and the log of the normalising sum at each fine level."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: occurrences by slot and grid level."""
        total = counts.sum(0)
        seen = total > 0
        g, t, n = GRID[seen] - GRID.mean(), total[seen], counts[:, seen]
        c, s = np.log((n.sum(1) + 0.01) / max(1.0, t.sum())), np.zeros(len(n))
        for _ in range(8):
            rate = np.exp(np.clip(c[:, None] + s[:, None] * g, -30, 5)) * t
            d0, d1 = (n - rate).sum(1), ((n - rate) * g).sum(1) - RIDGE * s
            h00, h01, h11 = rate.sum(1) + 1e-6, (rate * g).sum(1), (rate * g * g).sum(1) + RIDGE
            det = h00 * h11 - h01**2
            c = c + np.clip((h11 * d0 - h01 * d1) / det, -2, 2)
            s = np.clip(s + np.clip((h00 * d1 - h01 * d0) / det, -1, 1), -6, 6)
        used = n.sum(1) > 0
        self.s = np.where(used, s, 0.0).astype(np.float32)
        self.log_z = np.array([np.log(np.exp(c[used] + s[used] * (x - GRID.mean())).sum() + 1e-300) for x in FINE])

    def levels(self, words: np.ndarray, sizes: np.ndarray, ratings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely levels of documents, whose words lie one after another, and how far others around them are as likely.

        A rating (or NaN) pulls towards itself, others weakly towards the middle. The likelihood of a document needs only
        the sum of its words' difficulties and their number.
        """
        ends = np.concatenate([[0.0], np.cumsum(self.s[words], dtype=np.float64)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        sums = ends[at[1:]] - ends[at[:-1]]
        rated = ~np.isnan(ratings)
        middle, spread = np.where(rated, ratings, 3.0), np.where(rated, RATING_SPREAD, LEVEL_SPREAD)
        fit = sums[:, None] * (FINE - GRID.mean()) - sizes[:, None] * self.log_z - ((FINE - middle[:, None]) / spread[:, None]) ** 2 / 2
        best = FINE[np.argmax(fit, axis=1)]
        chance = np.exp(fit - fit.max(axis=1, keepdims=True))
        return best, np.sqrt((chance * (FINE - best[:, None]) ** 2).sum(1) / chance.sum(1))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another, words of each document, ratings (NaN for none) of a batch (words, rating, ...)."""
    words = batch.column(0)
    return words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False), batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _counts(profiles: DataFrame, model: Model | None, from_length: bool) -> np.ndarray:
    """Occurrences by slot and level over all documents (rated ones where there is no model yet), summed chunk by chunk."""
    levels, width = len(GRID), len(GRID) * _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(VOCABULARY * levels, np.int64)
        for batch in batches:
            words, sizes, ratings = _arrays(batch)
            if model is not None:
                at, _ = model.levels(words, sizes, ratings)
            else:
                length = batch.column(2).to_numpy(zero_copy_only=False)
                at = np.where(np.isnan(ratings), np.clip(1 + (length - 6) / 7, 1.0, 5.0) if from_length else np.nan, ratings)
            step = np.repeat((at - 1) * 2, sizes)
            seen = ~np.isnan(step)
            np.add.at(own, words[seen].astype(np.int64) * levels + np.rint(step[seen]).astype(np.int64), 1)
        yield table_parts(own.reshape(VOCABULARY, levels), width)

    seen = profiles.select("words", "rating", "sentence_words")
    total = summed_table(seen.mapInArrow(count, TABLE_PARTS), seen.rdd.getNumPartitions(), VOCABULARY * levels, width, np.int64)
    return total.reshape(VOCABULARY, levels).astype(np.float64)


def levels(documents: DataFrame, ratings: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, level, spread, n_sentences, sentence_words, long_share, english) of each document with a text and an id, once.

    ``spread`` is the standard error of the level: wide for a text of a few words.

    ``ratings`` (doc_id, rater, level) anchor the scale; their null levels are left out and a document's others averaged.
    Without any rating the scale starts from sentence length. A text without prose gets level 1 with no sentences;
    a document delivered again counts once; an empty table gives an empty result; other columns are ignored. ``english``
    is told by :func:`language_odds`.
    """
    odds = language_odds(documents)
    kept = documents.select("doc_id", "text").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    if ratings is None:
        rated = kept.withColumn("rating", F.lit(None).cast("double"))
    else:
        mean = ratings.where("level is not null").groupBy("doc_id").agg(F.avg("level").alias("rating"))
        rated = kept.join(mean, "doc_id", "left")
    kinds = "doc_id bigint, n_sentences int, sentence_words double, long_share double, english boolean, words array<int>, rating double"
    profiles = written(rated.select("doc_id", "text", "rating").mapInArrow(_profile(odds), kinds), "profiles")
    anchored = profiles.where("rating is not null").limit(1).count() > 0
    model = Model(_counts(profiles, None, not anchored))
    for _ in range(rounds):
        model = Model(_counts(profiles, model, False))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, _ = _arrays(batch)
            # Ratings shaped the scale; here each text speaks for itself.
            at, spread = model.levels(words, sizes, np.full(len(sizes), np.nan))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(sizes > 0, at, 1.0)), pa.array(np.where(sizes > 0, spread, 0.0)), *batch.columns[2:]], names=["level", "spread", *batch.schema.names[2:]])

    told = ("doc_id", "n_sentences", "sentence_words", "long_share", "english")
    out = profiles.select("words", "rating", *told).mapInArrow(place, "level double, spread double, doc_id bigint, n_sentences int, sentence_words double, long_share double, english boolean")
    return out.select("doc_id", "level", "spread", *told[1:])


def sure_level() -> Column:
    """The level a text has at least, but for its standard error."""
    return F.greatest(F.col("level") - F.col("spread"), F.lit(1.0))


def specialist_cut(found: DataFrame, ratings: DataFrame) -> float:
    """The sure level that best parts documents rated SPECIALIST or more from others: fewest misplaced, the middle of ties.

    Read off the counts of rated documents per fine level (a table of fixed size). Without ratings: SPECIALIST - 0.5.
    """
    mean = ratings.where("level is not null").groupBy("doc_id").agg(F.avg("level").alias("rating"))
    counts = found.join(mean, "doc_id").groupBy(F.round(sure_level() * 20).cast("int").alias("at")).agg(F.count_if(F.col("rating") >= SPECIALIST - 0.5).alias("hard"), F.count_if(F.col("rating") < SPECIALIST - 0.5).alias("easy"))
    hard, easy = np.zeros(102), np.zeros(102)
    for r in counts.toLocalIterator():
        hard[r["at"]], easy[r["at"]] = r.hard, r.easy
    if not hard.any() or not easy.any():
        return SPECIALIST - 0.5
    wrong = np.concatenate([[0], np.cumsum(hard)]) + np.concatenate([np.cumsum(easy[::-1])[::-1], [0]])
    best = np.nonzero(wrong == wrong.min())[0]
    return float((best[0] + best[-1]) / 2 - 0.5) / 20


def for_specialists(documents: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the English documents that are surely of specialist level."""
    found = levels(documents, ratings)
    if ratings is not None:
        found = written(found, "levels")
    cut = SPECIALIST - 0.5 if ratings is None else specialist_cut(found, ratings)
    return found.where(F.col("english") & (sure_level() >= cut)).select("doc_id")


def profile_by_source(documents: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Per source (without case and outer spaces) and whole level: documents and their mean level."""
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("(none)"))
    once = documents.where("doc_id is not null").select("doc_id", source.alias("source")).dropDuplicates(["doc_id"])
    got = levels(documents, ratings).join(once, "doc_id")
    return got.groupBy("source", F.round("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("english").alias("n_english"))
