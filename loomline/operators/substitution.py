"""Words of log lines replaced by a lexicon, keeping case; chained in the lexicon's order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import words

MOST_RULES = 10_000


def keep_case(original: Column, replacement: Column) -> Column:
    """ALL CAPS (more than one letter) and Title case (the rest in lower case) of the original carried over; else lower case."""
    upper = (original == F.upper(original)) & (original != F.lower(original)) & (F.length(original) > 1)
    head, rest = F.substring(original, 1, 1), F.substring(original, F.lit(2), F.length(original))
    title = (head == F.upper(head)) & (head != F.lower(head)) & (rest == F.lower(rest)) & (rest != F.upper(rest))
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, F.lit(2), F.length(replacement))))
    return F.when(upper, F.upper(replacement)).when(title, capital).otherwise(F.lower(replacement))


def is_single_word(lemma: Column) -> Column:
    return F.coalesce((F.length(lemma) > 0) & ~lemma.rlike(r"[_\s\-]"), F.lit(False))


def classify(lexicon: DataFrame) -> DataFrame:
    """``lexicon`` (verb, lemma) with ``kind``: no_lemma, multi_word, identity (case apart) or accepted, the first that fits."""
    lemma = F.col("lemma")
    kind = F.when(lemma.isNull(), "no_lemma").when(~is_single_word(lemma), "multi_word").when(F.lower(lemma) == F.lower("verb"), "identity").otherwise("accepted")
    return lexicon.withColumn("kind", kind)


def top_verbs(paragraphs: DataFrame, lexicon: DataFrame, k: int) -> DataFrame:
    """(verb, n): the ``k`` commonest alphabetic words (lower case) that the lexicon lists as verbs, ties by first use (ord, place)."""
    listed = lexicon.select(F.lower("verb").alias("verb")).distinct()
    tokens = paragraphs.select("ord", F.posexplode(words(F.array_join("lines", "\n"))).alias("at", "t")).select("ord", "at", F.lower("t").alias("verb")).where(F.col("t").rlike("^[A-Za-z]+$"))
    counted = tokens.groupBy("verb").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "at")).alias("first"))
    return counted.join(listed, "verb").orderBy(F.col("n").desc(), "first").limit(k).select("verb", "n")


def substitute(paragraphs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``paragraphs`` with replaced ``lines`` and ``n_replaced``.

    Whole words only, whatever their case; a later rule sees what an earlier one wrote. Rules of words are resolved into
    one look-up per token, so their number does not matter; with others (a key or new text with punctuation) each runs
    as a pattern. Both in Arrow batches, without a shuffle. Null lines stay null.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return paragraphs.withColumn("n_replaced", F.lit(0))
    words_only = all(re.fullmatch(r"\w+", x) for rule in rules for x in rule)
    return _in_batches(paragraphs, _by_token(rules) if words_only else _by_pattern(rules))


def _case(original: str, new: str) -> str:
    """As :func:`keep_case`."""
    rest = original[1:]
    if rest and original == original.upper() != original.lower():
        return new.upper()
    if original != original.lower() and original == original.capitalize() and rest != rest.upper():
        return new.capitalize()
    return new.lower()


#: A line's new text and the number of words replaced in it.
Change = Callable[[str], tuple[str, int]]
_CACHE_WORDS = 500_000


def _by_token(rules: list[tuple[str, str]]) -> Change:
    """A look-up per token. A token takes the first rule that fits, what it gives the first later one that fits that, and so on."""
    places: dict[str, list[int]] = {}
    for n, (verb, _) in enumerate(rules):
        places.setdefault(verb.lower(), []).append(n)
    token, known = re.compile(r"\w+"), {}

    def resolve(word: str) -> tuple[str, int] | None:
        now, used, at = word, 0, -1
        while True:
            at = next((n for n in places.get(now.lower(), ()) if n > at), None)
            if at is None:
                break
            now, used = _case(now, rules[at][1]), used + 1
        if len(known) >= _CACHE_WORDS:
            known.clear()
        known[word] = out = (now, used) if used else None
        return out

    def change(line: str) -> tuple[str, int]:
        hits = [x for w in token.findall(line) if (x := known[w] if w in known else resolve(w))]
        if not hits:
            return line, 0
        return token.sub(lambda m: x[0] if (x := known[m[0]] if m[0] in known else resolve(m[0])) else m[0], line), sum(n for _, n in hits)

    return change


def _by_pattern(rules: list[tuple[str, str]]) -> Change:
    patterns = [(re.compile(rf"\b{re.escape(verb)}\b", re.IGNORECASE), new) for verb, new in rules]

    def change(line: str) -> tuple[str, int]:
        n = 0
        for pattern, new in patterns:
            line, k = pattern.subn(lambda m, new=new: _case(m[0], new), line)
            n += k
        return line, n

    return change


def _in_batches(paragraphs: DataFrame, change: Change) -> DataFrame:
    at = paragraphs.columns.index("lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for lines in batch.column(at).to_pylist():
                done = None if lines is None else [(None, 0) if x is None else change(x) for x in lines]
                out.append(None if done is None else [x for x, _ in done])
                counts.append(sum(n for _, n in done or ()))
            columns = [*batch.columns, pa.array(counts, pa.int32())]
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_replaced"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in paragraphs.schema.fields), "n_replaced int"])
    return paragraphs.mapInArrow(run, schema)


def substitution_counts(replaced: DataFrame) -> DataFrame:
    return replaced.agg(F.count_if(F.col("n_replaced") > 0).alias("modified_paragraphs"), F.coalesce(F.sum("n_replaced"), F.lit(0)).alias("substitutions"))
