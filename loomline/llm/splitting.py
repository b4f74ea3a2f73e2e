"""Problem 4: paragraphs over a token limit become overlapping pieces under it, cut at natural boundaries.

Recursive separator hierarchy: stage marks, lines, sentences, words, characters. A unit that fits stays whole, one that
does not is split by the next separator; units are then packed greedily, each piece opening with the tail of the one
before. The tail is shortened, at worst left out, where a whole unit would not fit behind it. Tokens are words unless
another measure of a word is given; only then can a word be too large and be cut between characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import word_count

#: Tokens of a word.
Measure = Callable[[str], int]
MAX_LIMITS = 1000


@dataclass(frozen=True)
class Separators:
    """Patterns of the levels above words: ``stage`` is searched in a line that begins one, ``sentence`` in a word that ends one."""

    stage: str = r"(?i)-{3,}\s*(?:phase|stage|step|section)\b.*\bbegins?\b"
    sentence: str = r"[.!?;][\"')\]]*$"


def token_count(lines: Column | str) -> Column:
    """1 + the sum over lines of (words + 1); null lines inside the array count nothing, a null array is one token."""
    kept = F.array_compact(lines)
    return F.lit(1) + F.coalesce(word_count(F.array_join(kept, "\n")) + F.size(kept), F.lit(0))


#: A part of a line: (line number, first word, words). The parts of a word that is cut have its number.
Part = tuple[int, int, list[str]]


class _Splitter:
    def __init__(self, separators: Separators, measure: Measure | None) -> None:
        self.stage, self.sentence, self.measure = re.compile(separators.stage), re.compile(separators.sentence), measure

    def cost(self, words: list[str]) -> int:
        """Tokens of a part: its words and one for the line."""
        return 1 + (len(words) if self.measure is None else sum(map(self.measure, words)))

    def size(self, parts: list[Part]) -> int:
        return sum(self.cost(p[2]) for p in parts)

    def letters(self, word: str, room: int) -> Iterator[str]:
        """A word in stretches of at most ``room`` tokens, each as long as halving finds; a single character stands even if it is more."""
        while word:
            n = len(word)
            while n > 1 and self.measure(word[:n]) > room:
                n = max(1, min(n // 2, n * room // self.measure(word[:n]) + 1) if n > 2 else 1)
            yield word[:n]
            word = word[n:]

    def line(self, n: int, words: list[str], room: int) -> Iterator[Part]:
        """A line in parts of at most ``room`` tokens: as many sentences as fit, or words of a sentence that does not, or letters of such a word."""
        at, rest = 0, words
        while True:
            used, end, last = 1, 0, 0
            for w in rest:
                more = 1 if self.measure is None else self.measure(w)
                if used + more > room:
                    break
                used, end = used + more, end + 1
                if self.sentence.search(w):
                    last = end
            if end == len(rest):
                if rest or not words:
                    yield (n, at, rest)
                return
            end = last or end
            if end:
                yield (n, at, rest[:end])
            else:
                for part in self.letters(rest[0], room - 1):
                    yield (n, at, [part])
                end = 1
            at, rest = at + end, rest[end:]

    def units(self, lines: list[str | None], most: int, room: int) -> Iterator[list[Part]]:
        """Units, largest first choice: whole stages or lines of at most ``most`` tokens, then parts of lines of at most ``room``."""
        stage: list[Part] = []
        stages = [stage]
        for n, line in enumerate(lines):
            if line is None:
                continue
            if stage and self.stage.search(line):
                stage = []
                stages.append(stage)
            stage.append((n, 0, line.split()))
        for stage in stages:
            if self.size(stage) <= most:
                if stage:
                    yield stage
                continue
            for part in stage:
                if self.cost(part[2]) <= most:
                    yield [part]
                else:
                    yield from ([x] for x in self.line(part[0], part[2], max(2, room)))

    def tail(self, piece: list[Part], most_lines: int, most_tokens: int) -> list[Part]:
        """What the next piece repeats: the last whole lines within both bounds, or the last words of a line too long for that."""
        tail: list[Part] = []
        used = 0
        for part in reversed(piece[1:] if len(piece) > 1 else []):
            used += self.cost(part[2])
            if len(tail) == most_lines or used > most_tokens:
                break
            tail.insert(0, part)
        if not tail and most_lines > 0 and most_tokens > 1 and piece:
            n, at, words = piece[-1]
            keep = 0
            while keep < len(words) - 1 and self.cost(words[-keep - 1 :]) <= most_tokens:
                keep += 1
            if keep > 0:
                tail = [(n, at + len(words) - keep, words[-keep:])]
        return tail

    def split(self, lines: list[str | None], limit: int, overlap_lines: int, overlap_tokens: int) -> list[tuple[list[Part], int]]:
        if limit < 3:
            raise ValueError("a piece needs room for three tokens")
        overlap_tokens = max(0, min(overlap_tokens, (limit - 1) // 2))
        # A stage or line that fits a piece stays whole, with less overlap if need be; parts of lines leave room for all of it.
        most, room = limit - 1, limit - 1 - overlap_tokens
        out: list[tuple[list[Part], int]] = []
        piece: list[Part] = []
        size = repeated = 0
        for unit in self.units(lines, most, room):
            more = self.size(unit)
            if piece and 1 + size + more > limit:
                out.append((piece, repeated))
                piece = self.tail(piece, overlap_lines, min(overlap_tokens, most - more))
                size, repeated = self.size(piece), len(piece)
            piece, size = piece + unit, size + more
        if piece:
            out.append((piece, repeated))
        return out


def split(lines: list[str | None], limit: int, overlap_lines: int, overlap_tokens: int, separators: Separators = Separators(), measure: Measure | None = None) -> list[tuple[list[Part], int]]:
    """Pieces of at most ``limit`` tokens, each with the number of its leading parts that repeat the piece before.

    The overlap is at most half a piece. A limit below three tokens raises. Under a ``measure``, a single character of
    more tokens than a piece has room for stands alone.
    """
    return _Splitter(separators, measure).split(lines, limit, overlap_lines, overlap_tokens)


_PIECES = pa.schema([("key", pa.string()), ("backbone", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("n_overlap_lines", pa.int32()), ("n_tokens", pa.int64()), ("lines", pa.list_(pa.string()))])
_KINDS = "key string, backbone string, piece_no int, n_pieces int, first_line bigint, last_line bigint, n_overlap_lines int, n_tokens bigint, lines array<string>"


def _map(separators: Separators, make: Callable[[], Measure] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _Splitter(separators, make() if make else None)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines = r["lines"]
                if make and 1 + splitter.size([(0, 0, x.split()) for x in lines if x is not None]) <= r["max_tokens"]:
                    continue
                pieces = splitter.split(lines, r["max_tokens"], r["overlap_lines"] or 0, r["overlap_tokens"] or 0)
                for n, (parts, repeated) in enumerate(pieces):
                    text = [lines[i] if not at and words == lines[i].split() else " ".join(words) for i, at, words in parts]
                    rows.append((r["key"], r["backbone"], n, len(pieces), parts[0][0], parts[-1][0], repeated, 1 + splitter.size(parts), text))
            columns = list(zip(*rows)) if rows else [[] for _ in _PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return run


def split_oversized(sequences: DataFrame, limits: DataFrame, key: str = "paragraph_id", lines: str = "lines", separators: Separators = Separators(), measure: Callable[[], Measure] | None = None) -> DataFrame:
    """Pieces of the sequences that exceed a backbone's ``max_tokens``; those that fit give no row.

    Columns: key, backbone, piece_no (from 0), n_pieces, first_line, last_line, n_overlap_lines (leading lines or parts
    that repeat the piece before; fewer where a whole stage or line needs the room), n_tokens, lines. A cut falls at a
    stage mark if the stage fits a piece, else between lines, else (one line over the limit) after a sentence, else
    between words. ``measure`` makes, in each task, a function from a word to its tokens (one, if None); words over the
    limit are then cut too. ``limits`` (backbone, max_tokens, overlap_lines, overlap_tokens) is a small fixed table, at
    most MAX_LIMITS rows. Null lines are left out; a null or empty array fits any limit; a sequence delivered again
    counts once; other columns are ignored; empty tables give an empty result.
    """
    known = limits.select("backbone", "max_tokens", "overlap_lines", "overlap_tokens").where("max_tokens is not null").distinct().limit(MAX_LIMITS + 1).collect()
    if len(known) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    sized = sequences.select(F.col(key).cast("string").alias("key"), F.col(lines).alias("lines"), token_count(F.col(lines)).alias("n"))
    kinds = F.array(*(F.struct(*(F.lit(v).cast("string" if n == "backbone" else "bigint").alias(n) for n, v in r.asDict().items())) for r in known))
    if not known:
        kinds = F.expr("cast(array() as array<struct<backbone:string,max_tokens:bigint,overlap_lines:bigint,overlap_tokens:bigint>>)")
    each = sized
    if measure is None:
        # The least limit first, so that most rows leave before they are repeated per backbone.
        each = sized.where(F.col("n") > min((r.max_tokens for r in known), default=0))
    over = each.select("key", "lines", "n", F.explode(kinds).alias("b"))
    over = over.where(F.col("n") > F.col("b.max_tokens")) if measure is None else over.where("lines is not null")
    out = over.select("key", "lines", "b.*").mapInArrow(_map(separators, measure), _KINDS)
    return out.dropDuplicates(["key", "backbone", "piece_no"]).withColumnRenamed("key", key)


def oversized(sequences: DataFrame, limits: DataFrame, key: str = "paragraph_id", lines: str = "lines") -> DataFrame:
    """(key, backbone) of the sequences :func:`split_oversized` had to cut."""
    return split_oversized(sequences, limits, key, lines).where("piece_no = 0 and n_pieces > 1").select(key, "backbone")
