"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the byte-level vocabularies: how a text is cut before merging.
# Fixed value: the pattern published with them.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at once; longer texts are cut at a space, where no token of the vocabulary reaches across.
PIECE = 100_000
_CACHE_WORDS, _CACHE_LENGTH = 500_000, 100


def _counter(name: str, data: bytes):
    """A function from a text to its number of tokens, by the kind of file."""
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda text: len(pieces.encode(text))


def cut(text: str, most: int = PIECE) -> list[str]:
    """A text in stretches of about ``most`` characters, cut before spaces that follow a letter; of one, if there are none."""
    out, start = [], 0
    while len(text) - start > most:
        at = start + most
        while (at := text.find(" ", at)) > 0 and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def word_measure(path: str):
    """A maker, for each task, of a function from a word to its tokens (with the space before it), remembering the words it met."""
    data, name = Path(path).read_bytes(), str(path)

    def make():
        count, known = _counter(name, data), {}

        def measure(word: str) -> int:
            n = known.get(word)
            if n is None:
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                n = sum(map(count, cut(" " + word)))
                if len(word) <= _CACHE_LENGTH:
                    known[word] = n
            return n

        return measure

    return make


def token_count(text: str | Column, path: str) -> Column:
    """Tokens of a text column, null for null. The file is read here and travels with the job (a few MB)."""
    data, name = Path(path).read_bytes(), str(path)
    made: list = []

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(_counter(name, data))
        return texts.map(lambda t: None if t is None else sum(map(made[0], cut(t)))).astype("Int64")

    return count(text)
