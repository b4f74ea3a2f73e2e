"""Problem 8: documents that carry a passage of a held-out item.

Prefix-filtered set join on shingles of five words: shingles are ordered by how rare they are in the corpus; of each
item-sized window only the rarest are indexed, as many as a passage with its replaced words can spoil and one more.
Documents look up their shingles, candidates keep to diagonals long enough for a passage, and each such diagonal is
verified word by word. Items are a stated query set; they are taken in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.prose import strip_markup

SHINGLE = 5
LEAST_WORDS, LEAST_SHARE, WORDS_PER_REPLACED = 12, 4, 10
#: Words of the items one pass over the corpus looks for.
BLOCK_WORDS = 500_000
_LEAD = re.compile(r"^[ \t]*(?:(?:>+|\|)[ \t]*)*(?:(?:[-*•+–]|\d{1,3}[.)]|#{1,6}|={2,})[ \t]+)?", re.MULTILINE)
_OTHER = re.compile(r"[\W_]+")
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)")

Words = tuple[str, ...]


def normal_words(text: str) -> list[str]:
    """Words without case, punctuation, mark-up, quote marks and list marks."""
    text = _LEAD.sub("", _LINK.sub(r"\1", strip_markup(text)))
    return [w for x in text.lower().split() if (w := x if x.isascii() and x.isalnum() else _OTHER.sub("", x))]


def shingles_in(words: list[str], wanted: Container[Words], firsts: Container[str]) -> Iterator[tuple[int, Words]]:
    """(position, shingle) of a text's shingles that are ``wanted``; ``firsts`` are the words these begin with."""
    for at, w in enumerate(words):
        if w in firsts and (s := tuple(words[at : at + SHINGLE])) in wanted:
            yield at, s


def item_words(text: str) -> list[str]:
    """An item's words; of a text of two lines the first is an instruction and left out."""
    lines = [x for x in text.strip().splitlines() if x.strip()]
    return normal_words(lines[1] if len(lines) == 2 else text)


def least_length(n: int) -> int:
    """Words a passage of an item of ``n`` words needs."""
    return max(LEAST_WORDS, -(-n // LEAST_SHARE))


def prefix_index(items: dict[int, list[str]], frequency: dict[Words, int]) -> dict[Words, list[tuple[int, int]]]:
    """Shingle -> (item, position) for the shingles that a search must look up.

    A passage of W words has W - 4 shingles, of which replaced words spoil at most 5 * floor(W / 10): one more of the
    rarest must hold an intact one. A passage of twice the least length has a half that qualifies too, so windows of
    less than that suffice.
    """
    out: dict[Words, list[tuple[int, int]]] = defaultdict(list)
    for item, words in items.items():
        n, least = len(words), least_length(len(words))
        shingles = [tuple(words[i : i + SHINGLE]) for i in range(n - SHINGLE + 1)]
        order = [(frequency.get(s, 0), i) for i, s in enumerate(shingles)]
        chosen: set[int] = set()
        for size in range(least, min(2 * least, n + 1)):
            keep = SHINGLE * (size // WORDS_PER_REPLACED) + 1
            for at in range(n - size + 1):
                chosen.update(i for _, i in sorted(order[at : at + size - SHINGLE + 1])[:keep])
        for i in chosen:
            out[shingles[i]].append((item, i))
    return dict(out)


def holds_passage(document: list[str], item: list[str], shift: int) -> bool:
    """Whether, with item position i at document position i + shift, some stretch of enough words has few enough replaced."""
    first, last = max(0, -shift), min(len(item), len(document) - shift)
    least = least_length(len(item))
    if last - first < least:
        return False
    wrong = [0]
    for i in range(first, last):
        wrong.append(wrong[-1] + (item[i] != document[i + shift]))
    n = last - first
    # A stretch of twice the least length has a half that qualifies, so longer ones need no look.
    for size in range(least, min(2 * least, n + 1)):
        most = size // WORDS_PER_REPLACED
        if any(wrong[a + size] - wrong[a] <= most for a in range(n - size + 1)):
            return True
    return False


def _shingle_counts(documents: DataFrame, vocabulary: set[Words]) -> dict[Words, int]:
    """Documents of the whole corpus that hold each shingle of the items (a table as large as the items)."""
    ids = {s: i for i, s in enumerate(sorted(vocabulary))}
    firsts = {s[0] for s in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own.update({ids[s] for _, s in shingles_in(normal_words(text), ids, firsts)})
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(own.keys(), pa.int32()), "n": pa.array(own.values(), pa.int64())})

    got = documents.select("text").mapInArrow(count, "shingle int, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    names = list(ids)
    return {names[r.shingle]: r.n for r in got.toLocalIterator()}


def _blocks(items: DataFrame) -> Iterator[dict[int, list[str]]]:
    block: dict[int, list[str]] = {}
    size = 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        words = item_words(r.text)
        if len(words) < LEAST_WORDS:
            continue
        block[r.item_id] = words
        size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = {}, 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document with a passage of the item, each pair once.

    A passage is a stretch of consecutive item words, at least a quarter of them and at least 12, of which at most one in
    ten is replaced. Null texts and ids are left out, items of fewer than 12 words match nothing, a document or item
    delivered again changes nothing, other columns are ignored; without items or documents the result is empty.
    """
    kept = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    for block in _blocks(items):
        vocabulary = {tuple(w[i : i + SHINGLE]) for w in block.values() for i in range(len(w) - SHINGLE + 1)}
        index = prefix_index(block, _shingle_counts(kept, vocabulary))
        firsts = {s[0] for s in index}

        def find(batches: Iterator[pa.RecordBatch], index=index, block=block, firsts=firsts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, found = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w = normal_words(text)
                    shifts = {(item, at - i) for at, s in shingles_in(w, index, firsts) for item, i in index[s]}
                    hit: set[int] = set()
                    for item, shift in sorted(shifts):
                        if item not in hit and holds_passage(w, block[item], shift):
                            hit.add(item)
                    docs += [doc] * len(hit)
                    found += sorted(hit)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "item_id": pa.array(found, pa.int64())})

        out = out.union(kept.mapInArrow(find, "doc_id bigint, item_id bigint"))
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item of a leak: its suite and split, and the documents that carry it."""
    what = items.select("item_id", "suite", "split").dropDuplicates(["item_id"])
    return leaks(documents, items).join(what, "item_id").groupBy("item_id", "suite", "split").agg(F.count(F.lit(1)).alias("n_documents"))
