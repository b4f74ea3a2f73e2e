"""Problem 2: runs of one event in ordered lines become one line with their length and duration.

Optimal segmentation by pruned dynamic programming: of all cuts of a sequence into runs, the one of least dissimilarity
within runs plus ``PENALTY`` a run. Two measures of a run:

* :func:`runs` sums the dissimilarity of each line to the one before. Lines of the same event cost their share of edits
  (less than the penalty), others ``DIFFERENT``, so the optimum is the coarsest cut into chains of the same event.
* :func:`collapse` sums, within each of these chains, the dissimilarity of each line to one event that stands for the run,
  the best there is in the chain. A chain that drifts away from any single event is cut where that is cheapest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a run costs, and a line that is another event than what it is compared with: more than two boundaries, so no run takes such a line in.
PENALTY, DIFFERENT = 1.0, 3.0
#: A pair of words that differ: their least length and the most edits between them.
LEAST_LENGTH, MOST_EDITS = 5, 2
# Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGIT = re.compile("[0-9]")
_CACHE_WORDS = 200_000


class _Normal:
    """Words in normal form: lower case, no outer punctuation, anything with a digit as one mark; None for mere punctuation."""

    def __init__(self) -> None:
        self.known: dict[str, str | None] = {}

    def of(self, word: str) -> str | None:
        bare = word.lower().strip(PUNCTUATION)
        out = ("\0" if _DIGIT.search(bare) else bare) if bare else None
        if len(self.known) >= _CACHE_WORDS:
            self.known.clear()
        self.known[word] = out
        return out

    def line(self, text: str | None) -> tuple[str, ...]:
        if not text:
            return ()
        known = self.known
        return tuple([n for w in text.split() if (n := known[w] if w in known else self.of(w)) is not None])


def edits_within(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance if it is at most ``most``, else None."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        low = i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            low = min(low, row[j])
        if low > most:
            return None
    return row[-1] if row[-1] <= most else None


def dissimilarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """0 for the same words, the share of edited characters for one near pair, ``DIFFERENT`` for anything else or no words."""
    if not a or not b or len(a) != len(b):
        return DIFFERENT
    if a == b:
        return 0.0
    pair = None
    for x, y in zip(a, b):
        if x != y:
            if pair is not None or x == "\0" or y == "\0" or len(x) < LEAST_LENGTH or len(y) < LEAST_LENGTH:
                return DIFFERENT
            pair = (x, y)
    n = edits_within(*pair, MOST_EDITS)
    return DIFFERENT if n is None else n / max(map(len, pair))


def segment(costs: list[float], penalty: float = PENALTY) -> list[int]:
    """First positions of the runs of an optimal segmentation of n lines; ``costs[i]`` joins line i to line i - 1.

    best[t] = min over s of best[s] + cost of s..t-1 + penalty. Costs are additive, so of two starts the one that is
    cheaper now stays cheaper for every later end, and the other is pruned: one old start and the newest remain.
    Ties go to the earlier start, which means fewer runs.
    """
    n = len(costs)
    cut = [0] * (n + 1)
    start, cost, newest = 0, 0.0, -penalty  # newest: best[t - 1], the price of starting at t - 1
    for t in range(1, n + 1):
        cost += costs[t - 1]
        if t == 1 or newest < cost:
            start, cost = t - 1, newest
        cut[t] = start
        newest = cost + penalty
    return _starts(cut)


def _starts(cut: list[int]) -> list[int]:
    out, t = [], len(cut) - 1
    while t > 0:
        t = cut[t]
        out.append(t)
    return out[::-1]


class _Events:
    """Events of one chain or sequence as numbers, and how far each is from those near it; lines without words are all different."""

    def __init__(self, events: list[tuple[str, ...]]) -> None:
        known: dict[tuple[str, ...], int] = {}
        self.of = [known.setdefault(e, len(known)) if e else -1 - i for i, e in enumerate(events)]
        # Near events have as many words and differ in one, so they meet under a key of all words but that one: a sum of
        # hashes less its own. Events that meet by chance are told apart by their words.
        meet: dict[tuple[int, int, int], list[int]] = {}
        self.near: dict[int, dict[int, float]] = {k: {k: 0.0} for k in self.of}
        words = list(known)
        for b, e in enumerate(words):
            own = [hash((i, w)) for i, w in enumerate(e)]
            total = sum(own)
            for i, w in enumerate(e):
                if len(w) >= LEAST_LENGTH and w != "\0":
                    others = meet.setdefault((i, len(e), total - own[i]), [])
                    for a in others:
                        d = dissimilarity(words[a], e)
                        if d < DIFFERENT:
                            self.near[a][b] = self.near[b][a] = d
                    others.append(b)


def segment_by_event(events: _Events, penalty: float = PENALTY) -> list[int]:
    """First positions of the runs of an optimal segmentation, a run costing the dissimilarity of its lines to one event.

    That event may be any of those given, so cutting a run never makes it dearer, and a start that is dearer at t than
    best[t] is pruned for good. ``price`` of a live start holds what the run up to now would cost by each event that is
    near some line of it; any other costs ``DIFFERENT`` a line. Ties go to the earlier start.
    """
    n = len(events.of)
    best, cut = [-penalty] + [0.0] * n, [0] * (n + 1)
    live: list[tuple[int, dict[int, float]]] = []
    for t in range(1, n + 1):
        line = events.of[t - 1]
        near = events.near[line]
        live.append((t - 1, {}))
        at, low = t - 1, None
        costs = []
        for start, price in live:
            length = t - 1 - start
            for e in price:
                if e not in near:
                    price[e] += DIFFERENT
            for e, d in near.items():
                price[e] = price.get(e, DIFFERENT * length) + d
            cost = best[start] + min(price.values())
            costs.append(cost)
            if low is None or cost < low - 1e-12:
                at, low = start, cost
        cut[t], best[t] = at, low + penalty
        live = [x for x, cost in zip(live, costs) if cost < best[t] - 1e-12]
    return _starts(cut)


def _runs(lines: list[str | None], normal: _Normal, by_event: bool) -> list[tuple[int, int]]:
    events = [normal.line(x) for x in lines]
    first = segment([DIFFERENT] + [dissimilarity(a, b) for a, b in zip(events, events[1:])])
    if by_event:
        # Lines that are another event than the one before are never of one run, so each chain is cut by itself.
        chains = zip(first, [*first[1:], len(events)])
        first = [a + x for a, b in chains for x in (segment_by_event(_Events(events[a:b])) if len(set(events[a:b])) > 1 else [0])]
    return list(zip(first, [x - 1 for x in first[1:]] + [len(lines) - 1]))


def _map(least: int, whole: bool):
    """Runs of at least ``least`` lines; ``whole``: by one event, with the first and last line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = _Normal()
        for batch in batches:
            keys, first, last, opening, closing = [], [], [], [], []
            for key, lines in zip(batch.column(0), batch.column(1).to_pylist()):
                for a, b in _runs(lines, normal, whole) if lines else ():
                    if b - a + 1 >= least:
                        keys.append(key.as_py())
                        first.append(a)
                        last.append(b)
                        if whole:
                            opening.append(lines[a])
                            closing.append(lines[b])
            out = {"key": pa.array(keys, pa.string()), "first_line": pa.array(first, pa.int64()), "last_line": pa.array(last, pa.int64())}
            if whole:
                out |= {"line": pa.array(opening, pa.string()), "last_text": pa.array(closing, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def runs(sequences: DataFrame, key: str = "paragraph_id", lines: str = "lines", least: int = 2) -> DataFrame:
    """(key, first_line, last_line): each maximal run of at least ``least`` lines, as 0-based positions.

    A sequence delivered again gives the same rows and they are kept once. Null or empty ``lines`` give no run, a null
    or blank line is no event and stands alone, other columns are ignored, an empty table gives an empty result.
    """
    found = sequences.select(F.col(key).cast("string").alias("key"), F.col(lines).alias("lines")).where("lines is not null")
    out = found.mapInArrow(_map(least, False), "key string, first_line bigint, last_line bigint")
    return out.distinct().withColumnRenamed("key", key)


def collapse(sequences: DataFrame, key: str = "paragraph_id", lines: str = "lines") -> DataFrame:
    """One row per run, also of single lines: its first line, number of lines and seconds from first to last.

    Runs are those of one event (see above). The time of a line is that of its first two words: Unix seconds, or ddmmyy
    hhmmss; ``seconds`` is null where either end has none. Lines out of time order may give negative seconds. Null or
    empty ``lines`` give no row; a sequence delivered again counts once (with other lines under the same key, the run of
    a place is that of the least text).
    """
    found = sequences.select(F.col(key).cast("string").alias("key"), F.col(lines).alias("lines")).where("lines is not null")
    out = found.mapInArrow(_map(1, True), "key string, first_line bigint, last_line bigint, line string, last_text string")

    def at(text: str):
        word = lambda n: F.regexp_extract(text, r"^\s*(\S+)\s+(\S+)", n)
        short = F.try_to_timestamp(F.nullif(F.concat(word(1), word(2)), F.lit("")), F.lit("ddMMyyHHmmss"))
        return F.coalesce(F.when(word(1).rlike(r"^[0-9]{10}$"), word(1).try_cast("bigint")), F.unix_seconds(short.cast("timestamp")))

    timed = out.select("key", "first_line", "last_line", "line", (at("last_text") - at("line")).alias("seconds"))
    # Repeated deliveries meet where they lie first; only one row a run is moved.
    once = timed.groupBy("key", "first_line").agg(F.min(F.struct("line", "last_line", "seconds")).alias("r"))
    return once.select(F.col("key").alias(key), "first_line", "r.last_line", (F.col("r.last_line") - F.col("first_line") + 1).alias("n_lines"), "r.line", "r.seconds")
