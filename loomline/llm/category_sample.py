"""Problem 3: samples of paragraphs whose categories have target shares, with a report of those that cannot.

Water-filling gives each cell of a request's (dataset x label) table its share between its minimum and its supply, so
that the cells add up to the sample size. Controlled rounding: these fractional quotas become whole numbers by a maximum
flow that keeps every cell, row and column sum at its floor or ceiling and no cell above its supply; then each cell takes
exactly its quota, by random key.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import running_total, uniform, written

EPSILON = 1e-9
#: Standard deviations (and rows) a bound on keys allows beyond a quota.
MARGIN = 8.0


def _floor(x: float) -> int:
    return math.floor(x + EPSILON)


def max_flow(edges: dict[tuple[object, object], int], source: object, sink: object) -> dict[tuple[object, object], int]:
    """Flow on each edge of a maximum flow, by shortest augmenting paths."""
    left, near = defaultdict(int), defaultdict(set)
    for (a, b), c in edges.items():
        left[a, b] += c
        near[a].add(b)
        near[b].add(a)
    while True:
        back, queue = {source: source}, deque([source])
        while queue and sink not in back:
            a = queue.popleft()
            for b in sorted(near[a], key=str):
                if b not in back and left[a, b] > 0:
                    back[b] = a
                    queue.append(b)
        if sink not in back:
            return {(a, b): c - left[a, b] for (a, b), c in edges.items()}
        path, b = [], sink
        while b != source:
            path.append((back[b], b))
            b = back[b]
        step = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= step
            left[b, a] += step


def water_fill(targets: list[float], lows: list[float], highs: list[float], total: float) -> list[float]:
    """Numbers in proportion to ``targets`` but each from its low to its high, adding up to ``total`` as far as these allow.

    Each is level * target, held within its bounds, at the one level that gives the total. Lows stand even if they
    exceed the total; a cell without target stays at its low.
    """
    low_high = [(t, lo, max(lo, hi)) for t, lo, hi in zip(targets, lows, highs)]
    at = lambda level: [min(hi, max(lo, level * t)) for t, lo, hi in low_high]
    # Between these levels the sum is linear.
    turns = sorted({0.0, *(x / t for t, lo, hi in low_high if t > 0 for x in (lo, hi))})
    below = max((x for x in turns if sum(at(x)) <= total + EPSILON), default=0.0)
    above = min((x for x in turns if x > below), default=None)
    if above is None:
        return at(below)
    a, b = sum(at(below)), sum(at(above))
    return at(below + (above - below) * max(0.0, total - a) / (b - a)) if b > a else at(below)


def controlled_rounding(cells: dict[tuple[object, object], float], supplies: dict[tuple[object, object], int] | None = None) -> dict[tuple[object, object], int]:
    """Whole numbers for a two-way table: every cell, row sum, column sum and the total at its floor or ceiling.

    The floors of the cells stand; what rows, columns and the total lack of their floors flows through cells that have
    a fraction and whose supply (none given: any) allows one more. First the lower bounds are met, then the total is
    raised to its nearest whole number.
    """
    rows, columns = defaultdict(float), defaultdict(float)
    for (r, c), x in cells.items():
        rows[r] += x
        columns[c] += x
    base = {k: _floor(x) for k, x in cells.items()}
    open_ = {k for k, x in cells.items() if x - base[k] > EPSILON and (supplies is None or base[k] < supplies[k])}
    low_r = {r: _floor(x) - sum(v for (a, _), v in base.items() if a == r) for r, x in rows.items()}
    low_c = {c: _floor(x) - sum(v for (_, b), v in base.items() if b == c) for c, x in columns.items()}
    top_r = {r: low_r[r] + (x - _floor(x) > EPSILON) for r, x in rows.items()}
    top_c = {c: low_c[c] + (x - _floor(x) > EPSILON) for c, x in columns.items()}
    total = round(sum(cells.values())) - sum(base.values())
    # Lower bounds become demands of an extra source and sink; a bounded return edge fixes the total.
    edges: dict[tuple[object, object], int] = defaultdict(int)
    s, t, ss, tt = ("s",), ("t",), ("ss",), ("tt",)

    def bounded(a: object, b: object, low: int, top: int) -> None:
        edges[a, b] += top - low
        edges[ss, b] += low
        edges[a, tt] += low

    for r in rows:
        bounded(s, ("row", r), low_r[r], top_r[r])
    for c in columns:
        bounded(("column", c), t, low_c[c], top_c[c])
    for r, c in open_:
        bounded(("row", r), ("column", c), 0, 1)
    bounded(t, s, total, total)
    flow = max_flow(dict(edges), ss, tt)
    return {k: base[k] + (flow.get((("row", k[0]), ("column", k[1])), 0) if k in open_ else 0) for k in cells}


def supply(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``available``: distinct paragraphs of the row's dataset and label in its batches.

    A paragraph that came in several batches counts once: its batches count one each, and each two neighbouring ones
    count minus one for ranges that hold both. Only counts per batch meet the requests.
    """
    per = paragraphs.where("paragraph_id is not null").groupBy("dataset", "label", "paragraph_id").agg(F.sort_array(F.collect_set("batch_no")).alias("b"))
    one = F.transform("b", lambda x: F.struct(x.alias("low"), x.alias("high"), F.lit(1).alias("n")))
    two = F.when(F.size("b") > 1, F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.struct(F.get("b", i - 1).alias("low"), F.get("b", i).alias("high"), F.lit(-1).alias("n"))))
    counts = per.select("dataset", "label", F.explode(F.concat(one, F.coalesce(two, F.array().cast("array<struct<low:bigint,high:bigint,n:int>>")))).alias("x")).groupBy("dataset", "label", "x.low", "x.high").agg(F.sum("x.n").alias("n"))
    kept = requests.columns
    return requests.join(counts.select(F.col("dataset").alias("_d"), F.col("label").alias("_l"), "low", "high", "n"), (requests.dataset == F.col("_d")) & (requests.label == F.col("_l")) & (F.col("low") >= requests.batch_from) & (F.col("high") <= requests.batch_to), "left").groupBy(*kept).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("available"))


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one request (a few categories)."""
    rows = rows.copy()
    targets = [float(s) * n for s, n in zip(rows.target_share, rows.sample_size)]
    lows = [float(min(m, s)) for m, s in zip(rows.min_rows, rows.supply)]
    filled = water_fill(targets, lows, [float(x) for x in rows.supply], float(rows.sample_size.max()))
    keys = [(d, int(label)) for d, label in zip(rows.dataset, rows.label)]
    quota = controlled_rounding(dict(zip(keys, filled)), dict(zip(keys, (int(x) for x in rows.supply))))
    rows["wanted"] = [max(float(m), t) for m, t in zip(rows.min_rows, targets)]
    rows["quota"] = [quota[k] for k in keys]
    return rows


_REQUEST = ("request_id", "seed", "batch_from", "batch_to", "sample_size", "max_normal", "max_anomaly", "dataset", "label", "target_share", "min_rows")


def quotas(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """The report: a row per request and category.

    Columns: request_id, seed, batch_from, batch_to, dataset, label, available, supply (available within the cap),
    wanted (the larger of minimum and share), quota (what is taken: shares between minimum and supply, made whole, that
    add up to the sample size where supplies allow), shortfall (how much the supply lacks of wanted), met (no shortfall).
    What one category lacks or a minimum takes is made up by the others in proportion. A request row delivered again
    counts once; rows with a null dataset or label are left out, other nulls count as no minimum, no share or no cap;
    paragraphs without label fill no category.
    """
    clean = requests.select(*_REQUEST).where("request_id is not null and dataset is not null and label is not null").distinct()
    clean = clean.fillna({"min_rows": 0, "target_share": 0.0, "sample_size": 0})
    found = supply(paragraphs.select("paragraph_id", "dataset", "label", "batch_no"), clean)
    cap = F.when(F.col("label") == 0, F.col("max_normal")).when(F.col("label") == 1, F.col("max_anomaly"))
    capped = found.withColumn("supply", F.least("available", F.coalesce(cap, F.col("available"))))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in capped.schema.fields]
    whole = capped.groupBy("request_id").applyInPandas(_quotas, ", ".join([*names, "wanted double", "quota bigint"]))
    shortfall = F.greatest(F.col("wanted") - F.col("supply"), F.lit(0.0))
    return whole.select(
        "request_id", "seed", "batch_from", "batch_to", "dataset", "label", "available", "supply", "wanted", "quota",
        shortfall.alias("shortfall"), (shortfall <= EPSILON).alias("met"),
    )


def unmet(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, dataset, label) of the categories whose supply is below what is wanted."""
    return quotas(paragraphs, requests).where(~F.col("met")).select("request_id", "dataset", "label")


def sample(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, dataset, label, paragraph_id): exactly ``quota`` paragraphs of each category, those of the least keys.

    The key is a digest of the request's seed and the paragraph's id, so row order and repeated rows do not matter.
    Keys are uniform, so only those under a bound that holds the quota with a wide margin are moved; a category that
    has too few under it is taken up with all its other keys, so the result is the same for any keys.
    """
    cell = ["request_id", "dataset", "label"]
    wanted = written(quotas(paragraphs, requests).where("quota > 0").select(*cell, "seed", "batch_from", "batch_to", "quota", "available"), "quotas")
    margin = F.col("quota") + MARGIN * F.sqrt("quota") + MARGIN
    bounded = wanted.withColumn("bound", F.least(F.lit(1.0), margin / F.col("available")))
    # A row per batch, so that the join is on equal keys and the rows of a data set are spread over their batches.
    rows = paragraphs.select("paragraph_id", "dataset", "label", "batch_no").where("paragraph_id is not null")

    def keyed(cells: DataFrame) -> DataFrame:
        each = cells.where("batch_from <= batch_to").withColumn("batch_no", F.explode(F.sequence("batch_from", "batch_to"))).drop("batch_from", "batch_to", "available")
        return rows.join(each, ["dataset", "label", "batch_no"]).withColumn("key", uniform("seed", "paragraph_id")).drop("batch_no", "seed")

    near = keyed(bounded).where("key < bound").distinct()
    enough = near.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    short = bounded.join(enough, cell, "left").where("bound < 1 and coalesce(n, 0) < quota").drop("n")
    far = keyed(short).where("key >= bound").distinct()
    both = near.unionByName(far).withColumn("place", F.least(F.col("key") / F.col("bound"), F.lit(1.0)))
    # ``place`` only cuts buckets; within one the key itself is the order.
    ranked = running_total(both, cell, "place", F.lit(1), F.struct("key", "paragraph_id"), "before")
    return ranked.where("before < quota").select(*cell, "paragraph_id")
