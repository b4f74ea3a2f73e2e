"""Which tokens of a paragraph are masked in which pass. All within a row: no shuffle, and any partitioning gives the same."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import words
from loomline.operators.ranking import shuffled

# Fixed values.
LINE_RATIO, TOKEN_RATIO, SEED = 0.5, 0.8, 42
RESERVED, IGNORED = 2, -100
BOS, PAD, EOS, MASK = 0, 1, 2, 3


class Tokenizer(Protocol):
    """Tokens of a line, as a column of string arrays."""

    def __call__(self, line: Column) -> Column: ...


def sample_size(n: Column, share: float) -> Column:
    """max(1, n * share rounded half to even), at most n; 0 of nothing."""
    return F.when(n > 0, F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(float(share))).cast("int")))).otherwise(0)


def _pick(n: Column, share: float, key) -> Column:
    """Sorted places of a seeded sample of 0..n-1."""
    all_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(key(i).alias("k"), i.alias("i"))))
    first = F.slice(F.array_sort(all_), 1, sample_size(n, share))
    return F.coalesce(F.array_sort(F.transform(first, lambda x: x["i"])), F.array().cast("array<int>"))


def _cut(lines: DataFrame, budget: int | None, tokenizer: Tokenizer) -> DataFrame:
    """(paragraph_id, t): the tokens of each line, cut at ``budget`` tokens of the paragraph."""
    tok = F.transform(F.array_compact("lines"), lambda x: tokenizer(x))
    cut = lines.select("paragraph_id", tok.alias("t"))
    if budget is None:
        return cut
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        keep = F.when(acc["at"] < budget, F.concat(acc["out"], F.array(F.slice(t, F.lit(1), F.greatest(F.lit(0), F.least(F.size(t), F.lit(budget) - acc["at"])))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.size(t)).alias("at"), keep.alias("out"))

    return cut.select("paragraph_id", F.aggregate("t", zero, step)["out"].alias("t"))


def boundaries(lines: DataFrame, budget: int | None, tokenizer: Tokenizer = words) -> DataFrame:
    """(paragraph_id, line_no, tokens): lines cut at ``budget`` tokens of their paragraph.

    A line that begins at or past the budget ends the paragraph, one that straddles it is clipped, one without tokens
    before it stays.
    """
    return _cut(lines, budget, tokenizer).select("paragraph_id", F.posexplode("t").alias("line_no", "tokens"))


def flattened(lines: DataFrame, budget: int | None, tokenizer: Tokenizer = words) -> DataFrame:
    """(paragraph_id, tokens, spans): the cut paragraph as one array of tokens, and (start, end) of each line in it (end excluded)."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda acc, t: F.struct((acc["at"] + F.size(t)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.size(t)).alias("end")))).alias("out"))
    return _cut(lines, budget, tokenizer).select("paragraph_id", F.flatten("t").alias("tokens"), F.aggregate("t", zero, step)["out"].alias("spans"))


def masked_positions(paragraphs: DataFrame, n_passes: int = 1, seed: int = SEED, limit: int | None = None, line_ratio: float = LINE_RATIO, token_ratio: float = TOKEN_RATIO, tokenizer: Tokenizer = words) -> DataFrame:
    """(paragraph_id, pass, line_no, pos, token, previous): the masked tokens of each pass.

    Half the lines, then most of each chosen line's tokens, at least one of each. ``limit`` is the backbone's, of which
    two tokens are reserved. ``previous`` is the token before in the line if it is visible, else null. A paragraph
    without tokens, or with null lines, gives no row.
    """
    budget = None if limit is None else limit - RESERVED
    # The lines of a paragraph are kept together; cutting is per row as well.
    rows = _cut(paragraphs, budget, tokenizer)
    each = rows.select("paragraph_id", "t", F.explode(F.sequence(F.lit(0), F.lit(n_passes - 1))).alias("pass"))
    line_key = lambda i: shuffled(F.lit(seed), F.concat_ws(":", F.col("pass"), F.col("paragraph_id"), i))
    chosen = each.select("paragraph_id", "pass", "t", F.explode(_pick(F.size("t"), line_ratio, line_key)).alias("line_no"))
    line = chosen.select("paragraph_id", "pass", "line_no", F.get(F.col("t"), F.col("line_no")).alias("tokens"))
    token_key = lambda i: shuffled(F.lit(seed), F.concat_ws(":", F.col("pass"), F.col("paragraph_id"), F.col("line_no"), i))
    picked = line.withColumn("at", _pick(F.size("tokens"), token_ratio, token_key))
    out = picked.select("paragraph_id", "pass", "line_no", "tokens", "at", F.explode("at").alias("pos"))
    seen = ~F.array_contains("at", F.col("pos") - 1) & (F.col("pos") > 0)
    return out.select("paragraph_id", "pass", "line_no", "pos", F.get("tokens", F.col("pos")).alias("token"), F.when(seen, F.get("tokens", F.col("pos") - 1)).alias("previous"))


def masked_example(ids: Column, masked: Column) -> tuple[Column, Column, Column]:
    """input_ids, labels and attention_mask of token ids and the places masked among them, wrapped in end marks."""
    hit = lambda i: F.array_contains(masked, i)
    one = lambda x: F.array(F.lit(x))
    inputs = F.concat(one(BOS), F.transform(ids, lambda x, i: F.when(hit(i), MASK).otherwise(x)), one(EOS))
    labels = F.concat(one(IGNORED), F.transform(ids, lambda x, i: F.when(hit(i), x).otherwise(IGNORED)), one(IGNORED))
    return inputs, labels, F.transform(inputs, lambda _: F.lit(1))


def padded(examples: DataFrame, batch: str) -> DataFrame:
    """Examples (batch, input_ids, labels, attention_mask) padded to the longest of their batch; ragged rows raise."""
    n = F.size("input_ids")
    ragged = (F.size("labels") != n) | (F.size("attention_mask") != n)
    longest = examples.groupBy(batch).agg(F.max(n).alias("_n"))
    pad = lambda c, x: F.when(ragged, F.raise_error(F.lit("an example's arrays differ in length"))).otherwise(F.concat(F.col(c), F.array_repeat(F.lit(x), (F.col("_n") - n).cast("int")))).alias(c)
    rest = [c for c in examples.columns if c not in ("input_ids", "labels", "attention_mask")]
    return examples.join(longest, batch).select(*rest, pad("input_ids", PAD), pad("labels", IGNORED), pad("attention_mask", 0))
