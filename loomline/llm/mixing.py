"""Problem 9: mixes of documents in which each source has its target share, repeated at most so often.

Efraimidis-Spirakis sampling: each document gets the exponential key of its weight; the documents of a source, in order of
key, are summed up to the source's budget. Whole epochs come before the fractional selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import word_count
from loomline.llm.common import running_total, uniform, written

EPSILON = 1e-6


def source_key(col: Column | str) -> Column:
    """Sources compare without case and outer white space; an empty one is none."""
    return F.nullif(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), F.lit(""))


def intactness(text: Column | str) -> Column:
    """A weight in [0.1, 1]: how little of a text is damaged characters."""
    damaged = F.regexp_count(text, F.lit("[\\x{FFFD}ÃÂâ\\x00-\\x08]"))
    return F.greatest(F.lit(0.1), 1.0 - 20.0 * damaged / F.greatest(F.length(text), F.lit(1)))


def _plans(targets: DataFrame) -> DataFrame:
    clean = targets.select("mix_id", "batch_from", "batch_to", "total_words", source_key("source").alias("source"), "target_share", "max_repeats").where("mix_id is not null and source is not null").distinct()
    return clean.withColumn("words_wanted", F.coalesce(F.col("target_share") * F.col("total_words"), F.lit(0.0))).withColumn("most", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)))


def sized(documents: DataFrame, size: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(doc_id, batch_no, source, words, size, weight) of each document once, written for the several passes that use it.

    ``size`` is any column of whole numbers over ``documents`` (words, if None), ``weight`` any positive one (1, if
    None; null or less than 1e-3 counts as 1e-3). Texts are read here and nowhere else.
    """
    kept = documents.where("text is not null and source is not null and doc_id is not null")
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-3))
    sizes = [] if size is None else [F.coalesce(size.cast("bigint"), F.lit(0)).alias("size")]
    rows = kept.select("doc_id", "batch_no", source_key("source").alias("source"), word_count("text").cast("bigint").alias("words"), own.alias("weight"), *sizes).where("source is not null")
    once = rows.dropDuplicates(["doc_id"])
    return written(once.withColumn("size", F.col("words")) if size is None else once, "sized")


def budgets(once: DataFrame, targets: DataFrame) -> DataFrame:
    """The report of each plan and source: mix_id, source, supply, budget, most, epochs, rest, met.

    ``once`` comes from :func:`sized`. ``supply``: size of the source's documents in the plan's batches. Plans count
    words; other sizes get the budget in their own unit, by the size a word has over the plan's documents. ``epochs``
    whole passes are used, then ``rest`` is filled by selection; a source that even ``most`` passes leave below its
    budget is not ``met``. Only sums per source and batch meet the plans. Null texts and sources count never, equal
    texts count each time; an empty table leaves every budget unmet.
    """
    per = once.groupBy(F.col("source").alias("_s"), "batch_no").agg(F.sum("size").alias("size"), F.sum("words").alias("words"))
    plans = _plans(targets)
    on = (plans.source == F.col("_s")) & F.col("batch_no").between(F.col("batch_from"), F.col("batch_to"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = plans.join(per, on, "left").groupBy(*plans.columns).agg(zero("size").alias("supply"), zero("words").alias("supply_words"))
    whole = Window.partitionBy("mix_id")  # the sources of one plan
    unit = F.coalesce(F.try_divide(F.sum("supply").over(whole).cast("double"), F.sum("supply_words").over(whole).cast("double")), F.lit(1.0))
    got = got.withColumn("budget", F.col("words_wanted") * unit)
    met = F.col("most") * F.col("supply") >= F.col("budget") - EPSILON
    epochs = F.when(~met, F.col("most")).when(F.col("supply") > 0, F.least(F.floor((F.col("budget") + EPSILON) / F.col("supply")), F.col("most"))).otherwise(0).cast("int")
    out = got.withColumn("met", met).withColumn("epochs", epochs)
    rest = F.when(F.col("met"), F.greatest(F.col("budget") - F.col("epochs") * F.col("supply"), F.lit(0.0))).otherwise(0.0)
    return out.withColumn("rest", F.when(F.col("epochs") < F.col("most"), rest).otherwise(0.0)).select("mix_id", "batch_from", "batch_to", "source", "supply", "budget", "most", "epochs", "rest", "met")


def _mix(once: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    used = plan.where("epochs > 0 or rest > 0").select("mix_id", "batch_from", "batch_to", "source", "epochs", "rest")
    rows = once.join(used, "source").where("batch_no between batch_from and batch_to")
    keyed = rows.withColumn("key", 1.0 - F.pow(uniform(F.lit(seed), F.col("mix_id"), F.col("doc_id")), 1.0 / F.col("weight")))
    total = running_total(keyed, ["mix_id", "source"], "key", F.col("size"), "doc_id", "before")
    # Without a rest there is no selection, not even of a text of size 0.
    extra = ((F.col("rest") > 0) & ((F.col("before") + F.col("size")) <= F.col("rest") + EPSILON)).cast("int")
    return total.select("mix_id", "source", "doc_id", "size", (F.col("epochs") + extra).alias("repeats")).where("repeats > 0")


def mix(documents: DataFrame, targets: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """(mix_id, source, doc_id, size, repeats): how often each document is used, at most ``max_repeats`` times.

    The key of a document is 1 - u^(1 / weight) with u fixed by seed, plan and id (the exponential key -ln(u) / weight
    on [0, 1)); documents of least key whose running size stays within ``rest`` get one use beyond the whole epochs.
    ``size`` and ``weight``: see :func:`sized`. A document delivered again (same doc_id) counts once.
    """
    once = sized(documents, size, weight)
    return _mix(once, budgets(once, targets), seed)


def reached(documents: DataFrame, targets: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """Per plan and source: budget, the size reached, its share of the mix, and whether the source has no more to give."""
    once = sized(documents, size, weight)
    plan = written(budgets(once, targets), "budgets")
    used = _mix(once, plan, seed).groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("repeats")).alias("reached"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("most_repeats"))
    both = plan.select("mix_id", "source", "budget", "supply", "most", "met").join(used, ["mix_id", "source"], "left")
    all_ = F.sum("reached").over(Window.partitionBy("mix_id"))  # the sources of one plan
    return both.select(
        "mix_id", "source", "budget", "supply", "met",
        F.coalesce("reached", F.lit(0)).alias("reached"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.try_divide("reached", all_), F.lit(0.0)).alias("share_reached"),
        (F.coalesce("reached", F.lit(0)) >= F.col("most") * F.col("supply")).alias("exhausted"),
    )


def short_sources(documents: DataFrame, targets: DataFrame, size: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(mix_id, source) of the sources whose mix uses every document as often as it may and stays below the budget."""
    got = reached(documents, targets, size, weight)
    return got.where(F.col("exhausted") & (F.col("reached") < F.col("budget") - EPSILON)).select("mix_id", "source")
