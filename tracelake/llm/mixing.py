"""Mixing sources to target weights by hash thresholds.

Method (hash-threshold histograms).  A document has a fixed hash; a source takes all its
documents ``floor(target / size)`` times and once more those below a threshold.  The
threshold is nested: token sums by source and the hash's leading 12 bits give the bucket in
which the rest of the target runs out, sums of that bucket's documents by the next 12 bits
refine it, then the last 12.  Only boundary buckets are refined, nothing is sorted, and a
larger budget always takes a superset.  One row a source and bucket is shuffled, summed
before, so a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import native
from .storage import keep

LEVELS, BITS = 3, 12
WEIGHTS = (3, 1, 2)


def document_hash(doc_id: Column, text: Column) -> Column:
    """36 bits of a hash of the id, or of the text where there is no id; SQL engines share it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), native.text_or_empty(text)))), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, size)`` rows -> ``(source, source_size, target)``.

    Sources by code point, null last, weigh ``weights``, repeating.  Targets sum to
    ``share`` of all sizes; one that would exceed ``most`` times its source's size stops
    there and the excess is shared out again by weight: each gets its weight times a common
    level, or its limit, and the level follows from the sources by limit per weight.
    One row a source is sorted, not one a document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"budget": F.sum("source_size").over(everything) * F.lit(float(share)), "all_w": F.sum("w").over(everything)})
    s = s.withColumns({"stopped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "stopped_w": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    level = (F.col("budget") - F.col("stopped")) / (F.col("all_w") - F.col("stopped_w"))
    # stopping a source raises the level while its limit is below it, and lowers it from then on
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least("limit", F.col("level") * F.col("w")).alias("target"))


def hash_threshold_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How many words of each document a mix takes: ``doc_id, size, source_size, target, taken``.

    A row for each row of ``docs``.  ``size`` counts the words of the whole text, 0 for
    null.  ``taken`` is a whole multiple of ``size``, at most ``most`` (rounded up) times;
    the document on a source's threshold goes the way that ends nearer the target.  The same
    rows give the same mix, whatever their order or partitioning.  A null source is a source
    of its own, last.  Rows without an id are told apart by their texts; rows that share an
    id, or without one a text, go together.  An empty table gives none.  Other columns are ignored, whatever their names.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    out = sizes.join(mix_limits(sizes, share, most, weights), F.col("source").eqNullSafe(F.col("src")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"))).alias("taken"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.size(native.words(F.col(text_col))).cast("long")
    doc = F.col(id_col).cast("long")
    return keep(docs.select(doc.alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), document_hash(doc, F.col(text_col)).alias("h")), "mix-sizes")


def mix_limits(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, size, h)`` rows -> ``(src, source_size, target, copies, threshold)``: a document is taken ``copies`` times, and once more if its hash is below ``threshold``."""
    targets = source_targets(sizes, share, most, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # of each source: budget left for a further copy, and the hash prefix found so far
    state = targets.select("*", whole.alias("copies")).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    state = keep(state, "mix-level")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        below = F.shiftright("h", shift)
        inside = sizes.alias("d").join(state.select(F.col("source").alias("src"), "prefix"), F.col("source").eqNullSafe(F.col("src")))
        inside = inside.where(F.shiftright("h", shift + BITS) == F.col("prefix")) if level else inside
        sums = inside.groupBy("source", below.alias("bucket")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(w)).join(state.select(F.col("source").alias("src"), "budget"), F.col("source").eqNullSafe(F.col("src")))
        # the first bucket that reaches the budget
        edge = sums.where(F.col("upto") >= F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "n", "upto")).alias("e"))
        last = sums.groupBy("source").agg(F.max(F.struct("bucket", "n", "upto")).alias("l"))
        edge = last.join(edge.select(F.col("source").alias("src"), "e"), F.col("source").eqNullSafe(F.col("src")), "left").select("source", F.coalesce("e", "l").alias("e"))
        joined = state.join(edge.select(F.col("source").alias("src"), "e"), F.col("source").eqNullSafe(F.col("src")), "left")
        left = F.col("budget") - F.coalesce(F.col("e.upto") - F.col("e.n"), F.lit(0))
        state = keep(joined.select("source", "source_size", "target", "copies", left.alias("budget"), F.coalesce("e.bucket", "prefix").alias("prefix"), F.coalesce("e.n", F.lit(0)).alias("n")), "mix-level")
    nearer = F.abs(F.col("n") - F.col("budget")) < F.abs(F.col("budget"))
    return state.select(F.col("source").alias("src"), "source_size", "target", "copies", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def times(h: Column) -> Column:
    """How often a document is taken, beside its source's limits."""
    return F.col("copies") + F.when(h < F.col("threshold"), 1).otherwise(0)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that a mix takes, each as often as it takes it; columns as they are.

    Cases are those of ``hash_threshold_mix``; columns of any name are carried along.  Only the sources' limits meet the documents again, so their texts are not shuffled.
    """
    limits = mix_limits(_sizes(docs, id_col, text_col, source_col), share, most, weights)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col(source_col).cast("string").alias("source"), document_hash(F.col(id_col).cast("long"), F.col(text_col)).alias("h"))
    found = own.join(limits, F.col("source").eqNullSafe(F.col("src")))
    return found.select("row", F.explode(F.array_repeat(F.lit(1), times(F.col("h")).cast("int")))).select("row.*")
