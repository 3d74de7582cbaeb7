"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges -> ``(node, label)``, label the smallest node of the component.

    Alternating large-star and small-star rounds until nothing changes; each round is
    written to the shared folder in the place of the one before, so lineage stays short.
    Nodes without an edge are not listed.  Edges with a null end and loops are ignored;
    repeated edges count once.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = now = None
    while before is None or now != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = keep(small.where("u <> v").distinct(), "edges")
        discard(e)
        e, before = after, now
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    out = keep(e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct()), "labels")
    discard(e)
    return out
