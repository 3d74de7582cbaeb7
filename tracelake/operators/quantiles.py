"""Exact quantiles of groups of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, keep

FEW = 100_000  # values that a task may hold
MOST_BROADCAST = 100_000  # ranges that every task may hold
SALTS = 64


def _size(x: Column) -> Column:
    """Grows with ``x``: the logarithm on both sides of 0."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 745.5))  # the smallest float's is above -745.5


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """A bin that never falls as ``v`` grows; the smallest value is in the first, the largest in the last one."""
    wide = _size(high) - _size(low) > 1
    part = F.when(wide, (_size(v) - _size(low)) / (_size(high) - _size(low))).otherwise((v - low) / (high - low))
    return F.when(v >= high, bins - 1).when(v <= low, 0).otherwise(F.least(F.greatest(F.floor(part * (bins - 1)).cast("int"), F.lit(0)), F.lit(bins - 2)))


def _in_ranges(data: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``data`` in each of their group's ranges; a large group stays where its rows are, or is salted."""
    inside = F.col("_g").eqNullSafe(F.col("_rg")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    if ranges.count() <= MOST_BROADCAST:
        return data.join(F.broadcast(ranges), inside)
    salted = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = data.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, inside & (F.col("_s") == F.col("_salt")))


def exact_quantiles(df: DataFrame, group: str, value: str, parts: list[float], few: int = FEW, bins: int = 1024) -> DataFrame:
    """``group`` and an array ``quantiles``: for each part, the value between the two neighbours in order, as numpy has it.

    Groups of at most ``few`` values are sorted by Spark's own percentile.  In larger ones a
    histogram over the value range tells which bin holds each wanted rank; only these bins are
    counted again, in finer bins, until one has a single value or at most ``few``.  Counts are
    summed before they are shuffled, so no task holds a group, however many of all rows it
    has.  Bins of a wide range are of the logarithm, so that values of very different size part.
    Null values are left out; a group without others has no row.  NaN counts as the largest.
    """
    name = f"q{uuid.uuid4().hex[:6]}"
    data = keep(df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), f"{name}-values")
    sizes = data.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = keep(sizes.where(F.col("_n") > few), f"{name}-large")
    # small groups: no more values than a task may hold; of large ones none get here
    small = data.join(F.broadcast(large.select(F.col("_g").alias("_big"))), F.col("_g").eqNullSafe(F.col("_big")), "left_anti") if large.count() <= MOST_BROADCAST else data.join(large.select(F.col("_g").alias("_big")), F.col("_g").eqNullSafe(F.col("_big")), "left_anti")
    out = small.groupBy("_g").agg(F.percentile("_v", F.array(*map(F.lit, parts))).alias("quantiles"))
    if large.isEmpty():
        return out.withColumnRenamed("_g", group)
    at = [F.lit(p) * (F.col("_n") - 1) for p in parts]
    wanted = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(up).alias("up"), (F.ceil(x) if up else F.floor(x)).cast("long").alias("rank"), (x - F.floor(x)).alias("share")) for k, x in enumerate(at) for up in (False, True)))
    targets = keep(large.withColumn("_t", F.explode(wanted)).select("_g", "_lo", "_hi", F.col("_n").alias("_m"), "_t.*"), f"{name}-targets")
    done = []
    while True:
        open_ = targets.where((F.col("_m") > few) & (F.col("_lo") < F.col("_hi")))
        done.append(targets.where((F.col("_m") <= few) | (F.col("_lo") >= F.col("_hi"))))
        if open_.isEmpty():
            break
        ranges = open_.select(F.col("_g").alias("_rg"), "_lo", "_hi").distinct()
        binned = _in_ranges(data, ranges).withColumn("_b", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins))
        counts = binned.groupBy("_rg", "_lo", "_hi", "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        before = F.sum("_c").over(Window.partitionBy("_rg", "_lo", "_hi").orderBy("_b")) - F.col("_c")  # at most ``bins`` rows
        counts = counts.withColumn("_before", before).select(F.col("_rg"), F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), "_c", "_min", "_max", "_before")
        hit = F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_c"))
        targets = keep(open_.join(counts, hit).select("_g", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_c").alias("_m"), "part", "up", (F.col("rank") - F.col("_before")).alias("rank"), "share"), f"{name}-targets")
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    equal = settled.where(F.col("_lo") >= F.col("_hi")).select("_g", "part", "up", "share", F.col("_lo").alias("x"))
    rest = settled.where(F.col("_lo") < F.col("_hi"))
    ranges = rest.select(F.col("_g").alias("_rg"), "_lo", "_hi").distinct()
    lists = _in_ranges(data, ranges).groupBy("_rg", F.col("_lo").alias("_l"), F.col("_hi").alias("_h")).agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # at most ``few`` values
    same = F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h"))
    found = equal.union(rest.join(lists, same).select("_g", "part", "up", "share", F.element_at("_all", (F.col("rank") + 1).cast("int")).alias("x")))
    pairs = found.groupBy("_g", "part").agg(F.max(F.when(~F.col("up"), F.col("x"))).alias("a"), F.max(F.when(F.col("up"), F.col("x"))).alias("b"), F.max("share").alias("s"))
    # equal neighbours need no calculation, which infinite ones would spoil
    value_ = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("s")) * F.col("a") + F.col("s") * F.col("b"))
    wide = pairs.groupBy("_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", value_.alias("x")))), lambda t: t["x"]).alias("quantiles"))
    result = keep(out.union(wide), f"{name}-quantiles")
    discard(data, large)
    return result.withColumnRenamed("_g", group)
