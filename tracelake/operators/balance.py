"""Dealing sequences to partitions of balanced total length."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def largest_differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Karmarkar-Karp: the two partial deals of widest spread are joined, large parts with small ones.

    A part is (total, count, items); a deal lists its parts in descending order.  Ties are
    decided by the parts, so the result is one for the same input.  ``equal_size`` starts
    from deals of one item a part, which keeps counts equal.
    """
    if k < 1 or len(lengths) < k:
        raise ValueError(f"{len(lengths)} items can't fill {k} parts")
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items don't divide by {k}")

    class Deal:
        def __init__(self, parts):
            self.parts = sorted(parts, reverse=True)

        @property
        def spread(self):
            return self.parts[0][0] - self.parts[-1][0]

        def __lt__(self, other):  # the heap's least is the widest
            return (self.spread, self.parts[0]) > (other.spread, other.parts[0])

    ordered = sorted((x, i) for i, x in enumerate(lengths))
    step = k if equal_size else 1
    heap = []
    for at in range(0, len(ordered), step):
        parts = [(x, 1, ((i, x),)) for x, i in ordered[at : at + step]]
        heapq.heappush(heap, Deal(parts + [(0, 0, ())] * (k - len(parts))))
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        joined = [(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a.parts, reversed(b.parts))]
        heapq.heappush(heap, Deal(joined))
    return [sorted(i for i, _ in part[2]) for part in heap[0].parts]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item, in the given order, to the part of least total; a bias per item keeps counts equal."""
    bias = sum(lengths) + 1 if equal_size else 0
    parts, totals = [[] for _ in range(k)], [0] * k
    for i, x in enumerate(lengths):
        at = totals.index(min(totals))
        parts[at].append(i)
        totals[at] += x + bias
    return parts


def balanced_parts(df: DataFrame, k: int, key: str, length: str, batch: str | None = None, equal_size: bool = False) -> DataFrame:
    """``(batch, key, part_id)``: every batch of rows is dealt to ``k`` parts on its own.

    A batch is one optimisation step's rows, some thousands; batches are dealt in parallel,
    each in one task.  Without ``batch`` the whole table is one.
    """
    from ..plans.ship import ship_package

    ship_package(df.sparkSession)
    rows = df.select(F.lit(0).alias("batch") if batch is None else F.col(batch).alias("batch"), F.col(key).alias("key"), F.col(length).alias("length"))

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable").reset_index(drop=True)
        part["part_id"] = 0
        for p, items in enumerate(largest_differencing(part["length"].tolist(), k, equal_size)):
            part.loc[items, "part_id"] = p
        return part[["batch", "key", "part_id"]]

    kind = dict(rows.dtypes)
    return rows.groupBy("batch").applyInPandas(deal, f"batch {kind['batch']}, key {kind['key']}, part_id int")


def micro_batch_count(df: DataFrame, length: str, most_tokens: int) -> DataFrame:
    """Parts needed for an average of at most ``most_tokens``; single parts may exceed it."""
    return df.agg(F.sum(length).cast("long").alias("total")).withColumn("parts", F.ceil(F.col("total") / most_tokens).cast("int"))


def micro_batches(df: DataFrame, key: str, length: str, most_tokens: int, batch: str, fewest: int = 1) -> DataFrame:
    """``(batch, key, part_id, parts)``: each batch dealt to as many parts as an average of ``most_tokens`` needs.

    ``fewest`` is the count that other ranks need, so that all take part in as many steps; a
    batch never has more parts than rows.  A batch is one optimisation step's rows and a
    task's work, its rows are keys and lengths only.
    """
    from ..plans.ship import ship_package

    ship_package(df.sparkSession)
    rows = df.select(F.col(batch).alias("batch"), F.col(key).alias("key"), F.col(length).alias("length"))

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable").reset_index(drop=True)
        lengths = part["length"].tolist()
        part["parts"] = min(len(part), max(fewest, ceil_div(sum(lengths), most_tokens)))
        part["part_id"] = 0
        for p, items in enumerate(largest_differencing(lengths, int(part["parts"].iloc[0]))):
            part.loc[items, "part_id"] = p
        return part[["batch", "key", "part_id", "parts"]]

    kind = dict(rows.dtypes)
    return rows.groupBy("batch").applyInPandas(deal, f"batch {kind['batch']}, key {kind['key']}, part_id int, parts int")


def part_order(parts: DataFrame) -> DataFrame:
    """Rows of dealt parts with ``place``: a batch's rows from 0, part by part."""
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("part_id", "key")) - 1)


def balance_stats(df: DataFrame, part: str, length: str) -> DataFrame:
    """Smallest, largest, difference and mean of the parts' totals."""
    sums = df.groupBy(part).agg(F.sum(length).alias("n"))
    return sums.agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("difference"), F.avg("n").alias("mean"))


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b) if abs(a) < 1 << 50 else -(-a // b)
