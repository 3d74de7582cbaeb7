"""Exchange modes: how a batch meets workers.  Partitions take the place of ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_all(df: DataFrame, **values) -> DataFrame:
    """The same scalar values for every row of every partition, as literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def sharded(df: DataFrame, ranks: int, key: str = "row_id") -> DataFrame:
    """Rows dealt to ``ranks`` partitions by key; counts need not divide."""
    return df.repartition(ranks, key)


def computed(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Shard, run, gather: ``fn`` maps an iterator of pandas frames of a partition."""
    return df.mapInPandas(fn, schema)


def metrics_by_shard(df: DataFrame, ranks: int, value: str, key: str = "row_id") -> DataFrame:
    """One partial aggregate a shard, by a fixed rule of the key."""
    return df.groupBy(F.pmod(F.col(key), F.lit(ranks)).cast("int").alias("rank")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def mean_over_shards(partials: DataFrame) -> DataFrame:
    return partials.agg((F.sum("total") / F.sum("n")).alias("mean"))
