"""Shared intermediate tables (see ``sources.shared``) and sizes of packed exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import discard, keep, new_path, shared_dir

__all__ = ["bucket_count", "discard", "keep", "new_path", "shared_dir"]


def bucket_count(df: DataFrame, bucket_bytes: int = 3 << 20, least: int = 8, many: int = 32768, most_bytes: int = 64 << 20) -> int:
    """Number of key buckets for packed exchanges, from the optimizer's size estimate of ``df``.

    Beyond ``many`` buckets each may hold up to ``most_bytes`` of the input, and never more.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= 1 << 56:  # not known, as for frames made from an RDD: the session's partitions tell
        return max(least, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(many, -(-estimate // bucket_bytes)), -(-estimate // most_bytes))
