"""Advantages and returns of sampled sequences, and whole-batch whitening.

Group statistics are windows over the group key; suffix sums are windows over a sequence's
positions.  Whole-batch moments are one aggregate that is joined back, never a window without
partitions.  Generalised advantages multiply a decay into a recurrence, which no window
does; they fold each sequence's array once, in a grouped Arrow function a sequence a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import token_math


def group_relative(df: DataFrame, group: str = "uid", reward: str = "reward", out: str = "advantage", epsilon: float = 1e-6) -> DataFrame:
    """``(reward - mean) / (sample std + epsilon)`` within a group; alone in a group: mean 0, std 1."""
    w = Window.partitionBy(group)
    alone = F.count("*").over(w) == 1
    mean = F.when(alone, 0.0).otherwise(F.avg(reward).over(w))
    std = F.when(alone, 1.0).otherwise(F.stddev_samp(reward).over(w))
    return df.withColumn(out, (F.col(reward) - mean) / (std + F.lit(epsilon)))


def tiled(df: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """A sequence's value at each of its valid tokens, 0 elsewhere."""
    return df.withColumn(out, F.transform(mask, lambda m: F.col(value) * m))


def suffix_returns(df: DataFrame, sequence: str, order: list[Column], reward: Column, out: str = "returns") -> DataFrame:
    """Sum of rewards from each position to the sequence's end; a running sum from the end, so linear in its length."""
    w = Window.partitionBy(sequence).orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(reward).over(w))


def with_kl_penalty(df: DataFrame, scores: str, logp: str, ref: str, mask: str, beta: Column | float, kind: str = "kl", out: str = "rewards") -> DataFrame:
    """Token rewards ``scores - beta * divergence`` on valid tokens, and each sequence's mean divergence ``sequence_kl``.

    All four are arrays of one length; a sequence without a valid token has a null mean.
    """
    weight = beta if isinstance(beta, Column) else F.lit(float(beta))
    divergence = F.transform(F.arrays_zip(F.col(logp).alias("l"), F.col(ref).alias("r"), F.col(mask).alias("m")), lambda x: token_math.kl(x["l"], x["r"], kind) * x["m"])
    df = df.withColumn("_kl", divergence)
    rewards = F.zip_with(scores, "_kl", lambda s, d: s - weight * d)
    return df.withColumn(out, rewards).withColumn("sequence_kl", token_math.masked_mean(F.col("_kl"), F.col(mask))).drop("_kl")


def with_baseline(df: DataFrame, baselines: DataFrame, key: str, returns: str = "returns", baseline: str = "baseline", mask: Column | None = None, out: str = "advantage") -> DataFrame:
    """Returns less the prompt's baseline on valid tokens."""
    mask = F.lit(1.0) if mask is None else mask
    return df.join(baselines, key).withColumn(out, F.col(returns) - F.col(baseline) * mask)


def gae_values(rewards: np.ndarray, values: np.ndarray, gamma: float, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Advantages and returns of one sequence, over all its places from the right."""
    out, last = np.zeros(len(rewards)), 0.0
    following = np.append(values[1:], 0.0)
    for i in range(len(rewards) - 1, -1, -1):
        last = rewards[i] + gamma * following[i] - values[i] + gamma * lam * last
        out[i] = last
    return out, out + values


def _gae(gamma: float, lam: float, rewards_at: int, values_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, v = batch.column(rewards_at), batch.column(values_at)
            got = [gae_values(np.asarray(x.values, float), np.asarray(y.values, float), gamma, lam) for x, y in zip(r, v)]
            cols = [*batch.columns, pa.array([a for a, _ in got], pa.list_(pa.float64())), pa.array([b for _, b in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "advantages", "returns"])

    return run


def generalised(df: DataFrame, rewards: str = "rewards", values: str = "values", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Add ``advantages`` (not whitened) and ``returns`` arrays; one row is a sequence, nothing is shuffled."""
    from ..plans.ship import ship_package

    ship_package(df.sparkSession)
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", advantages array<double>, returns array<double>"
    return df.mapInArrow(_gae(gamma, lam, df.columns.index(rewards), df.columns.index(values), df.columns), fields)


def generalised_fold(rewards: Column, gamma: float, lam: float) -> Column:
    """Advantages without values as a fold over the reversed array; a cross-check for short arrays."""
    step = lambda acc, r: F.concat(F.array(r + F.lit(gamma * lam) * F.coalesce(F.get(acc, 0), F.lit(0.0))), acc)
    return F.aggregate(F.reverse(rewards), F.array().cast("array<double>"), step)


def generalised_long(tokens: DataFrame, sequence: str, place: str, reward: str, value: str, gamma: float = 1.0, lam: float = 1.0, chunk: int = 256) -> DataFrame:
    """``tokens`` with ``advantage`` and ``returns``, for sequences of any length; a row is a token.

    ``place`` counts a sequence's tokens from 0 without gaps.  An advantage is an affine map of
    the next one, and such maps compose: each chunk of a sequence is summed up as one map,
    the chunks' maps are scanned from the right, and then each token needs its chunk and what
    follows it only.  Chunks of one sequence are spread over tasks; a task of the scan holds
    a sequence's chunks, a row each.
    """
    from ..plans.ship import ship_package

    ship_package(tokens.sparkSession)
    w = gamma * lam
    if 0 < w < 1:  # powers of a chunk stay far from the smallest float
        chunk = max(1, min(chunk, int(-200 / np.log10(w)) if w < 0.99 else chunk))
    t = tokens.withColumns({"_c": F.floor(F.col(place) / chunk).cast("long"), "_i": (F.col(place) % chunk).cast("int")})
    back = Window.partitionBy(sequence, "_c").orderBy(F.desc(place))
    # without what the chunk's last token has after it
    t = t.withColumn("_d", F.col(reward) + gamma * F.coalesce(F.lag(value).over(back), F.lit(0.0)) - F.col(value))
    weight = F.pow(F.lit(float(w)), F.col("_i")) if w else F.when(F.col("_i") == 0, 1.0).otherwise(0.0)
    chunks = t.groupBy(sequence, "_c").agg(F.sum(weight * F.col("_d")).alias("b"), F.count("*").alias("n"), F.min_by(value, place).alias("v"))
    kind = dict(tokens.dtypes)[sequence]

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_c", "descending")])
        b, n, v = (np.asarray(table[x], float) for x in ("b", "n", "v"))
        ahead, worth = np.zeros(len(b)), np.append(0.0, v[:-1])  # the next chunk's first advantage and value
        for k in range(1, len(b)):
            last = b[k - 1] + w ** (n[k - 1] - 1) * gamma * worth[k - 1]
            ahead[k] = last + w ** n[k - 1] * ahead[k - 1]
        return pa.table([table[0], table["_c"], table["n"], pa.array(ahead), pa.array(worth)], names=["_s", "_k", "_n", "_ahead", "_worth"])

    after = chunks.groupBy(sequence).applyInArrow(scan, f"_s {kind}, _k long, _n long, _ahead double, _worth double")
    t = t.join(after, F.col(sequence).eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_k")))
    inside = F.sum(weight * F.col("_d")).over(back) / weight if w else F.col("_d")
    left = F.col("_n") - F.col("_i")  # tokens to the chunk's end
    power = lambda e: F.pow(F.lit(float(w)), e) if w else F.when(e == 0, 1.0).otherwise(0.0)
    out = inside + power(left - 1) * gamma * F.col("_worth") + power(left) * F.col("_ahead")
    return t.withColumn("advantage", out).select(*tokens.columns, "advantage", (F.col("advantage") + F.col(value)).alias("returns"))


def whitened(df: DataFrame, value: str, mask: str, out: str = "whitened", shift_mean: bool = True) -> DataFrame:
    """Long-form tokens scaled by the masked mean and sample variance of the whole batch; masked-out ones too."""
    valid = F.when(F.col(mask) == 1, F.col(value))
    moments = df.agg(F.avg(valid).alias("_mean"), F.var_samp(valid).alias("_var"))  # one row
    white = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + F.lit(1e-8))
    joined = df.crossJoin(F.broadcast(moments))
    return joined.withColumn(out, white if shift_mean else white + F.col("_mean")).drop("_mean", "_var")


ESTIMATORS = ("gae", "grpo", "remax", "reinforce")


def advantage(df: DataFrame, estimator: str, **parts) -> DataFrame:
    """Dispatch by name; unknown names are an error."""
    if estimator == "gae":
        return generalised(df, **parts)
    if estimator == "grpo":
        return group_relative(df, **parts)
    if estimator == "reinforce":
        return suffix_returns(df, **parts)
    if estimator == "remax":
        baselines, key = parts.pop("baselines"), parts.pop("key")
        return with_baseline(suffix_returns(df, **parts), baselines, key)
    raise NotImplementedError(estimator)
