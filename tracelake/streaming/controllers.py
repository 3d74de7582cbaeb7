"""Streaming variants: the adaptive KL coefficient and running evaluation over a stream of graded attempts.

These extend the batch engine; batch results are the reference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.token_math import adaptive_kl_value


def kl_coefficients(steps: DataFrame, initial: float, target: float, horizon: float) -> DataFrame:
    """A stream of ``(run, step, kl, n)`` -> the coefficient after each step, a state a run.

    Steps of a run that arrive in one micro-batch are taken in their order.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else initial
        rows = []
        for r in pd.concat(list(parts)).sort_values("step").itertuples():
            value = adaptive_kl_value(value, r.kl, target, r.n, horizon)
            rows.append((key[0], r.step, value))
        state.update((value,))
        yield pd.DataFrame(rows, columns=["run", "step", "coefficient"])

    from ..plans.ship import ship_package

    ship_package(steps.sparkSession)
    return steps.groupBy("run").applyInPandasWithState(update, "run string, step long, coefficient double", "value double", "append", GroupStateTimeout.NoTimeout)


def kl_fold(steps: DataFrame, initial: float, target: float, horizon: float) -> DataFrame:
    """The batch form: an ordered fold over each run's steps."""
    item = F.struct("step", F.col("kl").cast("double").alias("kl"), F.col("n").cast("double").alias("n"))
    runs = steps.groupBy("run").agg(F.sort_array(F.collect_list(item)).alias("s"))

    def step(v, x):
        error = F.greatest(F.least(x["kl"] / F.lit(target) - 1, F.lit(0.2)), F.lit(-0.2))
        return v * (1 + error * x["n"] / F.lit(horizon))

    return runs.select("run", F.aggregate("s", F.lit(float(initial)), step).alias("coefficient"))


def running_average(attempts: DataFrame) -> DataFrame:
    """A stream of graded attempts -> attempts and mean correctness by source so far (update or complete mode)."""
    return attempts.groupBy("source").agg(F.count("*").alias("attempts"), F.avg(F.col("correct").cast("double")).alias("mean"))


def controller(kind: str, coefficient: float, target: float = 0.1, horizon: float = 10000.0) -> tuple[float, Callable[[float, float, float], float]]:
    """A KL controller's first coefficient and its step ``(coefficient, divergence, samples) -> coefficient``, of kind ``fixed`` or ``adaptive``."""
    if kind == "fixed":
        return coefficient, lambda value, current, n: value
    if kind == "adaptive" and horizon > 0:
        return coefficient, lambda value, current, n: adaptive_kl_value(value, current, target, n, horizon)
    raise ValueError(f"no controller {kind!r} with horizon {horizon}")
