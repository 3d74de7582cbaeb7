"""Exact quantiles of large groups against numpy."""

import math
import random

import numpy as np
import pytest

from tracelake.operators import evaluation, quantiles

PARTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def rows(r: random.Random):
    out = [("hot", r.gauss(0, 1)) for _ in range(3000)] + [("ties", r.choice([0.0, 0.0, 0.0, 1.0])) for _ in range(400)] + [("wide", r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300)) for _ in range(300)]
    out += [("near", 1 + k * 2.0**-52) for k in range(200)] + [("same", 5.0)] * 300 + [("small", r.random()) for _ in range(7)] + [(None, r.random()) for _ in range(90)] + [("none", None)] * 3 + [("hot", None)] * 2 + [("ends", x) for x in (-math.inf, math.inf) for _ in range(60)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("few, broadcast", [(20, 100_000), (40, 0), (100_000, 100_000)])
def test_quantiles(spark, monkeypatch, few, broadcast):
    monkeypatch.setattr(quantiles, "MOST_BROADCAST", broadcast)
    data = rows(random.Random(2))
    got = {x.g: x.quantiles for x in quantiles.exact_quantiles(spark.createDataFrame(data, "g string, v double").repartition(4), "g", "v", PARTS, few, bins=128).collect()}
    groups = {g for g, v in data if v is not None}
    assert got.keys() == groups
    for g in groups:
        own = sorted(v for x, v in data if x == g and v is not None)
        for p, x in zip(PARTS, got[g]):
            at = p * (len(own) - 1)
            a, b = own[math.floor(at)], own[math.ceil(at)]
            assert x == a == b or math.isclose(x, a + (b - a) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=1e-300) or not math.isfinite(b - a), (g, p)


def test_entropy_stats_of_a_hot_group(spark):
    r = random.Random(3)
    data = [("hot" if k % 10 else f"u{k % 30}", r.random()) for k in range(5000)]
    got = {x.g: x for x in evaluation.entropy_stats(spark.createDataFrame(data, "g string, v double"), "g", "v", few=100).collect()}
    for g, x in got.items():
        own = np.array([v for y, v in data if y == g])
        assert np.allclose([x.mean, x.std, x.range, x.q25, x.q50, x.q75], [own.mean(), own.std(), np.ptp(own), *np.quantile(own, [0.25, 0.5, 0.75])])


def test_no_rows(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0
