"""Top-k search against brute force; the sharded table's states."""

import collections
import fractions
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import topk
from tracelake.llm.sharding import Refused, ShardedTable, shard_index
from tracelake.llm.storage import new_path

from . import helpers as h


def brute(rows, k=5):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def search(spark, rows, **parts):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(2).alias("v"), F.lit(3).alias("score"))
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, **parts).collect()))


def test_random_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(400)]
    assert search(spark, rows) == brute(rows)


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.5, -0.25]) for _ in range(20)]) for i in range(300)]  # ties
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 20), (1150, [float("inf")] * 20), (1200, [0.5] * 3), (1201, [0.25] * 3), (1250, []), (1251, []), (None, [0.5] * 20), (-50, [0.5] * 20), (1300, [1000.0] * 20)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, [], k=3) == [] and search(spark, rows[:3], k=7) == brute(rows[:3], 7)


def test_huge_components(spark):
    """Finite components of any size take part; scores are cut to a long's range."""
    top = 2**63 - 1
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e308, 5.0]), (3, [0.5, 0.25]), (4, [1e-300, 0.0]), (50, [0.0, 0.0]), (100, [1.0, 1e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k=6).collect()))
    ints = {i: [math.floor(256 * fractions.Fraction(x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        s = sorted((-max(-top, min(top, sum(a * b for a, b in zip(ints[q], v)))), i) for i, v in ints.items() if i != q)[:6]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == want


def test_repeated_ids_are_candidates_each(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])]
    assert search(spark, rows) == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 32768)]


def test_sharded_table(spark):
    docs = h.documents(spark, [(i, "w " * (i % 50), None, None, None) for i in range(600)], clashing=True)
    t = ShardedTable(spark, new_path(spark, "table"), fanout=4, target_bytes=1 << 20, small_bytes=1 << 10)
    assert t.read() is None and t.manifest()["version"] == 0
    for part in range(5):
        t.append(docs.where(F.col("doc_id") % 5 == part), arrivals=3)
    before = t.manifest()
    assert before["version"] == 5 and len(before["shards"]) == 15
    stale = t.manifest(5)
    done = t.settle()
    assert len(done["shards"]) < 15 and all(len(own) < t.fanout for own in by_tier(t, done).values())
    assert sorted(r.doc_id for r in t.read().collect()) == list(range(600))
    with pytest.raises(Exception):  # a writer that started from an older version
        t.commit(stale, [])
    assert t.manifest()["version"] == done["version"]
    assert len(t.versions()) == 2 and t.read(t.versions()[0]).count() == 600  # a reader of the version before isn't cut off
    kept = {s["file"] for v in t.versions() for s in t.manifest(v)["shards"]}
    assert all(not t.fs.exists(t._path(s["file"])) for s in before["shards"] if s["file"] not in kept)
    assert "_shard" in t.read().columns and t.read().select("_shard").distinct().count() == len(done["shards"])


def by_tier(t, manifest):
    out = {}
    for s in manifest["shards"]:
        if s["bytes"] < t.target * 3 // 4:
            out.setdefault(t.tier(s["bytes"]), []).append(s)
    return out


def test_shard_index(spark):
    rows = h.corpus() + [(None, None, None, None, None), (1, "again", None, None, None)]
    got = shard_index(h.documents(spark, rows, clashing=True), new_path(spark, "index")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    per = collections.Counter(r.shard_no for r in got)
    assert all(r.shard_rows == per[r.shard_no] for r in got) and sorted(per) == list(range(len(per)))
    assert sum(r.text_bytes for r in got) == sum(len((t or "").encode()) for _, t, *_ in rows)
    assert shard_index(h.documents(spark, []), new_path(spark, "index")).count() == 0


def test_splits_above_the_target_end_near_it(spark):
    r, target = random.Random(3), 1 << 18
    text = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(1500))
    rows = [(i, text(), None, None, None) for i in range(2400)]
    for parts in (2, 16):  # splits of about five targets, and of 0.6 of one: no two fit
        docs = h.documents(spark, rows).repartition(parts)
        path = new_path(spark, "large")
        got = shard_index(docs, path, target_bytes=target, arrivals=1).collect()
        assert sorted(x.doc_id for x in got) == list(range(2400))
        sizes = [s["bytes"] for s in ShardedTable(spark, path).manifest()["shards"]]
        assert all(0.75 * target <= n <= 1.25 * target for n in sizes), (parts, sizes)


def test_a_row_above_the_target_stays_alone(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(n)), None, None, None) for i, n in enumerate([400000, 50, 60, 70])]
    got = shard_index(h.documents(spark, rows).coalesce(1), new_path(spark, "row"), target_bytes=1 << 16).collect()
    assert sorted(x.doc_id for x in got) == [0, 1, 2, 3]


@pytest.mark.parametrize("wide_first", [True, False])
def test_columns_that_come_and_go(spark, wide_first):
    narrow, wide = spark.range(0, 50).selectExpr("id", "id * 2 AS a"), spark.range(50, 100).selectExpr("id", "CAST(id AS STRING) AS b")
    t = ShardedTable(spark, new_path(spark, "columns"), fanout=2, small_bytes=1 << 20)
    for df in (wide, narrow) if wide_first else (narrow, wide):
        t.append(df, arrivals=2)
    t.append(spark.range(100, 110), arrivals=1)
    before = {(r.id, r.a, r.b) for r in t.rows().collect()}
    assert before == {(i, i * 2, None) for i in range(50)} | {(i, None, str(i)) for i in range(50, 100)} | {(i, None, None) for i in range(100, 110)}
    assert t.settle()["version"] > 3 and {(r.id, r.a, r.b) for r in t.rows().collect()} == before
    for bad in (spark.range(3).selectExpr("CAST(id AS STRING) AS id"), spark.range(3).selectExpr("id AS ID")):
        with pytest.raises(ValueError):
            t.append(bad)
    assert t.rows().count() == 110


def test_a_rename_whose_answer_is_lost(spark):
    t = ShardedTable(spark, new_path(spark, "lost"))
    rename = t._rename

    def lost(source, target):
        rename(source, target)
        raise OSError("no answer")

    t._rename = lost
    assert t.append(spark.range(20))["version"] == 1 and t.rows().count() == 20

    def never(source, target):
        raise OSError("no connection")

    t._rename = never
    with pytest.raises(OSError):
        t.append(spark.range(5))
    t._rename = rename
    assert t.rows().count() == 20 and t.append(spark.range(5))["version"] == 2 and t.rows().count() == 25


def test_two_writers(spark):
    path = new_path(spark, "writers")
    a, b = ShardedTable(spark, path), ShardedTable(spark, path)
    base = a.manifest()
    a.append(spark.range(10))
    b.manifest = lambda version=None: base if version is None else ShardedTable.manifest(b, version)
    with pytest.raises(Refused):
        b.append(spark.range(10, 30))
    assert a.rows().count() == 10
    files = {s.getPath().getName() for f in a.fs.listStatus(a._path("data")) for s in a.fs.listStatus(f.getPath()) if s.getPath().getName().endswith(".parquet")}
    assert files == {s["file"].split("/")[-1] for s in a.manifest()["shards"]}


def test_empty_partitions_leave_no_shards(spark):
    t = ShardedTable(spark, new_path(spark, "holes"))
    t.append(spark.range(100).repartition(8).where("id < 3"))
    assert all(s["rows"] > 0 for s in t.manifest()["shards"]) and sum(s["rows"] for s in t.manifest()["shards"]) == 3
    assert t.append(spark.range(0))["version"] == 2 and t.rows().count() == 3


def test_index_against_the_files(spark):
    """Every size goes through several versions and a merge; the index says for each row the file that holds it."""
    import pyarrow.parquet as pq

    rows = h.corpus(3)
    path = new_path(spark, "files")
    got = shard_index(h.documents(spark, rows), path).collect()
    t = ShardedTable(spark, path)
    m = t.manifest()
    assert {r.version for r in got} == {m["version"]} and m["version"] >= 5 and max(s["level"] for s in m["shards"]) > 0
    files = sorted(s["file"] for s in m["shards"])
    want = collections.Counter()
    for k, f in enumerate(files):
        table = pq.read_table(f"{path}/{f}".removeprefix("file:"))
        want.update((i, len((x or "").encode()), k, len(table)) for i, x in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    assert collections.Counter((r.doc_id, r.text_bytes, r.shard_no, r.shard_rows) for r in got) == want


def test_repeated_query_ids(spark, monkeypatch):
    """Each row that asks has an answer of its own, also where many rows share an id; blocks keep their bound."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(self, x))
    assert search(spark, [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [0.5]), (3, [0.25]), (4, [0.1])], k=3) == sorted([(0, 1, 1, 65536), (0, 2, 2, 32768), (0, 3, 3, 16384), (0, 1, 1, 131072), (0, 2, 2, 65536), (0, 3, 3, 32768)])
    r = random.Random(7)
    rows = [(r.choice([0, 0, 0, 50, 7, 9, k]), [r.choice([0.0, 0.5, -0.25, 1.5]) for _ in range(4)]) for k in range(120)]
    assert search(spark, rows) == brute(rows)
    assert sent and all(len(x[0]) <= 3 for x in sent)


def test_many_runs_of_one_job_stay_apart(spark):
    """Several runs are merged in a job, each to a file of at most the target."""
    r, target = random.Random(5), 1 << 18
    text = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(1500))
    docs = h.documents(spark, [(i, text(), None, None, None) for i in range(1600)]).repartition(8)
    path = new_path(spark, "runs")
    assert shard_index(docs, path, target_bytes=target).count() == 1600
    shards = ShardedTable(spark, path).manifest()["shards"]
    assert len(shards) >= 6 and max(s["bytes"] for s in shards) <= 1.25 * target and sum(s["bytes"] < target // 2 for s in shards) < 4
