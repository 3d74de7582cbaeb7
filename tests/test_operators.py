"""Properties of batch, balance, advantage, evaluation and loop operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import answers, token_math
from tracelake.operators import advantage, balance, batch, evaluation
from tracelake.plans import loop, prep
from tracelake.plans.ship import ship_package
from tracelake.sources import tables
from tracelake.streaming import controllers


@given(st.lists(st.integers(0, 500), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_largest_differencing_covers(lengths, k):
    if len(lengths) < k:
        with pytest.raises(ValueError):
            balance.largest_differencing(lengths, k)
        return
    parts = balance.largest_differencing(lengths, k)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths))) and len(parts) == k
    n = len(lengths) // k * k
    if n:
        equal = balance.largest_differencing(lengths[:n], k, equal_size=True)
        assert {len(p) for p in equal} == {n // k}


def test_largest_differencing_balances():
    parts = balance.largest_differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    assert balance.greedy([5, 5, 1, 1], 2, equal_size=True) == [[0, 2], [1, 3]]


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30), st.floats(0, 1), st.floats(0, 1))
@settings(deadline=None)
def test_gae_is_its_definition(rewards, gamma, lam):
    r, v = np.array(rewards), np.linspace(1, 2, len(rewards))
    got, returns = advantage.gae_values(r, v, gamma, lam)
    delta = r + gamma * np.append(v[1:], 0) - v
    want = [sum((gamma * lam) ** (j - i) * delta[j] for j in range(i, len(r))) for i in range(len(r))]
    assert np.allclose(got, want) and np.allclose(returns, got + v)


def test_gae_fold_agrees(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0]), ([], [])], "rewards array<double>, values array<double>")
    out = advantage.generalised(df, gamma=0.9, lam=0.5).withColumn("fold", advantage.generalised_fold(F.col("rewards"), 0.9, 0.5))
    for r in out.collect():
        assert np.allclose(r.advantages, r.fold)


def test_group_relative_singleton_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 1.0)], "uid string, reward double")
    got = {(r.uid, r.reward): r.advantage for r in advantage.group_relative(df).collect()}
    assert got[("a", 1.0)] == pytest.approx(1 / (1 + 1e-6)) and got[("b", 1.0)] == 0 and got[("c", 1.0)] == pytest.approx(0.7071, abs=1e-3)


def test_batch_round_trips(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id").withColumn("value", F.col("row_id") * 2)
    assert batch.unfold(batch.fold(df, 5)).orderBy("row_id").collect() == df.orderBy("row_id").collect()
    assert batch.unpad(batch.pad_to_divisor(df, 8)).count() == 10
    assert [r.row_id for r in batch.pad_to_divisor(df, 8).orderBy("row_id").collect()] == list(range(16))
    assert batch.pad_to_divisor(df.limit(3), 8).count() == 8
    assert batch.index_range(df, 2, 0).count() == 0 and batch.index_range(df, 2).count() == 8 and batch.keep_multiple(df, 4).count() == 8
    assert [r.row_id for r in batch.sample(df, 3, 1).collect()] == [r.row_id for r in batch.sample(df.repartition(3), 3, 1).collect()]
    left, right = batch.pop(df, ["value"])
    assert left.columns == ["row_id"] and batch.union_columns(left, right).orderBy("row_id").collect() == df.orderBy("row_id").collect()
    with pytest.raises(KeyError):
        batch.pop(df, ["nope"])
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(df, df.withColumn("value", F.col("value") + 1)).collect()
    assert batch.select(df, ["row_id"], ["nope", "value"]).columns == ["row_id", "value"]
    assert batch.lower_columns(df.toDF("A", "B")).columns == ["a", "b"]
    old_new = df.select(F.col("row_id").alias("old"), (9 - F.col("row_id")).alias("new"))
    assert batch.reorder(batch.reorder(df, old_new), batch.inverse(old_new)).select("row_id", "value").orderBy("row_id").collect() == df.orderBy("row_id").collect()
    with pytest.raises(ValueError):
        batch.fold(df, 3)
    assert batch.flattened(df.select(F.struct(F.struct("value").alias("x")).alias("s"))).columns == ["s/x/value"]


def test_tokens(spark):
    one = spark.range(1)
    a = lambda *x: F.array(*map(F.lit, x))
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(token_math.eos_mask(a(1, 2, 3, 2), 2)) == [1, 1, 0, 0] and get(token_math.eos_mask(a(1, 3), 2)) == [1, 1]
    assert get(token_math.position_ids(a(0, 0, 1, 1))) == [0, 0, 0, 1]
    assert get(token_math.scatter_reward(F.lit(5.0), F.lit(2), F.lit(4))) == [0, 5, 0, 0] and get(token_math.scatter_reward(F.lit(5.0), F.lit(0), F.lit(3))) == [0, 0, 5]
    assert get(token_math.masked_mean(a(1.0, 2.0), a(0.0, 0.0))) is None
    with pytest.raises(Exception, match="two tokens"):
        get(token_math.masked_var(a(1.0, 2.0), a(0.0, 1.0)))
    assert get(token_math.pad_to(a(1, 2), 4, 0)) == [1, 2, 0, 0] and get(token_math.pad_to(a(1, 2), 4, 0, left=True)) == [0, 0, 1, 2] and get(token_math.pad_to(a(1, 2), 1, 0)) == [1, 2]
    assert get(token_math.truncated(a(1, 2, 3), 2, "left")) == [2, 3] and get(token_math.truncated(a(1, 2, 3), 2)) == [1, 2]
    assert get(token_math.strip_left_pad(a(9, 9, 5, 6), a(0, 0, 1, 1))) == [5, 6] and get(token_math.strip_left_pad(a(9), a(0))) == []
    assert get(token_math.sft_loss_mask(F.lit(2), F.lit(5), F.lit(6))) == [0, 1, 1, 1, 0, 0]
    assert get(token_math.shifted_response(a(1, 2, 3, 4), 2)) == [2, 3]
    with pytest.raises(NotImplementedError):
        token_math.kl(F.lit(0.0), F.lit(0.0), "full")
    with pytest.raises(NotImplementedError):
        advantage.advantage(one, "none")


def test_clustered_majority():
    same = lambda a, b: abs(int(a) - int(b)) <= 1
    assert evaluation.clustered_majority(["1", "2", "3", "9"], same) == "1"
    assert evaluation.clustered_majority([], same) is None


def test_loop(spark):
    ship_package(spark)
    assert loop.arithmetic("x = 2\nprint(x * 3)") == ("6", "Done") and loop.arithmetic("import os")[1].startswith("Error") and loop.arithmetic("")[1] == "empty code"
    p = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "idx long, query string")
    forever = lambda qs: [("\n```python\nprint(1)\n```\n", -1.0, 2)] * len(qs)
    out = loop.generate_with_tools(p, forever, most_rounds=3).collect()
    assert {r.rounds for r in out} == {3} and all(r["query"].count("```output") == 2 and "used up" in r["query"] for r in out)
    assert len(loop.regrouped(loop.generate_with_tools(p, forever, most_rounds=1), 2).collect()) == 2


def test_preparation(spark):
    d = spark.createDataFrame([(0, "a", "b [title] x  y", "act", "1", ["e1", "e2"]), (1, "a", "B", "act", "", ["e"])], "row_id long, ctx_a string, ctx_b string, activity_label string, label string, endings array<string>")
    rows = prep.completion_rows(d, "train").collect()
    assert len(rows) == 1 and rows[0].extra_info["index"] == 0 and rows[0].prompt[0].content == "act: a B. x y"
    with pytest.raises(Exception, match="without number"):
        prep.arithmetic_rows(spark.createDataFrame([(0, "q", "none")], "row_id long, question string, answer string"), "train", "go").collect()
    c = prep.competition_rows(spark.createDataFrame([(0, "q", r"\boxed{7}")], "row_id long, problem string, solution string"), "train", "go").first()
    assert c.reward_model.ground_truth == "7" and c.prompt[0].content == "q go"


def test_sources(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.createDataFrame([("p", "1", "q", None)], "problem string, gt_answer string, prompt string, source string")
    tables.write_json_lines(df, path)
    tables.write_json_lines(df, path)
    assert tables.json_lines(spark, path).count() == 2
    tables.write_parquet(df, path + "p")
    tables.write_parquet(df, path + "p", resume=True)
    assert tables.parquet(spark, path + "p").columns == df.columns
    with pytest.raises(ValueError):
        tables.non_empty(df.limit(0), "prompt")
    assert tables.console_line(3, {"a": 1, "b": "x"}) == "step:3 - a:1.000"
    assert '"k": 1.5' in tables.metrics_document(spark.createDataFrame([("s", "k", 1.5)], "source string, metric string, value double"))
    assert tables.table_bytes(df).first().problem == 1


def test_streaming_controller_matches_fold(spark, tmp_path):
    rows = [("a", 0, 0.1, 5), ("a", 1, 0.01, 5), ("b", 0, 0.5, 10), ("a", 2, 0.2, 5)]
    df = spark.createDataFrame(rows, "run string, step long, kl double, n long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = controllers.kl_coefficients(stream, 0.2, 0.05, 100.0).writeStream.format("memory").queryName("kl").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    last = {r.run: r.coefficient for r in spark.sql("select run, max_by(coefficient, step) coefficient from kl group by run").collect()}
    assert last == pytest.approx({r.run: r.coefficient for r in controllers.kl_fold(df, 0.2, 0.05, 100.0).collect()})


def test_native_text_columns(spark):
    d = spark.createDataFrame([("x" * 900, "aBC d", "print(input())", r"\boxed{2}")], "t string, c string, p string, v string")
    r = d.select(F.length(answers.middle_cut_column(F.col("t"))), answers.capitalised(F.col("c")), answers.blocked_code(F.col("p")), answers.judge_score(F.col("v")), answers.is_error_output(F.lit("A Traceback"))).first()
    assert list(r) == [803, "Abc d", True, 0.1, True]


def test_cosine_blocks_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "QUERY_BLOCK", 8)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(0, 1, 16).tolist()) for i in range(400)]
    rows += [(1000 + i, list(v)) for i, (_, v) in enumerate(rows[:50])]  # ties
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [1.0, None]), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, [1.0, 2.0]), (2101, [2.0, 4.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in evaluation.cosine_top_k_blocks(df, df.where("vec_id % 20 = 0"), 5).collect())
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    s = np.round((v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2), 12)
    want = [(int(q), n + 1, int(ids[c])) for at, q in enumerate(ids) if q % 20 == 0 for n, c in enumerate(np.lexsort((ids, -s[at]))[:5])]
    assert got == sorted([*want, (2100, 1, 2100), (2100, 2, 2101)])
    assert evaluation.cosine_top_k_blocks(df.limit(0), df.limit(0), 5).count() == 0


def test_every_twentieth_vector_is_searched(spark):
    from tracelake import registry

    got = registry.queries()["cosine_topk_blocks"](spark, "/root/testdata/sf0.001").groupBy("query_id").count().collect()
    n = registry.read(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id % 20 = 0").count()
    assert len(got) == n and all(x["count"] == 5 for x in got)


def test_rewards_run_only_on_their_rows(spark):
    from tracelake.functions import rewards

    def strict(solution, truth):
        if solution != "mine":
            raise ValueError("foreign row")
        return 1.0

    df = spark.createDataFrame([("a1", "mine", "t", None), ("b1", "other", "t", None), ("zz", "x", "t", 0.25)], "data_source string, solution string, ground_truth string, rm_score double")
    got = {r.data_source: r.score for r in rewards.scored(df, {"a": strict, "b": lambda s, t: 0.5}).collect()}
    assert got == {"a1": 1.0, "b1": 0.5, "zz": 0.25}
    with pytest.raises(Exception):
        rewards.scored(df.withColumn("rm_score", F.lit(None).cast("double")), {"a": strict}).collect()


def test_controllers_by_kind():
    value, step = controllers.controller("fixed", 0.3)
    assert step(value, 9.0, 4) == 0.3
    value, step = controllers.controller("adaptive", 0.3, 0.1, 100.0)
    assert step(value, 0.2, 10) == pytest.approx(0.3 * (1 + 0.2 * 10 / 100))
    for bad in (("other", 1.0), ("adaptive", 1.0, 0.1, 0.0)):
        with pytest.raises(ValueError):
            controllers.controller(*bad)


def test_suffix_sums_and_majority_by_equality(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)] + [(2, 0, 7.0)], "s int, at int, r double")
    got = {(r.s, r.at): r.returns for r in advantage.suffix_returns(df, "s", [F.col("at")], F.col("r")).collect()}
    assert got == {(1, 0): 10.0, (1, 1): 10.0, (1, 2): 9.0, (1, 3): 7.0, (1, 4): 4.0, (2, 0): 7.0}
    votes = spark.createDataFrame([(1, "1/2", 1), (1, "0.5", 2), (1, "3", 3), (2, "x", 5), (2, "y", 4), (3, None, 1), (3, None, 2), (3, "1", 3)], "p int, a string, at int")
    same = lambda x, y: {x, y} == {"1/2", "0.5"}
    assert sorted(map(tuple, evaluation.majority_by_equality(votes, "p", "a", "at", same).collect())) == [(1, "1/2", 2), (2, "y", 1), (3, None, 2)]
