"""Programs, verdicts with a time limit, and token and batch helpers."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tracelake.functions import token_math
from tracelake.operators import balance, batch
from tracelake.plans import execute, prep


def test_outcomes():
    assert execute.outcome("x = 2\nprint(x * 3)\nprint(x, 1)") == ("6\n2 1", "Done")
    assert execute.outcome("x = 2\ny = x ** 5", "symbol", "y") == ("32", "Done")
    assert execute.outcome("x = 2", "expression", "x / 4 - 1") == ("-0.5", "Done")
    assert execute.outcome("x = 2\nx * 21", "last_line") == ("42", "Done")
    assert execute.outcome("y + 1", "last_line", names={"y": 4}) == ("5", "Done")
    assert execute.outcome(None) == execute.outcome(" \n") == ("", "empty code")
    assert execute.outcome("y + 1", "last_line") == ("", "Error: KeyError")  # names of one program are not another's
    assert execute.outcome("x = (", "symbol", "x")[1] == "Error: SyntaxError" and execute.outcome("x = 1 / 0")[1] == "Error: ZeroDivisionError"
    assert execute.outcome("x = (-8) ** 0.5")[1] == "Error: ValueError" and execute.outcome("__import__('os')")[1] == "Error: ValueError"


def test_outcomes_end():
    grown = "a = 7\n" + "a = a * a\n" * 60
    for code in (grown, "a = 9 ** 9 ** 9", "a = 1" + " + 1" * 400 + "\n" + "b = a\n" * 10):
        start = time.perf_counter()
        execute.outcome(code)
        assert time.perf_counter() - start < 2
    assert execute.outcome(grown)[1] == execute.outcome("a = 9 ** 9 ** 9")[1] == "Timeout Error"


def test_executed(spark):
    def own(code):
        return code.upper(), "Done"

    df = spark.createDataFrame([(1, "print(1)"), (2, None), (3, ""), (4, "print(1)")], "id int, code string")
    got = execute.executed(df, execute=own).select("id", "outcome.*").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "PRINT(1)", "Done"), (2, "", "Error: AttributeError"), (3, "", "Done"), (4, "PRINT(1)", "Done")]
    assert [r.outcome.report for r in execute.executed(df).orderBy("id").collect()] == ["Done", "empty code", "empty code", "Done"]
    assert execute.executed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        execute.executed(df, answer="guess")


def test_verified(spark):
    def slow(given, wanted):
        while given == "loop":
            pass
        return given == wanted

    df = spark.createDataFrame([("a", "1", "1"), ("a", "loop", "1"), ("b", "2", "1"), (None, None, "1"), ("c", "loop", "2")], "source string, solution string, truth string")
    graded = execute.verified(df, slow, seconds=0.2)
    assert {r.verify_error for r in graded.where("solution = 'loop'").collect()} == {"TimeoutError"}
    got = {r.source: (r.sample_size, r.accuracy, r.num_verify_error) for r in execute.verified_report(graded).collect()}
    assert got == {"a": (1, 1.0, 2), "b": (1, 0.0, 2), "NA": (1, 0.0, 2), "c": (0, None, 2)}


def test_unpad_repad(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], [0, 1, 0, 1]), ([5, 6], [0, 0]), ([5, 6], [1, 1]), ([], [])], "v array<int>, m array<int>")
    u = df.withColumn("u", token_math.unpadded(F.col("v"), F.col("m")))
    got = u.select("u.*", token_math.repadded(F.col("u.values"), F.col("u.places"), F.size("m"), -1).alias("r")).collect()
    assert [(r["values"], r.places, r.r) for r in got] == [([6, 8], [1, 3], [-1, 6, -1, 8]), ([], [], [-1, -1]), ([5, 6], [0, 1], [5, 6]), ([], [], [])]


def test_sampled_tokens(spark):
    logits = F.array(F.lit(math.log(0.2)), F.lit(math.log(0.7)), F.lit(math.log(0.1)), F.lit(float("-inf")))
    df = spark.range(20000).select("id", token_math.sampled_token(logits, 3, F.col("id")).alias("t"), token_math.next_token(logits, F.col("id") < 0, 3, F.col("id")).alias("best"))
    share = {r.t: r["count"] / 20000 for r in df.groupBy("t").count().collect()}
    assert share == pytest.approx({0: 0.2, 1: 0.7, 2: 0.1}, abs=0.02) and df.where("best <> 1").isEmpty()


def test_batches(spark):
    df = spark.createDataFrame([(0, [1, 2], [3, 4]), (1, [1], [3])], "row_id long, a array<int>, b array<int>")
    assert batch.consistent(df, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="differ"):
        batch.consistent(df.withColumn("b", F.array(F.lit(1))), ["a", "b"]).collect()
    assert batch.overridden({"a": 1, "b": 2}, {"b": 3, "c": 4}) == {"a": 1, "b": 3}
    metrics = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "key string, value double")
    assert {r.key: r.mean for r in batch.reduced(metrics).collect()} == {"x": 2.0, "y": 5.0}
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    first, again, later = (sorted((r.row_id, r["rank"]) for r in batch.rank_batches(rows.repartition(p), 4, 5, e).collect()) for p, e in ((1, 0), (3, 0), (1, 1)))
    assert first == again != later and len(first) == 8
    assert {r.row_id for r in batch.rank_batches(rows, 4, 5, drop_last=False).collect()} == set(range(10))


def test_micro_batches(spark):
    df = spark.createDataFrame([(i, 10 + i, i // 6) for i in range(12)], "id long, n long, step long")
    parts = balance.micro_batches(df, "id", "n", 40, "step")
    got = {r.batch: (r.parts, r.n) for r in parts.groupBy("batch").agg(F.max("parts").alias("parts"), F.countDistinct("part_id").alias("n")).collect()}
    assert got == {0: (2, 2), 1: (3, 3)}
    assert {r.parts for r in balance.micro_batches(df, "id", "n", 40, "step", fewest=3).collect()} == {3}
    assert {r.parts for r in balance.micro_batches(df, "id", "n", 1, "step").collect()} == {6}
    assert sorted(r.place for r in balance.part_order(parts).where("batch = 1").collect()) == list(range(6))


def test_rendered_again(spark):
    df = spark.createDataFrame([(1, [104, 105, 0], [("user", "a")]), (2, None, None)], "id int, ids array<long>, chat array<struct<role:string,content:string>>")
    got = prep.rendered_again(df, "ids", "chat", lambda ids: "".join(chr(i) if i else "#" for i in ids), lambda turns: [ord(c) for t in turns for c in t["role"][0] + t["content"]], 5, 0, "#").orderBy("id").collect()
    assert [(r.input_ids, r.attention_mask) for r in got] == [([117, 97, 97, 104, 105], [1] * 5), ([97, 0, 0, 0, 0], [1, 0, 0, 0, 0])]


def test_splits_and_prompts(spark):
    rows = spark.range(6).withColumnRenamed("id", "row_id")
    got = sorted((r.row_id, r.split) for r in prep.reward_split(rows, 0.75).collect())
    assert got == [(0, "train"), (1, "train"), (2, "train"), (3, "train"), (4, "test"), (5, "test")]
    assert len(prep.reward_split(rows.limit(2), 0.75).collect()) == 2
    with pytest.raises(Exception, match="template"):
        spark.range(1).select(prep.prompts(F.lit("q"), F.lit("x"), {"y": "{question}"})).collect()
    assert spark.range(1).select(prep.without_pad(F.array(F.lit("a<p>"), F.lit("<p>b")), "<p>").alias("t")).first().t == "a\nb"


def test_a_grader_in_c_code_costs_its_row_only(spark):
    def grade(given, wanted):
        import ctypes
        import os

        if given == "13":
            ctypes.CDLL(None).sleep(600)  # no signal handler of Python's runs here
        if given == "17":
            os._exit(3)
        if given == "19":
            raise KeyError
        return given == wanted

    df = spark.range(1000, numPartitions=3).selectExpr("CAST(id AS STRING) AS solution", "CAST(id - id % 2 AS STRING) AS truth", "'s' AS source")
    graded = execute.verified(df, grade, seconds=1.0)
    got = {r.solution: (r.correct, r.verify_error) for r in graded.collect()}
    assert len(got) == 1000 and got["13"] == (None, "TimeoutError") and got["17"] == (None, "Crashed") and got["19"] == (None, "KeyError")
    assert all(v == (int(k) % 2 == 0, None) for k, v in got.items() if k not in ("13", "17", "19"))
    report = execute.verified_report(graded).first()
    assert (report.sample_size, report.num_verify_error) == (997, 3) and abs(report.accuracy - 500 / 997) < 1e-12


def test_an_executor_that_hangs(spark):
    def run(code):
        while code == "hang":
            pass
        return code.upper(), "Done"

    df = spark.createDataFrame([(k, "hang" if k == 3 else f"p{k}") for k in range(20)], "id long, code string").repartition(2)
    got = {r.id: tuple(r.outcome) for r in execute.executed(df, execute=run, seconds=0.5).collect()}
    assert got == {k: ("", "Timeout Error") if k == 3 else (f"P{k}", "Done") for k in range(20)}
