"""Symbolic equality at scale: distinct pairs graded once, and answers grouped by canonical form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import symbolic
from ..functions.answers import same_expression
from ..plans.ship import ship_package

Same = Callable[[str | None, str | None], bool]


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Few rows that cost much each: over all tasks, whatever their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def graded(df: DataFrame, given: str, truth: str, out: str = "same", same: Same = same_expression) -> DataFrame:
    """``df`` with a verdict for each row; each distinct pair is graded once, spread over all tasks.

    ``same`` is a function of two texts, of which either may be None.  Rows with equal pairs,
    null ones included, share their verdict; no row is lost or repeated.
    """
    ship_package(df.sparkSession)
    names = [F.col(f"`{given}`").cast("string").alias("_given"), F.col(f"`{truth}`").cast("string").alias("_truth")]

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts = [bool(same(x, y)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(verdicts, pa.bool_())], names=["_g", "_t", out])

    pairs = _spread(df.select(*names).distinct(), "_given", "_truth").mapInArrow(grade, f"_g string, _t string, `{out}` boolean")
    on = F.col("_given").eqNullSafe(F.col("_g")) & F.col("_truth").eqNullSafe(F.col("_t"))
    return df.select("*", *names).join(pairs, on, "left").drop("_given", "_truth", "_g", "_t")


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds letters, key, values and the grid cell of the first value to rows whose second column is an answer."""
    for b in batches:
        forms = [symbolic.form(x) if x is not None else symbolic.Form() for x in b.column(1).to_pylist()]
        values = [f.values for f in forms]
        more = [pa.array([sorted(f.letters) for f in forms], pa.list_(pa.string())), pa.array([f.key for f in forms], pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array([symbolic.cell(v[0]) if v else None for v in values], pa.int64())]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "letters", "key", "points", "cell"])


def _close(a: Column, b: Column) -> Column:
    within = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) * symbolic.TOLERANCE
    return F.forall(F.zip_with(a, b, within), lambda x: x)


def classes_by_form(attempts: DataFrame, problem: str, answer: str, order: str) -> DataFrame:
    """Classes of equal answers: ``problem, answer, votes, first, class_first, class_answer``, a row for each distinct answer.

    ``first`` is the answer's smallest ``order``; a class is named by its first answer.
    Answers with a canonical form are grouped by it.  Others meet those of their problem, with
    and without one, that have nearly the same value at the first probe: equal answers lie in
    the same or in neighbouring cells of a grid, so they meet in an equi-join and no task
    holds a problem.  A null answer, and what can't be read, equals its own text only.  Equality
    is taken as transitive, which the probes' tolerance lets it be.
    """
    ship_package(attempts.sparkSession)
    texts = attempts.groupBy(F.col(problem).alias("problem"), F.col(answer).cast("string").alias("answer")).agg(F.count("*").alias("votes"), F.min(F.col(order).cast("long")).alias("first"))
    kind = dict(texts.dtypes)["problem"]
    formed = _spread(texts, "problem", "answer").mapInArrow(_forms, f"problem {kind}, answer string, votes long, first long, letters array<string>, key string, points array<double>, cell long")
    start = F.struct("first", "answer")
    # what decides: the canonical form, else the text itself
    node = F.when(F.col("key").isNotNull(), F.struct(F.lit("form").alias("kind"), F.col("key").alias("name"))).otherwise(F.struct(F.lit("text").alias("kind"), F.col("answer").alias("name")))
    formed = formed.withColumn("node", node)
    nodes = formed.groupBy("problem", "node").agg(F.min(start).alias("start"), *(F.min_by(c, start).alias(c) for c in ("letters", "points", "cell")))
    seekers = nodes.where("node.kind = 'text' AND cell IS NOT NULL")
    asks = seekers.select(F.col("problem").alias("_p"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("_c"), F.col("node").alias("a"), F.col("start").alias("a_start"), F.col("letters").alias("a_letters"), F.col("points").alias("a_points"))
    met = asks.join(nodes, F.col("problem").eqNullSafe(F.col("_p")) & (F.col("cell") == F.col("_c"))).where((F.size(F.array_union("letters", "a_letters")) <= 2) & _close(F.col("points"), F.col("a_points")))
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("start")), F.struct(F.col("node"), F.col("a_start").alias("start")))).alias("x")
    least = met.select("problem", both).groupBy("problem", "x.node").agg(F.min("x.start").alias("least"))
    named = nodes.select("problem", "node", "start").join(least.withColumnRenamed("problem", "_p").withColumnRenamed("node", "_n"), F.col("problem").eqNullSafe(F.col("_p")) & F.col("node").eqNullSafe(F.col("_n")), "left")
    named = named.select(F.col("problem").alias("_p"), F.col("node").alias("_n"), F.least("start", F.coalesce("least", "start")).alias("name"))
    out = formed.join(named, F.col("problem").eqNullSafe(F.col("_p")) & F.col("node").eqNullSafe(F.col("_n")))
    return out.select(F.col("problem").alias(problem), F.col("answer"), "votes", "first", F.col("name.first").alias("class_first"), F.col("name.answer").alias("class_answer"))


def majority_by_form(attempts: DataFrame, problem: str, answer: str, order: str) -> DataFrame:
    """``problem, majority, votes``: the largest class of equal answers, of equals the earliest, by its first answer."""
    sums = classes_by_form(attempts, problem, answer, order).groupBy(problem, "class_first", "class_answer").agg(F.sum("votes").alias("votes"))
    # of classes that begin at the same place, the one whose answer sorts first; a null one before all
    best = F.min(F.struct((-F.col("votes")).alias("minus"), "class_first", "class_answer")).alias("best")
    return sums.groupBy(problem).agg(best).select(problem, F.col("best.class_answer").alias("majority"), (-F.col("best.minus")).alias("votes"))
