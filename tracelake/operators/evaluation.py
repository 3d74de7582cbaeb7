"""Evaluation reports over graded attempts, batch metrics, and selection by reward."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from ..sources.shared import keep
from . import quantiles

MISSING = -1.0
QUERY_BLOCK, TILE, CANDIDATES = 4096, 128, 4096


def pass_and_average(attempts: DataFrame, source: str = "source", problem: str = "problem", correct: str = "correct") -> DataFrame:
    """By source: ``pass_at_k`` (share of problems with a correct attempt), ``avg_at_k`` (mean over problems of the mean), ``problems``, ``attempts``."""
    by = F.coalesce(F.col(source), F.lit("NA")).alias("source")
    c = F.col(correct).cast("double")
    one = attempts.groupBy(by, F.col(problem).alias("problem")).agg(F.max(c).alias("any"), F.avg(c).alias("mean"), F.count("*").alias("n"))
    return one.groupBy("source").agg(F.avg("any").alias("pass_at_k"), F.avg("mean").alias("avg_at_k"), F.count("*").alias("problems"), F.sum("n").alias("attempts"))


def majority(attempts: DataFrame, problem: str, answer: str, order: list[Column]) -> DataFrame:
    """The most frequent answer of each problem; of equals the one given first, then by text."""
    votes = attempts.groupBy(problem, answer).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(problem).orderBy(F.desc("votes"), "_first", answer)
    return votes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(problem, F.col(answer).alias("majority"), "votes")


def clustered_majority(problem_answers: list[str], same) -> str | None:
    """Majority under an equality that is no key: answers join the first group whose first member equals them."""
    groups: list[list[str]] = []
    for a in problem_answers:
        for g in groups:
            if same(g[0], a):
                g.append(a)
                break
        else:
            groups.append([a])
    return max(groups, key=len)[0] if groups else None


def majority_by_equality(attempts: DataFrame, problem: str, answer: str, order: str, same: Callable[[str, str], bool]) -> DataFrame:
    """Majority of each problem under an equality that is no key: ``problem, majority, votes``.

    Equal texts are counted first, so a task sees a problem's distinct answers only; they
    join the first group whose first member equals them, in the order they came (``order``,
    a whole number).  The largest group wins, of equals the earliest, with its first answer.
    A null answer equals itself only.
    """
    ship_package(attempts.sparkSession)
    texts = attempts.groupBy(F.col(problem).alias("problem"), F.col(answer).cast("string").alias("answer")).agg(F.count("*").alias("votes"), F.min(F.col(order).cast("long")).alias("first"))
    kind = dict(texts.dtypes)["problem"]

    def choose(table: pa.Table) -> pa.Table:
        groups: list[list] = []
        for r in table.sort_by("first").to_pylist():
            found = next((g for g in groups if g[0] == r["answer"] or None not in (g[0], r["answer"]) and same(g[0], r["answer"])), None)
            if found:
                found[1] += r["votes"]
            else:
                groups.append([r["answer"], r["votes"]])
        best = max(groups, key=lambda g: g[1])
        return pa.table({"problem": table["problem"].slice(0, 1), "majority": pa.array([best[0]], pa.string()), "votes": pa.array([best[1]], pa.int64())})

    return texts.groupBy("problem").applyInArrow(choose, f"problem {kind}, majority string, votes long").withColumnRenamed("problem", problem)


def lengths_by_correctness(attempts: DataFrame, source: str, correct: Column, length: str) -> DataFrame:
    """Pooled mean lengths of right, wrong and all attempts; -1 where there is none."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(length))), F.lit(MISSING))
    return attempts.groupBy(source).agg(mean(correct).alias("correct_length"), mean(~correct).alias("wrong_length"), mean(F.lit(True)).alias("length"))


def sequence_entropy(logprob: Column, length: Column) -> Column:
    """``-exp(a) * a`` of the mean log-probability; null for an empty sequence."""
    a = F.try_divide(logprob, length)
    return -F.exp(a) * a


def entropy_stats(df: DataFrame, group: str, value: str, few: int = quantiles.FEW) -> DataFrame:
    """Mean, population deviation, its ratio, range and exact quartiles by group; no task holds more than ``few`` values of a group."""
    sums = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))
    q = quantiles.exact_quantiles(df, group, value, [0.25, 0.5, 0.75], few).withColumnRenamed(group, "_q")
    out = sums.join(q, F.col(group).eqNullSafe(F.col("_q")), "left")
    return out.select(group, "mean", "std", F.try_divide("std", "mean").alias("cv"), "range", *(F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))))


def offline_scores(df: DataFrame, scores: str) -> DataFrame:
    """Mean of all scores, and share of rows whose best is 1."""
    flat = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return df.agg((F.sum(flat) / F.sum(F.size(scores))).alias("pass_at_1"), F.avg((F.array_max(scores) == 1).cast("double")).alias("pass_at_n"))


def explained_variance(df: DataFrame, value: str, returns: str, mask: str | None = None) -> DataFrame:
    d = df.where(F.col(mask) == 1) if mask else df
    return d.agg((1 - F.var_samp(F.col(returns) - F.col(value)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def batch_metrics(sequences: DataFrame, width: int) -> DataFrame:
    """Mean, max and min of score, reward and response length, and the share of full-length responses."""
    stats = [f(c).alias(f"{c}_{n}") for c in ("score", "reward", "response_length") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return sequences.agg(*stats, F.avg((F.col("response_length") == width).cast("double")).alias("clip_ratio"))


def _valid(values: str, mask: str) -> Column:
    """Count, sum, smallest, largest and squared deviations of an array where its mask is 1, in one fold and one more over the same row."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    kept = F.transform(F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1), lambda x: x["v"].cast("double"))
    fold = F.aggregate(kept, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), F.least(a["lo"], x).alias("lo"), F.greatest(a["hi"], x).alias("hi")))
    return fold


def data_metrics(sequences: DataFrame, response_width: int, prompt_width: int, values: str | None = None, scores: str = "token_level_scores", rewards: str = "token_level_rewards", advantages: str = "advantages", returns: str = "returns", mask: str = "response_mask", prompt_length: str = "prompt_length") -> DataFrame:
    """A batch's metrics at two grains in one pass, as one row.

    A row is a sequence; arrays have an element a response token, and ``mask`` is 1 on valid
    ones.  Scores and rewards are summed over a whole sequence, valid or not; ``advantages``,
    ``returns`` and, if given, ``values`` are pooled over valid tokens; lengths count a
    sequence's tokens, and a clip ratio is the share of those as long as the width.  With
    values, ``vf_explained_var`` is 1 - var(returns - values) / (var(returns) + 1e-5), with
    sample variances.

    Each array is folded within its row to count, sum, smallest and largest, and variances to
    their mean and squared deviations; these moments are added, so nothing is exploded and
    the table is read once.  No valid token at all gives nulls.
    """
    pooled = [advantages, returns, *[values] * (values is not None)]
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    length = F.aggregate(F.col(mask), F.lit(0).cast("long"), lambda a, x: a + x)
    row = sequences.select(total(scores).alias("score"), total(rewards).alias("reward"), length.alias("response_length"), F.col(prompt_length).cast("long").alias("prompt_length"), *(_valid(c, mask).alias(f"_{k}") for k, c in enumerate(pooled)), *_deviations(returns, values, mask))
    out = [f(c).alias(f"{c}_{n}") for c in ("score", "reward", "response_length", "prompt_length") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    out += [F.avg((F.col(f"{c}_length") == w).cast("double")).alias(f"{c}_length_clip_ratio") for c, w in (("response", response_width), ("prompt", prompt_width))]
    for k, name in enumerate(("advantages", "returns", "values")[: len(pooled)]):
        out += [F.try_divide(F.sum(f"_{k}.s"), F.sum(f"_{k}.n")).alias(f"{name}_mean"), F.max(f"_{k}.hi").alias(f"{name}_max"), F.min(f"_{k}.lo").alias(f"{name}_min")]
    if values is not None:
        out.append((1 - F.try_divide(_pooled_variance("_rest"), _pooled_variance("_own") + 1e-5)).alias("vf_explained_var"))
    return row.agg(*out)


def _deviations(returns: str, values: str | None, mask: str) -> list[Column]:
    """Count, mean and squared deviations from it, of a row's valid returns and of what values leave of them."""
    if values is None:
        return []
    zipped = F.filter(F.arrays_zip(F.col(returns).alias("r"), F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1)
    out = []
    for name, pick in (("_own", lambda x: x["r"].cast("double")), ("_rest", lambda x: x["r"].cast("double") - x["v"].cast("double"))):
        kept = F.transform(zipped, pick)
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def fold(a: Column, x: Column) -> Column:  # one value more
            n, gap = a["n"] + 1, x - a["mean"]
            mean = a["mean"] + gap / n
            return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + gap * (x - mean)).alias("m2"))

        out.append(F.aggregate(kept, zero, fold).alias(name))
    return out


def _pooled_variance(c: str) -> Column:
    """The sample variance of all rows' values from their counts, means and squared deviations."""
    n, mean = F.col(f"{c}.n"), F.col(f"{c}.mean")
    total = F.sum(n)
    between = F.sum(n * mean * mean) - F.try_divide(F.sum(n * mean) * F.sum(n * mean), total)
    return F.try_divide(F.sum(f"{c}.m2") + between, total - 1)


def timing_per_token(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Milliseconds a token of the sections that both tables have."""
    return timings.join(tokens, "section").select("section", (F.col("seconds") * 1000 / F.col("tokens")).alias("ms_per_token"))


def report(attempts: DataFrame) -> DataFrame:
    """``(source, k, metric, value)`` of graded attempts ``(source, problem, sample, correct, majority_correct?, length, entropy)``."""
    base = pass_and_average(attempts)
    a = attempts.withColumn("source", F.coalesce("source", F.lit("NA")))
    lengths = lengths_by_correctness(a, "source", F.col("correct") == 1, "length")
    entropy = a.groupBy("source", "problem").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s"))
    entropy = entropy.groupBy("source").agg(F.avg("m").alias("entropy_mean"), F.avg(F.try_divide("s", "m")).alias("entropy_cv"))
    wide = base.join(lengths, "source").join(entropy, "source").withColumn("k", F.round(F.col("attempts") / F.col("problems")).cast("int"))
    metrics = ("pass_at_k", "avg_at_k", "correct_length", "wrong_length", "length", "entropy_mean", "entropy_cv", "problems")
    return wide.unpivot(["source", "k"], [F.coalesce(F.col(m).cast("double"), F.lit(MISSING)).alias(m) for m in metrics], "metric", "value")


def mixed_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards are neither all 0 nor all 1."""
    w = Window.partitionBy(group)
    d = df.withColumns({"_lo": F.min(reward).over(w), "_hi": F.max(reward).over(w)})
    return d.where(~(((F.col("_lo") == 0) & (F.col("_hi") == 0)) | ((F.col("_lo") == 1) & (F.col("_hi") == 1)))).drop("_lo", "_hi")


def solve_counts(df: DataFrame, group: str, reward: str) -> DataFrame:
    """How many groups solve none, all, or some."""
    g = df.groupBy(group).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    none, every = (F.col("lo") == 0) & (F.col("hi") == 0), (F.col("lo") == 1) & (F.col("hi") == 1)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return g.agg(count(none).alias("solve_none"), count(every).alias("solve_all"), count(~(none | every)).alias("solve_some"))


def flops(lengths: DataFrame, length: str, parameters: float, layers: int, heads: int, head_size: int) -> DataFrame:
    """Estimated training operations of a batch, in units of 1e12."""
    n, squares = F.sum(F.col(length).cast("double")), F.sum(F.col(length).cast("double") * F.col(length))
    return lengths.agg(((6.0 * parameters * n + 12.0 * squares * (layers * heads * head_size)) / 1e12).alias("tera_flops"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of a few stated queries by cosine; ties to the smaller key.

    Queries are a handful of rows that the caller states; they are joined to every vector,
    and each task keeps ``k`` a query before anything is shuffled.
    """
    from ..functions.token_math import cosine

    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    scored = vectors.crossJoin(q).select("query_id", key, cosine(F.col(vector), F.col("_q")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and rows of length one, by vector length; vectors without a direction are left out."""
    keys, lists = np.asarray(batch.column(0)), batch.column(1)
    starts = np.asarray(lists.offsets)
    lengths, flat, starts = np.diff(starts), np.asarray(lists.values), starts[:-1]
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        rows = flat[starts[at][:, None] + np.arange(d)]
        norm = np.sqrt((rows * rows).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        if fine.any():
            yield keys[at][fine], rows[fine] / norm[fine][:, None]


def _nearest(sent, k: int):
    """Each task's ``k`` best candidates of each sent query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)) for d, (_, q) in sent.value.items()}
        for batch in batches:
            for own, rows in _unit_rows(batch):
                if rows.shape[1] not in best:
                    continue
                q, (score, key) = sent.value[rows.shape[1]][1], best[rows.shape[1]]
                for c in range(0, len(own), CANDIDATES):
                    for a in range(0, len(q), TILE):
                        tile, near = slice(a, a + TILE), slice(c, c + CANDIDATES)
                        s = np.einsum("qd,vd->qv", q[tile], rows[near])  # a pair's sum doesn't depend on its place
                        i, j = np.nonzero(s >= score[tile, -1:])
                        old = np.nonzero(score[tile] > -np.inf)
                        x, y = np.concatenate((score[tile][old], s[i, j])), np.concatenate((key[tile][old], own[near][j]))
                        i = np.concatenate((old[0], i))
                        order = np.lexsort((y, -x, i))
                        i, x, y = i[order], x[order], y[order]
                        place = np.arange(len(i)) - np.searchsorted(i, i)
                        top = place < k
                        score[a + i[top], place[top]], key[a + i[top], place[top]] = x[top], y[top]
        for d, (score, key) in best.items():
            at, place = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][at]), pa.array(key[at, place]), pa.array(score[at, place])], names=["query_id", "key", "score"])

    return run


def cosine_top_k_blocks(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``cosine_top_k`` for any number of queries: ``query_id``, key, ``score``, ``rank``.

    A block of at most ``QUERY_BLOCK`` queries is sent to every task, which reads each vector
    once for it and keeps ``k`` a query.  A query is a candidate of its own.  Rows with a
    null key or vector, a null or non-finite component or no direction take no part; vectors
    of another length are no candidates.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e))
    put = lambda df: df.where(fine).select(F.col(key).cast("long").alias("key"), x.alias("v"))
    data, asked = put(vectors), put(queries)
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK * 7 // 8)))  # hashed blocks differ in size
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b) if blocks > 1 else asked
        held: dict[int, list] = {}
        for batch in part.toArrow().to_batches():
            for own, rows in _unit_rows(batch):
                held.setdefault(rows.shape[1], []).append((own, rows))
        sent = spark.sparkContext.broadcast({d: tuple(map(np.concatenate, zip(*parts))) for d, parts in held.items()})
        got = data.mapInArrow(_nearest(sent, k), "query_id long, key long, score double")
        got = keep(got, "cosine-top-k") if blocks > 1 else got
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def running_totals(turns: DataFrame, sequence: str, order: list[Column], values: list[str]) -> DataFrame:
    """Each turn with the sums of ``values`` up to it."""
    w = Window.partitionBy(sequence).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumns({f"{v}_so_far": F.sum(v).over(w) for v in values})


def sharded_entropy(logits: DataFrame, key: str, logit: str) -> DataFrame:
    """Softmax entropy of logits that lie in many rows: a maximum first, then sums shifted by it.

    Both steps combine partial results before the shuffle, as vocabulary shards would.
    """
    top = logits.groupBy(key).agg(F.max(logit).alias("_top"))
    shifted = logits.join(top, key).withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
    sums = shifted.groupBy(key).agg(F.max("_top").alias("_top"), F.sum("_e").alias("_z"), F.sum(F.col("_e") * F.col(logit)).alias("_x"))
    return sums.select(key, (F.col("_top") + F.ln("_z") - F.col("_x") / F.col("_z")).alias("entropy"))


def time_use(runs: DataFrame, seconds: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and sum of the time that runs took."""
    return runs.groupBy(*(by or [])).agg(F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("deviation"), F.sum(seconds).alias("total"))


def norms(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The norm over all arrays of each key: partial sums of squares, then one root."""
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.groupBy(key).agg(F.sqrt(F.sum(squares)).alias("norm"))
