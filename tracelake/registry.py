"""The engine's registered queries over the test tables, with equivalent DuckDB SQL.

Floats are put on a grid of 1e-6 by ``floor(x * 1e6 + 0.5) / 1e6`` on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import answers, blocks, rewards, token_math, tokens
from .operators import advantage, balance, batch, evaluation, grading
from .plans import execute, exchange, loop, prep
from .plans.ship import ship_package
from .sources import tables
from .streaming import controllers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(c: Column) -> Column:
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def g(sql: str) -> str:
    return f"floor(({sql}) * 1e6::double + 0.5::double) / 1e6::double"


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem rows as graded attempts: the order is the problem, its priority the source."""
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    o = o.select(F.col("o_orderkey").alias("problem"), F.col("o_orderpriority").alias("source"))
    a = li.select(F.col("l_orderkey").alias("problem"), (F.col("l_returnflag") == "A").cast("int").alias("correct"), F.col("l_quantity").alias("length"), (F.col("l_discount") + 0.01).alias("entropy"), F.concat("l_linestatus", "l_returnflag").alias("answer"), "l_partkey")
    return a.join(o, "problem")


ATTEMPTS = "(SELECT l_orderkey AS problem, o_orderpriority AS source, CAST(l_returnflag = 'A' AS INT) AS correct, l_quantity AS length, l_discount + 0.01::double AS entropy, l_linestatus || l_returnflag AS answer, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


# --- evaluation ---


@query(f"""WITH one AS (SELECT source, problem, max(correct) AS a, avg(correct) AS m, count(*) AS n FROM {ATTEMPTS} GROUP BY ALL)
SELECT source, {g('avg(a)')} AS pass_at_k, {g('avg(m)')} AS avg_at_k, count(*) AS problems, CAST(sum(n) AS BIGINT) AS attempts FROM one GROUP BY source""")
def pass_and_average_at_k(spark, sf):
    out = evaluation.pass_and_average(attempts(spark, sf))
    return out.withColumns({"pass_at_k": grid(F.col("pass_at_k")), "avg_at_k": grid(F.col("avg_at_k"))})


@query(f"""WITH a AS (SELECT * FROM {ATTEMPTS}), one AS (SELECT source, problem, max(correct) AS a, avg(correct) AS m, count(*) AS n, avg(entropy) AS em, stddev_pop(entropy) AS es FROM a GROUP BY ALL),
b AS (SELECT source, avg(a) AS pass_at_k, avg(m) AS avg_at_k, count(*) AS problems, CAST(round(sum(n) / count(*)) AS INT) AS k, avg(em) AS entropy_mean, avg(es / em) AS entropy_cv FROM one GROUP BY source),
l AS (SELECT source, coalesce(avg(length) FILTER (correct = 1), -1) AS correct_length, coalesce(avg(length) FILTER (correct <> 1), -1) AS wrong_length, avg(length) AS length FROM a GROUP BY source),
w AS (SELECT b.*, l.correct_length, l.wrong_length, l.length FROM b JOIN l USING (source))
SELECT source, k, metric, {g('value')} AS value FROM (SELECT source, k, unnest(['pass_at_k', 'avg_at_k', 'correct_length', 'wrong_length', 'length', 'entropy_mean', 'entropy_cv', 'problems']) AS metric,
unnest([pass_at_k, avg_at_k, correct_length, wrong_length, length, entropy_mean, entropy_cv, problems::double]) AS value FROM w)""")
def evaluation_report(spark, sf):
    return evaluation.report(attempts(spark, sf)).withColumn("value", grid(F.col("value")))


@query(f"""WITH v AS (SELECT problem, answer, count(*) AS votes, min(l_partkey) AS f FROM {ATTEMPTS} GROUP BY ALL)
SELECT problem, answer AS majority, votes FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY votes DESC, f, answer) AS rn FROM v) WHERE rn = 1""")
def majority_vote(spark, sf):
    return evaluation.majority(attempts(spark, sf), "problem", "answer", [F.col("l_partkey")])


@query(f"""WITH v AS (SELECT source, problem, answer, count(*) AS votes, min(l_partkey) AS f FROM {ATTEMPTS} GROUP BY ALL),
m AS (SELECT source, answer FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY votes DESC, f, answer) AS rn FROM v) WHERE rn = 1)
SELECT source, {g("coalesce(avg(CAST(answer = 'FA' OR answer = 'OA' AS INT)), -1)")} AS mj_at_k FROM m GROUP BY source""")
def majority_at_k(spark, sf):
    a = attempts(spark, sf)
    voted = evaluation.majority(a, "problem", "answer", [F.col("l_partkey")]).join(a.select("problem", "source").distinct(), "problem")
    return voted.groupBy("source").agg(grid(F.coalesce(F.avg(F.col("majority").endswith("A").cast("double")), F.lit(-1.0))).alias("mj_at_k"))


@query(f"""SELECT source, {g('coalesce(avg(n_chars) FILTER (quality = 1), -1)')} AS correct_length, {g('coalesce(avg(n_chars) FILTER (quality <> 1), -1)')} AS wrong_length, {g('coalesce(avg(n_chars), -1)')} AS length FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def length_by_correctness(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    out = evaluation.lengths_by_correctness(d, "source", F.col("quality") == 1, "n_chars")
    return out.select("source", *(grid(F.col(c)).alias(c) for c in ("correct_length", "wrong_length", "length")))


@query(f"""SELECT user_id, {g('avg(value)')} AS mean, {g('stddev_pop(value)')} AS std, {g('max(value) - min(value)')} AS range, {g('quantile_cont(value, 0.25)')} AS q25, {g('quantile_cont(value, 0.5)')} AS q50, {g('quantile_cont(value, 0.75)')} AS q75 FROM events GROUP BY user_id""")
def entropy_stats(spark, sf):
    return evaluation.entropy_stats(read(spark, sf, "events"), "user_id", "value").select("user_id", *(grid(F.col(c)).alias(c) for c in ("mean", "std", "range", "q25", "q50", "q75")))


@query(f"""SELECT event_id, {g('-exp(-value / (1 + event_id % 7)) * (-value / (1 + event_id % 7))')} AS entropy FROM events""")
def sequence_entropy(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", grid(evaluation.sequence_entropy(-F.col("value"), 1 + F.col("event_id") % 7)).alias("entropy"))


@query(f"""WITH s AS (SELECT l_orderkey, avg(CAST(l_returnflag = 'A' AS INT)) AS m, max(CAST(l_returnflag = 'A' AS INT)) AS b, count(*) AS n, sum(CAST(l_returnflag = 'A' AS INT)) AS t FROM lineitem GROUP BY 1)
SELECT {g('sum(t) / sum(n)')} AS pass_at_1, {g('avg(b)')} AS pass_at_n FROM s""")
def offline_eval(spark, sf):
    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_returnflag") == "A").cast("double")).alias("scores"))
    out = evaluation.offline_scores(s, "scores")
    return out.select(grid(F.col("pass_at_1")).alias("pass_at_1"), grid(F.col("pass_at_n")).alias("pass_at_n"))


@query(f"""SELECT coalesce(source, 'unknown') AS data_source, {g('avg(quality)')} AS score FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def val_score_by_source(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return d.groupBy(F.coalesce("source", F.lit("unknown")).alias("data_source")).agg(grid(F.avg("quality")).alias("score"))


@query(f"""WITH s AS (SELECT vec_id, list_sum(embedding::double[]) AS score, list_sum(embedding::double[]) - 0.5 * label AS reward, len(list_filter(embedding, lambda x: x > 0)) AS response_length FROM embeddings)
SELECT {g('avg(score)')} AS score_mean, {g('max(score)')} AS score_max, {g('min(score)')} AS score_min, {g('avg(reward)')} AS reward_mean, {g('max(reward)')} AS reward_max, {g('min(reward)')} AS reward_min, {g('avg(response_length)')} AS response_length_mean, {g('max(response_length)')} AS response_length_max, {g('min(response_length)')} AS response_length_min, {g('avg(CAST(response_length = 64 AS INT))')} AS clip_ratio FROM s""")
def batch_metrics(spark, sf):
    total = F.aggregate(vector(), F.lit(0.0), lambda a, x: a + x)
    s = read(spark, sf, "embeddings").select(total.alias("score"), (total - 0.5 * F.col("label")).alias("reward"), F.size(F.filter("embedding", lambda x: x > 0)).alias("response_length"))
    out = evaluation.batch_metrics(s, 64)
    return out.select(*(grid(F.col(c)).alias(c) for c in out.columns))


@query(f"""WITH s AS (SELECT vec_id, label, embedding::double[] AS e, list_transform(range(1, 65), lambda i: CASE WHEN i <= 64 - vec_id % 9 THEN 1 ELSE 0 END) AS m FROM embeddings),
r AS (SELECT vec_id, list_sum(e) AS score, list_sum(e) - 0.5 * label AS reward, list_sum(m) AS response_length, vec_id % 32 + 1 AS prompt_length FROM s),
t AS (SELECT vec_id, label, unnest(e) AS x, unnest(m) AS m, unnest(range(1, 65)) AS i FROM s), v AS (SELECT x * 2 AS a, x + label AS r, x * 0.5 + i * 0.01 AS v FROM t WHERE m = 1)
SELECT {', '.join(f"{g(f'{f}({c})')} AS {c}_{n}" for c in ('score', 'reward', 'response_length', 'prompt_length') for n, f in (('mean', 'avg'), ('max', 'max'), ('min', 'min')))},
{g('avg(CAST(response_length = 64 AS INT))')} AS response_length_clip_ratio, {g('avg(CAST(prompt_length = 32 AS INT))')} AS prompt_length_clip_ratio,
{', '.join(f"(SELECT {g(f'{f}({c[0]})')} FROM v) AS {c}_{n}" for c in ('advantages', 'returns', 'values') for n, f in (('mean', 'avg'), ('max', 'max'), ('min', 'min')))},
(SELECT {g('1 - var_samp(r - v) / (var_samp(r) + 1e-5::double)')} FROM v) AS vf_explained_var FROM r""")
def data_metrics(spark, sf):
    """Sequence and token metrics of one batch, in one pass."""
    e, label = vector(), F.col("label")
    spread = F.transform(e, lambda x, i: F.when(i == 0, x - 0.5 * label).otherwise(x))
    d = read(spark, sf, "embeddings").select(
        e.alias("token_level_scores"), spread.alias("token_level_rewards"), F.transform(e, lambda x: x * 2).alias("advantages"), F.transform(e, lambda x: x + label).alias("returns"), F.transform(e, lambda x, i: x * 0.5 + (i + 1) * 0.01).alias("values"),
        F.transform(e, lambda x, i: F.when(i < 64 - F.col("vec_id") % 9, 1).otherwise(0)).alias("response_mask"), (F.col("vec_id") % 32 + 1).alias("prompt_length"))
    out = evaluation.data_metrics(d, 64, 32, values="values")
    return out.select(*(grid(F.col(c)).alias(c) for c in out.columns))


@query(f"""SELECT {g('1 - var_samp(l_extendedprice - l_quantity * 1000) / (var_samp(l_extendedprice) + 1e-5::double)')} AS explained_variance FROM lineitem""")
def explained_variance(spark, sf):
    d = read(spark, sf, "lineitem").select((F.col("l_quantity") * 1000).alias("v"), F.col("l_extendedprice").alias("r"))
    return evaluation.explained_variance(d, "v", "r").select(grid(F.col("explained_variance")).alias("explained_variance"))


@query(f"""SELECT event_type AS section, {g('sum(value) * 1000 / count(*)')} AS ms_per_token FROM events GROUP BY 1""")
def timing_per_token(spark, sf):
    e = read(spark, sf, "events").withColumnRenamed("event_type", "section")
    out = evaluation.timing_per_token(e.groupBy("section").agg(F.sum("value").alias("seconds")), e.groupBy("section").agg(F.count("*").alias("tokens")))
    return out.select("section", grid(F.col("ms_per_token")).alias("ms_per_token"))


@query(f"""SELECT {g('(6.0::double * 1.5e9 * sum(n_chars::double) + 12.0::double * sum(n_chars::double * n_chars) * 28 * 12 * 128) / 1e12')} AS tera_flops FROM documents""")
def flops_estimate(spark, sf):
    return evaluation.flops(read(spark, sf, "documents"), "n_chars", 1.5e9, 28, 12, 128).select(grid(F.col("tera_flops")).alias("tera_flops"))


# --- selection and batches ---


@query("""WITH g AS (SELECT l_orderkey, min(CAST(l_returnflag = 'A' AS INT)) AS lo, max(CAST(l_returnflag = 'A' AS INT)) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, count(*) AS n FROM lineitem JOIN g USING (l_orderkey) WHERE NOT ((lo = 0 AND hi = 0) OR (lo = 1 AND hi = 1)) GROUP BY 1""")
def rejection_sample(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("reward", (F.col("l_returnflag") == "A").cast("int"))
    return evaluation.mixed_groups(d, "l_orderkey", "reward").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, min(CAST(l_returnflag = 'A' AS INT)) AS lo, max(CAST(l_returnflag = 'A' AS INT)) AS hi FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (lo = 0 AND hi = 0) AS solve_none, count(*) FILTER (lo = 1 AND hi = 1) AS solve_all, count(*) FILTER (NOT (lo = 0 AND hi = 0) AND NOT (lo = 1 AND hi = 1)) AS solve_some FROM g""")
def solve_counts(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("reward", (F.col("l_returnflag") == "A").cast("int"))
    return evaluation.solve_counts(d, "l_orderkey", "reward")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, count(*) OVER () AS n FROM orders) SELECT row_id, o_orderkey FROM r WHERE row_id < n // 7 * 7""")
def keep_multiple(spark, sf):
    return batch.keep_multiple(batch.numbered(read(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")]), 7)


@query("""SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_first_prompt(spark, sf):
    return batch.first_of(read(spark, sf, "documents").select("doc_id", "text"), "text", [F.col("doc_id")])


@query("""SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def cache_anti_join(spark, sf):
    return batch.without_done(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels"), "doc_id")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders""")
def union_conflict_join(spark, sf):
    o = read(spark, sf, "orders")
    return batch.union_columns(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_custkey", "o_orderstatus"), key="o_orderkey")


@query("""SELECT n_name, copy, CAST(n_nationkey * 3 + copy AS BIGINT) AS new_id FROM nation, (SELECT unnest([0, 1, 2]) AS copy)""")
def repeat_interleave(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), "n_name")
    return batch.repeat(n, 3).select("n_name", "copy", "new_id")


@query("""SELECT n_name, copy, CAST(copy * (SELECT count(*) FROM nation) + n_nationkey AS BIGINT) AS new_id FROM nation, (SELECT unnest([0, 1, 2]) AS copy)""")
def repeat_tile(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), "n_name")
    return batch.repeat(n, 3, interleave=False).select("n_name", "copy", "new_id")


PADDED = """WITH r AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, count(*) OVER () AS n FROM supplier), p AS (SELECT max(n) AS n, (8 - max(n) % 8) % 8 AS pad FROM r)
"""


@query(PADDED + "SELECT row_id, s_name, false AS is_pad FROM r UNION ALL SELECT r.row_id + p.n, s_name, true FROM r, p WHERE r.row_id < p.pad")
def pad_to_divisor(spark, sf):
    s = batch.numbered(read(spark, sf, "supplier").select("s_suppkey", "s_name"), [F.col("s_suppkey")]).select("row_id", "s_name")
    return batch.pad_to_divisor(s, 8)


@query(PADDED + "SELECT row_id, s_name FROM r")
def unpad(spark, sf):
    s = batch.numbered(read(spark, sf, "supplier").select("s_suppkey", "s_name"), [F.col("s_suppkey")]).select("row_id", "s_name")
    return batch.unpad(batch.pad_to_divisor(s, 8))


@query("""SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier""")
def concat_union_all(spark, sf):
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    return c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).unionByName(s.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")))


@query("""SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INT) AS rank FROM orders""")
def rank_split(spark, sf):
    o = batch.numbered(read(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    n = o.agg(F.count("*").alias("n"))
    return o.crossJoin(F.broadcast(n)).select("o_orderkey", batch.rank_of(F.col("row_id"), F.col("n"), 7).alias("rank"))


@query("""SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INT) AS chunk FROM orders""")
def chunk_assign(spark, sf):
    o = batch.numbered(read(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    n = o.agg(F.count("*").alias("n"))
    return o.crossJoin(F.broadcast(n)).select("o_orderkey", batch.chunk_of(F.col("row_id"), F.col("n"), 5).alias("chunk"))


@query("""SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS start FROM documents""")
def packed_offsets(spark, sf):
    return batch.offsets(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "start")


@query("""SELECT CAST(sum(n_chars) AS BIGINT) AS total, CAST(ceil(sum(n_chars) / 32768.0) AS INT) AS parts FROM documents""")
def micro_batch_count(spark, sf):
    return balance.micro_batch_count(read(spark, sf, "documents"), "n_chars", 32768)


@query()
def kk_balanced_partitions(spark, sf):
    d = read(spark, sf, "documents").withColumn("step", F.floor(F.col("doc_id") / 512))
    return balance.balanced_parts(d, 8, "doc_id", "n_chars", batch="step")


@query(f"""WITH p AS (SELECT doc_id // 64 AS part, sum(n_chars) AS n FROM documents GROUP BY 1) SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, CAST(max(n) - min(n) AS BIGINT) AS difference, {g('avg(n)')} AS mean FROM p""")
def balance_stats(spark, sf):
    d = read(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / 64))
    return balance.balance_stats(d, "part", "n_chars").withColumn("mean", grid(F.col("mean")))


@query("""SELECT doc_id, text FROM documents WHERE len(regexp_extract_all(text, '[^ \\n\\t\\r\\f\\v]+')) <= 100""")
def prompt_length_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text").where(F.regexp_count("text", F.lit(r"[^ \n\t\r\f\x0B]+")) <= 100)


@query("""SELECT CAST(o_orderkey % 16 AS INT) AS rank, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM orders GROUP BY 1""")
def metrics_by_shard(spark, sf):
    return exchange.metrics_by_shard(read(spark, sf, "orders"), 16, "o_totalprice", "o_orderkey").withColumn("total", F.floor(F.col("total") + 0.5).cast("double"))


# --- advantages and token arithmetic ---

REWARD = "CAST(l_returnflag = 'A' AS DOUBLE)"


@query(f"""WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, {REWARD} AS reward FROM lineitem), s AS (SELECT *, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS d, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_partkey, l_suppkey, {g('CASE WHEN n = 1 THEN reward / (1 + 1e-6::double) ELSE (reward - m) / (d + 1e-6::double) END')} AS advantage FROM s""")
def grpo_advantage(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "A").cast("double").alias("reward"))
    out = advantage.group_relative(d, "l_orderkey")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", grid(F.col("advantage")).alias("advantage"))


def vector() -> Column:
    return F.col("embedding").cast("array<double>")


@query(f"""WITH s AS (SELECT vec_id, label, embedding, list_sum(embedding::double[]) AS reward FROM embeddings), a AS (SELECT *, (reward - avg(reward) OVER (PARTITION BY label)) / (stddev_samp(reward) OVER (PARTITION BY label) + 1e-6::double) AS adv FROM s),
t AS (SELECT vec_id, adv, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM a) SELECT vec_id, pos, {g('CASE WHEN x > 0 THEN adv ELSE 0 END')} AS advantage FROM t""")
def grpo_token_tiled(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", "label", F.aggregate(vector(), F.lit(0.0), lambda a, x: a + x).alias("reward"), F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("mask"))
    tiled = advantage.tiled(advantage.group_relative(d, "label"), "advantage", "mask", "tokens")
    out = tiled.select("vec_id", F.posexplode("tokens").alias("p", "advantage"))
    return out.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), grid(F.col("advantage")).alias("advantage"))


#: The definition, place by place from the right, with values that depend on the event.
GAE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, value, (event_id % 7) * 0.5::double - 1 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
f AS (SELECT user_id, event_id, r, v, value - v AS a FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, e.v, e.value + 0.9::double * f.v - e.v + 0.9::double * 0.95::double * f.a FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT event_id, {} AS advantage, {} AS returns FROM f""".format(g("a"), g("a + v"))


@query(GAE_SQL)
def gae_advantage(spark, sf):
    item = F.struct("ts", "event_id", "value")
    s = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    s = s.select("user_id", F.transform("s", lambda x: x["event_id"]).alias("ids"), F.transform("s", lambda x: x["value"]).alias("rewards"), F.transform("s", lambda x: (x["event_id"] % 7) * 0.5 - 1).alias("values"))
    out = advantage.generalised(s, gamma=0.9, lam=0.95)
    return out.select(F.explode(F.arrays_zip("ids", "advantages", "returns")).alias("x")).select(F.col("x.ids").alias("event_id"), grid(F.col("x.advantages")).alias("advantage"), grid(F.col("x.returns")).alias("returns"))


@query(GAE_SQL)
def gae_long_sequences(spark, sf):
    """The same by chunks of seven, as for sequences that no task holds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").select("user_id", "event_id", "value", ((F.col("event_id") % 7) * 0.5 - 1).alias("v"), (F.row_number().over(w) - 1).alias("place"))
    out = advantage.generalised_long(e, "user_id", "place", "value", "v", 0.9, 0.95, chunk=7)
    return out.select("event_id", grid(F.col("advantage")).alias("advantage"), grid(F.col("returns")).alias("returns"))


@query(f"""SELECT event_id, {g('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS returns FROM events""")
def reinforce_returns(spark, sf):
    out = advantage.suffix_returns(read(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("value"))
    return out.select("event_id", grid(F.col("returns")).alias("returns"))


@query(f"""SELECT event_id, {g('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - min(value) OVER (PARTITION BY user_id)')} AS advantage FROM events""")
def remax_advantage(spark, sf):
    e = read(spark, sf, "events")
    r = advantage.suffix_returns(e, "user_id", [F.col("ts"), F.col("event_id")], F.col("value"))
    out = advantage.with_baseline(r, e.groupBy("user_id").agg(F.min("value").alias("baseline")), "user_id")
    return out.select("event_id", grid(F.col("advantage")).alias("advantage"))


TOKENS = "(SELECT vec_id, unnest(embedding)::double AS x FROM embeddings)"


@query(f"""SELECT vec_id, {g('sum(x) FILTER (x > 0)')} AS total, {g('avg(x) FILTER (x > 0)')} AS mean, {g('var_samp(x) FILTER (x > 0)')} AS var FROM {TOKENS} GROUP BY vec_id""")
def masked_moments(spark, sf):
    m = F.transform(vector(), lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    d = read(spark, sf, "embeddings").select("vec_id", vector().alias("v"), m.alias("m"))
    return d.select("vec_id", grid(token_math.masked_sum(F.col("v"), F.col("m"))).alias("total"), grid(token_math.masked_mean(F.col("v"), F.col("m"))).alias("mean"), grid(token_math.masked_var(F.col("v"), F.col("m"))).alias("var"))


@query(f"""WITH m AS (SELECT avg(x) FILTER (x > 0) AS m, var_samp(x) FILTER (x > 0) AS v FROM {TOKENS}) SELECT vec_id, {g('sum((x - m) / sqrt(v + 1e-8::double))')} AS total FROM {TOKENS}, m GROUP BY vec_id""")
def masked_whiten(spark, sf):
    t = read(spark, sf, "embeddings").select("vec_id", F.explode(vector()).alias("x")).withColumn("m", (F.col("x") > 0).cast("int"))
    return advantage.whitened(t, "x", "m").groupBy("vec_id").agg(grid(F.sum("whitened")).alias("total"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(event_type = 'purchase' AS INT) AS eos FROM events) SELECT event_id, CAST(coalesce(sum(eos) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS INT) AS mask FROM e""")
def eos_mask(spark, sf):
    item = F.struct("ts", "event_id", (F.col("event_type") == "purchase").cast("int").alias("t"))
    s = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    s = s.withColumn("mask", token_math.eos_mask(F.transform("s", lambda x: x["t"]), 1))
    return s.select(F.explode(F.arrays_zip("s", "mask")).alias("x")).select("x.s.event_id", "x.mask")


@query("""WITH t AS (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM embeddings) SELECT vec_id, CAST(pos AS INT) AS pos, CAST(greatest(sum(CAST(x > 0 AS INT)) OVER (PARTITION BY vec_id ORDER BY pos) - 1, 0) AS INT) AS position_id FROM t""")
def position_ids(spark, sf):
    m = F.transform("embedding", lambda x: (x > 0).cast("int"))
    d = read(spark, sf, "embeddings").select("vec_id", m.alias("m")).select("vec_id", F.posexplode(token_math.position_ids(F.col("m"))).alias("p", "position_id"))
    return d.select("vec_id", (F.col("p") + 1).alias("pos"), "position_id")


@query(f"""WITH t AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM embeddings), l AS (SELECT vec_id, label, coalesce(max(pos) FILTER (x > 0), 0) AS last FROM t GROUP BY 1, 2) SELECT vec_id, CAST(last AS INT) AS last_valid, label::double AS reward FROM l""")
def last_valid_and_reward(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("m"))
    at = token_math.last_valid_index(F.sequence(F.lit(0), F.size("m") - 1), F.col("m"))
    d = d.withColumn("last_valid", at)
    scattered = token_math.scatter_reward(F.col("label").cast("double"), F.col("last_valid") + 1, F.size("m"))
    return d.select("vec_id", "last_valid", F.get(scattered, F.col("last_valid")).alias("reward"))


PAIRS = """(SELECT vec_id, pos, y - x AS d, x, y FROM (SELECT a.vec_id, unnest(range(0, 64)) AS pos, unnest(a.embedding)::double AS x, unnest(b.embedding)::double AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1))"""


def pairs(spark, sf):
    """Tokens of consecutive vectors: x as new, y as old or reference log-probabilities."""
    e = read(spark, sf, "embeddings").select("vec_id", vector().alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(n, "vec_id").select("vec_id", F.explode(F.arrays_zip("a", "b")).alias("t")).select("vec_id", F.col("t.a").alias("x"), F.col("t.b").alias("y"))


@query(f"""SELECT vec_id, {g('sum(-d)')} AS kl, {g('sum(abs(d))')} AS abs_kl, {g('sum(0.5 * d * d)')} AS mse, {g('sum(greatest(least(exp(d) - d - 1, 10), -10))')} AS low_var_kl FROM {PAIRS} GROUP BY vec_id""")
def kl_estimators(spark, sf):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, sf).groupBy("vec_id").agg(*(grid(F.sum(token_math.kl(x, y, k))).alias(n) for k, n in (("kl", "kl"), ("abs", "abs_kl"), ("mse", "mse"), ("low_var_kl", "low_var_kl"))))


@query(f"""WITH t AS (SELECT vec_id, exp(x - y) AS r, y - x AS k, y AS a FROM {PAIRS}), l AS (SELECT vec_id, k, -a * r AS p, -a * greatest(least(r, 1.2::double), 0.8::double) AS c FROM t)
SELECT {g('avg(greatest(p, c))')} AS loss, {g('avg(CAST(c > p AS INT))')} AS clipped, {g('avg(k)')} AS kl FROM l""")
def ppo_policy_loss(spark, sf):
    t = token_math.policy_terms(F.col("x"), F.col("y"), F.col("y"))
    return pairs(spark, sf).agg(*(grid(F.avg(c)).alias(k) for k, c in t.items()))


@query(f"""WITH t AS (SELECT (x - 0.1::double) * (x - 0.1::double) AS p, greatest(least(x, y + 0.05::double), y - 0.05::double) AS n FROM {PAIRS}), l AS (SELECT p, (n - 0.1::double) * (n - 0.1::double) AS c FROM t) SELECT {g('avg(0.5 * greatest(p, c))')} AS loss, {g('avg(CAST(c > p AS INT))')} AS clipped FROM l""")
def value_loss(spark, sf):
    t = token_math.value_terms(F.col("x"), F.col("y"), F.lit(0.1), 0.05)
    return pairs(spark, sf).agg(*(grid(F.avg(c)).alias(k) for k, c in t.items()))


@query(f"""WITH z AS (SELECT vec_id, label, embedding::double[] AS e, ln(list_sum(list_transform(embedding::double[], lambda x: exp(x)))) AS z FROM embeddings) SELECT vec_id, {g('z - list_sum(list_transform(e, lambda x: exp(x - z) * x))')} AS entropy, {g('e[label % 64 + 1] - z')} AS logprob FROM z""")
def token_entropy_logprob(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", vector().alias("v"), (F.col("label") % 64).alias("l"))
    return d.select("vec_id", grid(token_math.token_entropy(F.col("v"))).alias("entropy"), grid(token_math.token_logprob(F.col("v"), F.col("l"))).alias("logprob"))


@query("""WITH t AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), r AS (SELECT vec_id, x, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM t) SELECT vec_id, count(*) AS kept FROM r WHERE r <= 5 GROUP BY 1""")
def top_k_logits(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", token_math.top_k_logits(vector(), 5).alias("v"))
    return d.select("vec_id", F.size(F.filter("v", lambda x: x > float("-inf"))).cast("long").alias("kept"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS token FROM embeddings""")
def argmax_token(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", token_math.argmax(F.col("embedding")).alias("token"))


@query(f"""WITH s AS (SELECT event_id AS step FROM events) SELECT step, {g('CASE WHEN step < 100 THEN step / 100.0::double ELSE greatest(0, 0.5::double * (1 + cos(3.141592653589793::double * (step - 100) / 9900.0::double)) * 0.9::double + 0.1::double) END')} AS cosine, {g('least(1, step / 100.0::double)')} AS constant FROM s""")
def learning_rates(spark, sf):
    s = read(spark, sf, "events").select(F.col("event_id").alias("step"))
    return s.select("step", grid(token_math.cosine_schedule(F.col("step"), 100, 10000, 0.1)).alias("cosine"), grid(token_math.constant_schedule(F.col("step"), 100)).alias("constant"))


@query()
def kl_controller(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 1000).alias("kl"), F.lit(1).alias("n"))
    return controllers.kl_fold(e, 0.2, 0.05, 10000.0)


# --- retrieval ---


COSINE_SQL = f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, {g('score')} AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query(COSINE_SQL)
def cosine_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    return evaluation.cosine_top_k_blocks(e, e.where("vec_id % 20 = 0"), 5).withColumn("score", grid(F.col("score"))).select("query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank"))


@query(COSINE_SQL)
def cosine_topk_blocks(spark, sf):
    """The same by its first name, which stays."""
    return cosine_topk(spark, sf)


#: One value in eight ways: bare, unreduced, calculated, under a root, with a letter that cancels out, with a root of a letter, as a decimal, with two roots.
SPELLED = ("CAST(v AS VARCHAR)", "2 * v || '/2'", "'(' || v || '*2+2)/2-1'", "'sqrt(' || v * v || ')'", "'x-x+' || v", "v || '*sqrt(x)^2/x'", "v || '.0'", "v || '*sqrt(2)*sqrt(2)/2'")


@query(f"""WITH a AS (SELECT o_custkey, o_orderkey, v, CASE o_orderkey // 4 % 8 {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(SPELLED))} END AS t FROM (SELECT *, o_orderkey % 3 AS v FROM orders)),
n AS (SELECT o_custkey, v, count(*) AS votes, min(o_orderkey) AS f, arg_min(t, o_orderkey) AS t FROM a GROUP BY ALL)
SELECT o_custkey, t AS majority, votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, f) AS r FROM n) WHERE r = 1""")
def majority_symbolic(spark, sf):
    """Three values, each spelled in eight ways; two of these have no canonical form."""
    v, n = F.col("o_orderkey") % 3, F.lit
    ways = [F.concat(v), F.concat(2 * v, n("/2")), F.concat(n("("), v, n("*2+2)/2-1")), F.concat(n("sqrt("), v * v, n(")")), F.concat(n("x-x+"), v), F.concat(v, n("*sqrt(x)^2/x")), F.concat(v, n(".0")), F.concat(v, n("*sqrt(2)*sqrt(2)/2"))]
    a = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.element_at(F.array(*ways), ((F.col("o_orderkey") / 4).cast("long") % 8 + 1).cast("int")).alias("answer"))
    return grading.majority_by_form(a, "o_custkey", "answer", "o_orderkey")


@query(f"""WITH a AS (SELECT o_custkey, o_orderkey, v, CASE o_orderkey // 4 % 8 {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(SPELLED))} END AS answer FROM (SELECT *, o_orderkey % 3 AS v FROM orders)),
c AS (SELECT o_custkey, v, min(o_orderkey) AS class_first, arg_min(answer, o_orderkey) AS class_answer FROM a GROUP BY ALL),
t AS (SELECT o_custkey, v, answer, count(*) AS votes, min(o_orderkey) AS first FROM a GROUP BY ALL)
SELECT o_custkey, answer, votes, first, class_first, class_answer FROM t JOIN c USING (o_custkey, v)""")
def answer_classes(spark, sf):
    """Which class each distinct answer of a problem is in."""
    v, n = F.col("o_orderkey") % 3, F.lit
    ways = [F.concat(v), F.concat(2 * v, n("/2")), F.concat(n("("), v, n("*2+2)/2-1")), F.concat(n("sqrt("), v * v, n(")")), F.concat(n("x-x+"), v), F.concat(v, n("*sqrt(x)^2/x")), F.concat(v, n(".0")), F.concat(v, n("*sqrt(2)*sqrt(2)/2"))]
    a = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.element_at(F.array(*ways), ((F.col("o_orderkey") / 4).cast("long") % 8 + 1).cast("int")).alias("answer"))
    return grading.classes_by_form(a, "o_custkey", "answer", "o_orderkey")


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS l, list_transform(list_reverse(embedding), lambda x: x::double) AS r, list_transform(range(len(embedding)), lambda i: CASE WHEN i % 3 = 0 THEN 0.0::double ELSE 1.0::double END) AS m FROM embeddings),
k AS (SELECT vec_id, list_transform(list_zip(l, r, m), lambda x: (x[1] - x[2]) * x[3]) AS d, l, m FROM v)
SELECT vec_id, {g('list_sum(list_transform(list_zip(l, d), lambda x: x[1] - 0.1::double * x[2]))')} AS reward, {g('list_sum(d) / list_sum(m)')} AS sequence_kl FROM k""")
def kl_penalty_rewards(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", vector().alias("l"), F.reverse(vector()).alias("r"), F.transform("embedding", lambda _, i: F.when(i % 3 == 0, 0.0).otherwise(1.0)).alias("m"))
    out = advantage.with_kl_penalty(d, "l", "l", "r", "m", 0.1)
    return out.select("vec_id", grid(token_math.masked_sum(F.col("rewards"), F.transform("m", lambda _: F.lit(1.0)))).alias("reward"), grid(F.col("sequence_kl")).alias("sequence_kl"))


@query(f"""WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), s AS (SELECT vec_id, e, list_filter(range(1, len(e)), lambda i: i % 4 <> 0) AS w FROM v)
SELECT vec_id, {g('-list_sum(list_transform(w, lambda i: e[i])) / len(w)')} AS sft_loss, {g('e[1] - 0.01::double * e[2] + 0.001::double * e[3]')} AS actor_loss FROM s""")
def training_losses(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", vector().alias("v"), F.transform("embedding", lambda _, i: F.when(i % 4 == 0, 0.0).otherwise(1.0)).alias("m"))
    return d.select("vec_id", grid(token_math.sft_loss(F.col("v"), F.col("m"))).alias("sft_loss"), grid(token_math.actor_loss(F.col("v")[0], F.col("v")[1], 0.01, F.col("v")[2], 0.001)).alias("actor_loss"))


# --- text ---

TRUTH = "format('{:t,}', o_orderkey * 37)"


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderkey * 37 AS VARCHAR) AS n, CAST(o_orderkey * 37 + 1 AS VARCHAR) AS m, o_orderkey % 4 AS shape FROM orders)
SELECT o_orderkey, CASE shape WHEN 0 THEN n WHEN 1 THEN m WHEN 3 THEN '-' || n END AS answer, CASE shape WHEN 0 THEN 1.0::double WHEN 2 THEN 0.0::double ELSE 0.1::double END AS score FROM o""")
def gsm8k_extract(spark, sf):
    """Right with commas, wrong, without the mark, negative."""
    ship_package(spark)
    n, shape = F.col("o_orderkey") * 37, F.col("o_orderkey") % 4
    text = F.when(shape == 0, F.concat(F.lit("so we get #### "), F.format_number(n, 0))).when(shape == 1, F.concat(F.lit("#### "), (n + 1).cast("string"))).when(shape == 2, F.concat(F.lit("it is "), n.cast("string"))).otherwise(F.concat(F.lit("#### -"), n.cast("string")))
    return read(spark, sf, "orders").select("o_orderkey", answers.apply(answers.last_number)(text).alias("answer"), answers.gsm8k_score(text, n.cast("string"), 0.1).alias("score"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '\\frac{' || CAST(o_custkey AS VARCHAR) || '}{2}' WHEN 1 THEN '' END AS answer FROM orders""")
def boxed_extract(spark, sf):
    """The last of two boxes, an empty one, one that no brace closes, one without braces."""
    ship_package(spark)
    n, shape = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    text = F.when(shape == 0, F.concat(F.lit("first \\boxed{0}, then \\boxed{\\frac{"), n, F.lit("}{2}}."))).when(shape == 1, "\\boxed{1} or \\boxed{}").when(shape == 2, F.concat(F.lit("\\boxed{1} and \\boxed{{"), n, F.lit("}"))).otherwise(F.concat(F.lit("\\boxed "), n))
    return read(spark, sf, "orders").select("o_orderkey", answers.apply(answers.boxed_answer)(text).alias("answer"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS shape, CAST(p_size AS VARCHAR) AS n, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT p_partkey, CASE shape WHEN 0 THEN '\\frac{' || n || '}{' || k || '}' WHEN 1 THEN '\\frac{1}{2}' WHEN 2 THEN n WHEN 3 THEN '\\sqrt{3}+' || n WHEN 4 THEN n || '\\frac' ELSE '\\frac{3}{7}' || n END AS answer, shape = 0 AS same FROM p""")
def competition_normal_form(spark, sf):
    """A slash, a half after an equals sign, a unit, a bare root, a fraction without arguments, a bare fraction."""
    ship_package(spark)
    n, k, shape = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    a = F.when(shape == 0, F.concat_ws("/", n, k)).when(shape == 1, "x = .5").when(shape == 2, F.concat(n, F.lit("\\text{ cm}"))).when(shape == 3, F.concat(F.lit("\\sqrt3 + "), n)).when(shape == 4, F.concat(n, F.lit("\\frac"))).otherwise(F.concat(F.lit("\\tfrac37"), n))
    p = read(spark, sf, "part").select("p_partkey", a.alias("a"), F.concat(F.lit("\\dfrac{"), n, F.lit("}{"), k, F.lit("}")).alias("b"))
    return p.select("p_partkey", answers.apply(answers.competition_answer)("a").alias("answer"), answers.apply(answers.same_competition_answer, "boolean")("a", "b").alias("same"))


def shaped(key: str, *texts: Column) -> Column:
    """The text whose turn it is by a key."""
    return F.element_at(F.array(*texts), (F.col(key) % len(texts) + 1).cast("int"))


@query("""SELECT p_partkey, CASE p_partkey % 12 WHEN 2 THEN false WHEN 3 THEN p_size = 7 WHEN 5 THEN false WHEN 9 THEN false ELSE true END AS same FROM part""")
def symbolic_grade(spark, sf):
    """A square written out, a root with nested braces, an unreduced fraction, a decimal, two roots, brackets of two kinds, a pair, a mixed number, a unit, two letters, a root below, a percentage."""
    n, t = F.col("p_size"), F.lit
    given = shaped("p_partkey", F.concat(t("(x+"), n, t(")^2")), F.concat(t("\\sqrt{x^{2}+"), n, t("}")), F.concat(2 * n, t("/4")), F.concat(n), F.concat(t("sqrt(8)*"), n), F.concat(t("("), n, t(", "), n + 1, t(")")),
                   F.concat(t("("), n, t(", 2*"), n, t(")")), F.concat(n, t("\\frac{1}{2}")), F.concat(n, t(" cm")), F.concat(t("x+"), n), F.concat(n, t("/(1+sqrt(2))")), F.concat(n, t("\\%")))
    truth = shaped("p_partkey", F.concat(t("x^2+2*"), n, t("*x+"), n * n), F.concat(t("sqrt(x^2+"), n, t(")")), F.concat(n, t("/2")), t("7.0"), F.concat(t("2*"), n, t("*\\sqrt{2}")), F.concat(t("["), n, t(", "), n + 1, t("]")),
                   F.concat(t("("), n, t(", "), n, t("+"), n, t(")")), F.concat(t("("), 2 * n, t("+1)/2")), F.concat(n), F.concat(t("y+"), n), F.concat(n, t("*\\sqrt2-"), n), F.concat(n))
    return grading.graded(read(spark, sf, "part").select("p_partkey", given.alias("given"), truth.alias("truth")), "given", "truth").select("p_partkey", "same")


@query("""SELECT o_orderkey, o_orderkey % 9 IN (0, 2, 5, 6, 7) AS correct FROM orders""")
def graded_solutions(spark, sf):
    """Right; wrong; the last of two boxes; unreduced; no box; a boxed truth; a half; terms exchanged under braces; an empty truth."""
    k, t = F.col("o_custkey"), F.lit
    box = lambda *x: F.concat(t("so \\boxed{"), *x, t("}."))
    given = shaped("o_orderkey", box(k), box(k + 1), F.concat(box(t("0")), box(k)), box(t("\\frac{2}{4}")), F.concat(t("it is "), k), box(k), box(t("0.5")), box(t("x^{2}+"), k), box(k))
    truth = shaped("o_orderkey", F.concat(k), F.concat(k), F.concat(k), t("1/2"), F.concat(k), box(k), t("\\frac12"), F.concat(k, t("+x^2")), t(""))
    o = read(spark, sf, "orders").select("o_orderkey", given.alias("given"), truth.alias("truth"))
    return grading.graded(o, "given", "truth", "correct", answers.grade_solution).select("o_orderkey", "correct")


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 1.0::double WHEN 1 THEN 1.0::double - 0.1::double WHEN 2 THEN 0.0::double WHEN 3 THEN 1.0::double - 0.1::double WHEN 4 THEN 0.0::double - 0.1::double WHEN 5 THEN 1.0::double WHEN 6 THEN 1.0::double ELSE 0.0::double END AS reward FROM orders""")
def tool_rewards(spark, sf):
    """Right; right after an error; thoughts never closed; right without a program; wrong without one; the second of two truths; an error mended; the box within the thoughts."""
    ship_package(spark)
    k, t = F.col("o_custkey"), F.lit
    ran, failed = t("```python\nprint(x)\n```\n```output\n7\n```\n"), t("```python\nprint(x)\n```\n```output\nNameError: x\n```\n")
    box = F.concat(t(" \\boxed{"), k, t("}"))
    open_, close = t("<think>\n"), t("</think>")
    text = shaped("o_orderkey", F.concat(open_, ran, close, box), F.concat(open_, failed, close, box), F.concat(open_, ran, box), F.concat(open_, close, box), F.concat(open_, close, t(" \\boxed{no}")), F.concat(open_, ran, close, box), F.concat(open_, failed, ran, close, box), F.concat(open_, ran, box, close))
    truths = F.when(F.col("o_orderkey") % 8 == 5, F.concat(t("none|"), k)).otherwise(F.concat(k))
    reward = answers.apply(lambda s, t: rewards.tool_reward(s, t.split("|")), "double")
    return read(spark, sf, "orders").select("o_orderkey", reward(text, truths).alias("reward"))


@query("""SELECT doc_id, CASE WHEN source LIKE 'src1%' AND doc_id % 6 IN (0, 1, 3, 5) THEN 1.0::double ELSE 0.0::double END AS score FROM documents""")
def scored_by_source(spark, sf):
    """A slash; a box without braces; no box; no numbers; unreduced; a leading dot; sources with another reward give 0."""
    t = F.lit
    given = shaped("doc_id", t("so \\boxed{1/2}"), t("$\\boxed 5$"), t("5"), t("\\boxed{a/b}"), t("\\boxed{2/4}"), t("\\boxed{.5}"))
    truth = shaped("doc_id", t("\\frac{1}{2}"), t("5"), t("5"), t("a/b"), t("1/2"), t("\\frac12"))
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("data_source"), given.alias("solution"), truth.alias("ground_truth"))
    return rewards.scored(d, {"src1": rewards.competition_score, "src": lambda s, t: 0.0}).select("doc_id", "score")


@query("""SELECT conv_id, turn, split_part('<think>plan</think>' || text || '</think>rest', '</think>', 2) AS shown FROM conversations""")
def think_split(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", answers.after_thoughts(F.concat(F.lit("<think>plan</think>"), "text", F.lit("</think>rest"))).alias("shown"))


@query("""WITH c AS (SELECT conv_id, turn, turn % 5 AS shape, CAST(turn AS VARCHAR) AS t FROM conversations)
SELECT conv_id, turn, 'x = ' || t || chr(10) || 'print(x)' AS program, t || chr(10) AS output FROM c WHERE shape IN (0, 2) UNION ALL SELECT conv_id, turn, 'y', 'b' || chr(10) FROM c WHERE shape = 2 UNION ALL SELECT conv_id, turn, 'x', '' FROM c WHERE shape = 4""")
def fenced_blocks(spark, sf):
    """An indented program with its output and one never closed; no fence; two pairs; a program without output; an output never closed."""
    ship_package(spark)
    c, v = read(spark, sf, "conversations"), F.lit
    t = F.col("turn").cast("string")
    first = F.concat(v("talk\n```python\n  x = "), t, v("\n  print(x)\n```\nthen\n```output\n"), t, v("\n```\n"))
    text = shaped("turn", F.concat(first, v("```python\nnever closed")), v("talk only"), F.concat(first, v("so\n```python\ny\n```\n```output\nb\n```\n")), v("```python\n\n```\nalone"), v("```python\nx\n```\n```output\nopen"))
    pair = answers.apply(lambda x: [{"program": p, "output": o} for p, o in blocks.programs_and_outputs(x)], "array<struct<program:string,output:string>>")
    return c.select("conv_id", "turn", F.inline(pair(text)))


@query("""SELECT doc_id, CASE WHEN length(text) > 800 THEN substr(text, 1, 400) || '...' || substr(text, length(text) - 399) ELSE text END AS cut FROM documents""")
def truncate_middle(spark, sf):
    return read(spark, sf, "documents").select("doc_id", answers.middle_cut_column(F.col("text")).alias("cut"))


@query("""SELECT page_id, replace(regexp_replace(replace(trim(url || ' [title] x [note]'), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS text FROM pages""")
def tidy_titles(spark, sf):
    return read(spark, sf, "pages").select("page_id", answers.tidy_title(F.concat("url", F.lit(" [title] x [note]"))).alias("text"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf):
    return tables.event_props(read(spark, sf, "events")).select("event_id", "k")


@query("""SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'math' WHEN source LIKE 'src2%' THEN 'code' ELSE 'default' END AS reward FROM documents""")
def route_by_source(spark, sf):
    return read(spark, sf, "documents").select("doc_id", prep.routed(F.col("source"), {"src1": "math", "src2": "code"}, "default").alias("reward"))


# --- preparation ---


@query("""SELECT item_id AS index, 'bench' AS data_source, 'user' AS role, text || ' Think step by step.' AS content, CAST(item_id AS VARCHAR) AS ground_truth, 'rule' AS style, 'test' AS split FROM benchmark""")
def prep_rl_schema(spark, sf):
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.concat(F.lit("... #### "), F.col("item_id").cast("string")).alias("answer"))
    rows = prep.arithmetic_rows(b, "test", "Think step by step.", key="item_id", source="bench")
    return rows.select("extra_info.index", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "reward_model.style", "extra_info.split")


@query("""SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY 1""")
def chat_prompt_build(spark, sf):
    c = prep.chats(read(spark, sf, "conversations"))
    return c.select("conv_id", F.array_join(F.transform("prompt", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("chat"))


@query("""SELECT doc_id, CAST(0 AS INT) AS place, source AS prompt, lang AS response FROM documents UNION ALL SELECT doc_id, 1, source, text FROM documents""")
def sft_unpivot(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("prompt"), F.col("lang").alias("chosen"), F.col("text").alias("rejected"))
    return prep.preference_sft(d).withColumnRenamed("row_id", "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id < floor((SELECT count(*) FROM documents) * 0.75) THEN 'train' ELSE 'test' END AS split FROM documents""")
def positional_split(spark, sf):
    d = batch.numbered(read(spark, sf, "documents").select("doc_id"), [F.col("doc_id")])
    return prep.preference_split(d).select("doc_id", "split")


# --- the bounded loop ---


def scripted(queries_: list[str]) -> list[tuple[str, float, int]]:
    """A stand-in generator: asks for one program, then answers."""
    out = []
    for q in queries_:
        if "```output" in q:
            out.append((f"The answer is \\boxed{{{blocks.program_output(q)}}}", -1.0, 6))
        else:
            out.append((f"\n```python\nx = {len(q)}\nprint(x * 2)\n```\n", -2.0, 12))
    return out


@query("""SELECT conv_id AS idx, CAST(2 AS INT) AS rounds, CAST(length('q' || CAST(conv_id AS VARCHAR)) * 2 AS VARCHAR) AS answer, -3.0::double AS logprob, 18::BIGINT AS length FROM (SELECT DISTINCT conv_id FROM conversations)""")
def tool_loop(spark, sf):
    ship_package(spark)
    p = read(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("idx"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("query"))
    out = loop.generate_with_tools(p, scripted)
    return out.select("idx", "rounds", answers.apply(answers.boxed_answer)("query").alias("answer"), "logprob", "length")


def scripted_ids(asked: list[list[int]], budgets: list[int]) -> list[loop.Reply]:
    """A stand-in generator of code points: asks for a program once or twice, then answers, or talks on beyond any budget."""
    out = []
    for ids in asked:
        text = TOKENIZER.decode(ids)
        n, calls = int(text[1 : text.index(":")]), text.count("```output")
        if n % 4 == 3:
            say = "talk " * 40
        elif calls <= n % 4:
            say = f"\n```python\nprint({n} * 2)\n```\n"
        else:
            say = f"\\boxed{{{blocks.program_output(text)}}}"
        out.append(loop.Reply(TOKENIZER.encode(say)))
    return out


TOKENIZER = tokens.CodePoints()


@query("""WITH c AS (SELECT DISTINCT conv_id AS idx FROM conversations), p AS (SELECT idx, idx % 4 AS k, chr(10) || '```python' || chr(10) || 'print(' || idx || ' * 2)' || chr(10) || '```' || chr(10) AS call, '```output' || chr(10) || (idx * 2) || chr(10) || '```' || chr(10) AS result, '\\boxed{' || (idx * 2) || '}' AS said FROM c),
t AS (SELECT *, CASE k WHEN 3 THEN repeat('talk ', 40) WHEN 0 THEN call || result || said WHEN 1 THEN call || result || call || result || said ELSE call || result || call || result || call || result || said END AS whole,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS calls, length(call) AS n, length(result) AS m, length(said) AS s FROM p),
-- the calls whose output has room, and whether the next reply fits
f AS (SELECT *, CASE WHEN k = 3 THEN 0 ELSE least(calls, 99 // (n + m)) END AS done FROM t)
SELECT idx, CASE WHEN k = 3 THEN left(whole, 100) WHEN done < calls THEN left(left(whole, (done * (n + m) + n)::BIGINT), 100) ELSE left(whole, 100) END AS response,
  CAST(CASE WHEN k = 3 THEN 1 ELSE done + 1 END AS INT) AS rounds,
  CASE WHEN k = 3 THEN 'budget' WHEN done < calls AND done * (n + m) + n >= 100 THEN 'budget' WHEN done < calls THEN 'output' WHEN done * (n + m) + s >= 100 THEN 'budget' ELSE 'stop' END AS ended FROM f""")
def budget_loop(spark, sf):
    """Answers, dropped outputs and cut replies under a budget of 100 tokens."""
    p = read(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("idx"), F.concat(F.lit("q"), "conv_id", F.lit(":")).alias("query"))
    return loop.rollout(p, scripted_ids, TOKENIZER, 100).select("idx", "response", "rounds", "ended")


PIECE = r"\s*(?:[A-Za-z]+|\d|[^\sA-Za-z\d])|\s+"


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END AS head, '```output' || chr(10) || turn || ' steps' || chr(10) || '```' || chr(10) AS block, CASE WHEN turn % 3 = 0 THEN 'then ' ELSE chr(10) || ' so ' END AS mid FROM conversations),
n AS (SELECT *, len(regexp_extract_all(head || block || mid || block || 'end', '{PIECE}')) AS size, len(regexp_extract_all(head, '{PIECE}')) AS a, len(regexp_extract_all(block, '{PIECE}')) AS b, len(regexp_extract_all(head || block || mid, '{PIECE}')) AS c FROM c)
SELECT conv_id, turn, CAST(size AS INT) AS n_tokens, CAST(len(list_filter(range(size), lambda i: i >= a AND i < a + b OR i >= c AND i < c + b)) AS INT) AS n_masked, CAST(list_sum(list_filter(range(size), lambda i: i >= a AND i < a + b OR i >= c AND i < c + b)) AS BIGINT) AS places FROM n""")
def output_token_mask(spark, sf):
    """Two tool outputs in a text: how many tokens are masked, and the sum of their places."""
    t = F.col("turn")
    block = F.concat(F.lit("```output\n"), t, F.lit(" steps\n```\n"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(t % 2 == 0, "\n").otherwise(""), block, F.when(t % 3 == 0, "then ").otherwise("\n so "), block, F.lit("end"))
    d = tokens.with_output_mask(read(spark, sf, "conversations").select("conv_id", "turn", text.alias("whole")), "whole", tokens.Pieces())
    gone = F.filter(F.transform("response_mask", lambda m, i: F.when(m == 0, i)), lambda i: i.isNotNull())
    return d.select("conv_id", "turn", F.size("response_mask").alias("n_tokens"), F.size(gone).alias("n_masked"), F.aggregate(gone, F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


@query(f"""SELECT event_id, {g('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS value_so_far FROM events""")
def running_totals(spark, sf):
    e = evaluation.running_totals(read(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], ["value"])
    return e.select("event_id", grid(F.col("value_so_far")).alias("value_so_far"))


@query(f"""WITH z AS (SELECT vec_id, embedding::double[] AS e, ln(list_sum(list_transform(embedding::double[], lambda x: exp(x)))) AS z FROM embeddings) SELECT vec_id, {g('z - list_sum(list_transform(e, lambda x: exp(x - z) * x))')} AS entropy FROM z""")
def sharded_entropy(spark, sf):
    t = read(spark, sf, "embeddings").select("vec_id", F.explode(vector()).alias("logit"))
    return evaluation.sharded_entropy(t, "vec_id", "logit").select("vec_id", grid(F.col("entropy")).alias("entropy"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_custkey % 5 + 1 AS INT) AS p, CAST(o_orderkey % 7 + 1 AS INT) AS r FROM orders) SELECT o_orderkey, least(p + r, 10) AS tokens, CASE WHEN p + r <= 10 THEN r ELSE 10 - (p - 1) END - CASE WHEN p + r <= 10 THEN 0 ELSE 0 END AS trained FROM s""")
def sft_samples(spark, sf):
    p, r = (F.col("o_custkey") % 5 + 1).cast("int"), (F.col("o_orderkey") % 7 + 1).cast("int")
    s = token_math.sft_sample(F.array_repeat(F.lit(5), p), F.array_repeat(F.lit(6), r), 10, 0, "right")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    return read(spark, sf, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", total(F.col("s.attention_mask")).alias("tokens"), total(F.col("s.loss_mask")).alias("trained"))


@query("""SELECT o_orderkey, CAST(least(o_custkey % 5 + 1, 4) AS INT) AS chosen, CAST(least(o_orderkey % 7 + 1, 4) AS INT) AS rejected FROM orders""")
def preference_pairs(spark, sf):
    p, r = (F.col("o_custkey") % 5 + 1).cast("int"), (F.col("o_orderkey") % 7 + 1).cast("int")
    s = token_math.stacked_pair(F.array_repeat(F.lit(5), p), F.array_repeat(F.lit(6), r), 4, 0)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    return read(spark, sf, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", total(F.col("s.attention_mask")[0]).alias("chosen"), total(F.col("s.attention_mask")[1]).alias("rejected"))


@query("""WITH t AS (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM embeddings) SELECT vec_id, CAST(sum((65 - pos) * CAST(x > 0 AS INT)) AS INT) AS seen FROM t GROUP BY 1""")
def causal_attention(spark, sf):
    m = token_math.causal_mask(F.transform("embedding", lambda x: (x > 0).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    return read(spark, sf, "embeddings").select("vec_id", total(F.transform(m, total)).alias("seen"))


# --- programs, verdicts and loaders ---


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '' ELSE CAST(4 * o_custkey AS VARCHAR) END AS printed,
CASE WHEN o_orderkey % 5 = 0 THEN 'Error: ValueError' WHEN o_orderkey % 7 = 0 THEN 'Timeout Error' ELSE 'Done' END AS report,
CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '' ELSE CAST(3 * o_custkey AS VARCHAR) END AS symbol,
CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '' ELSE CAST(3 * o_custkey - 1 AS VARCHAR) END AS expression FROM orders""")
def executed_programs(spark, sf):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    code = F.when(k % 5 == 0, "import os").when(k % 7 == 0, "a = 9 ** 99999").otherwise(F.concat(F.lit("a = "), n, F.lit("\nb = a * 3\nprint(a + b)")))
    o = read(spark, sf, "orders").select("o_orderkey", code.alias("code"))
    o = execute.executed(o, answer="printed", out="p")
    o = execute.executed(o, answer="symbol", of="b", out="s")
    o = execute.executed(o, answer="expression", of="b - 1", out="e")
    return o.select("o_orderkey", F.col("p.result").alias("printed"), F.col("p.report").alias("report"), F.col("s.result").alias("symbol"), F.col("e.result").alias("expression"))


def _strict_grade(given: str | None, wanted: str | None) -> bool:
    """A stand-in grader that can't read every truth."""
    if wanted == "0":
        raise ValueError(wanted)
    return answers.same_expression(given, wanted)


@query(f"""WITH v AS (SELECT o_orderpriority AS source, o_orderkey % 6 AS w, (o_orderkey % 6) + (o_custkey % 2) AS h FROM orders)
SELECT source, count(*) FILTER (w <> 0) AS sample_size, {g("avg(CASE WHEN w = 0 THEN NULL WHEN w = h THEN 1.0::double ELSE 0.0::double END)")} AS accuracy, (SELECT count(*) FROM v WHERE w = 0) AS num_verify_error FROM v GROUP BY source""")
def verified_accuracy(spark, sf):
    w = F.col("o_orderkey") % 6
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), (w + F.col("o_custkey") % 2).cast("string").alias("solution"), w.cast("string").alias("truth"))
    return execute.verified_report(execute.verified(o, _strict_grade)).withColumn("accuracy", grid(F.col("accuracy")))


@query("""SELECT doc_id // 512 AS step, CAST(ceil(sum(n_chars) / 32768.0) AS INT) AS parts, CAST(ceil(sum(n_chars) / 32768.0) AS BIGINT) AS used, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(count(*) - 1 AS INT) AS last_place FROM documents GROUP BY 1""")
def micro_batches(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.floor(F.col("doc_id") / 512).alias("step"))
    parts = balance.part_order(balance.micro_batches(d, "doc_id", "n_chars", 32768, "step"))
    one = parts.join(d.select(F.col("doc_id").alias("key"), "n_chars"), "key").groupBy(F.col("batch").alias("step"))
    return one.agg(F.max("parts").alias("parts"), F.countDistinct("part_id").alias("used"), F.count("*").alias("n"), F.sum("n_chars").alias("tokens"), F.max("place").alias("last_place"))


@query(f"""WITH v AS (SELECT vec_id, embedding::double[] AS e, vec_id % 3 AS k FROM embeddings)
SELECT vec_id, len(list_filter(range(len(e)), lambda i: i % 3 <> k)) AS kept, {g('list_sum(list_transform(list_filter(range(len(e)), lambda i: i % 3 <> k), lambda i: e[i + 1] * (i + 1)))')} AS weighted, len(e) AS width FROM v""")
def unpad_repad(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", vector().alias("v"), F.transform("embedding", lambda _, i: F.when(i % 3 == F.col("vec_id") % 3, 0).otherwise(1)).alias("m"))
    d = d.withColumn("u", token_math.unpadded(F.col("v"), F.col("m")))
    d = d.withColumn("r", token_math.repadded(F.col("u.values"), F.col("u.places"), F.size("m"), 0.0))
    weighted = token_math.masked_sum(F.col("r"), F.transform("r", lambda _, i: (i + 1).cast("double")))
    return d.select("vec_id", F.size("u.values").cast("long").alias("kept"), grid(weighted).alias("weighted"), F.size("r").cast("long").alias("width"))


@query(f"""SELECT vec_id, {g('embedding[64 - vec_id % 5]::double')} AS score, CAST(63 - vec_id % 5 AS INT) AS place FROM embeddings""")
def last_token_score(spark, sf):
    m = F.transform("embedding", lambda _, i: F.when(i < 64 - F.col("vec_id") % 5, 1).otherwise(0))
    d = read(spark, sf, "embeddings").select("vec_id", vector().alias("v"), m.alias("m"), F.transform("embedding", lambda _, i: i).alias("p"))
    moved = token_math.last_token_moved(F.col("v"), F.col("p"), F.col("m"))
    d = d.select("vec_id", moved.alias("x"), token_math.last_valid_index(F.col("p"), F.col("m")).alias("place"))
    return d.select("vec_id", grid(F.col("x")[F.col("place")]).alias("score"), "place")


@query("""WITH o AS (SELECT c_custkey AS row_id, row_number() OVER (ORDER BY md5('11/2/' || c_custkey), c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
SELECT row_id, place, CAST(place % 7 AS INT) AS rank, true AS dropped FROM o WHERE place < n - n % 7 UNION ALL SELECT row_id, place, CAST(place % 7 AS INT), false FROM o
UNION ALL SELECT row_id, place + n, CAST((place + n) % 7 AS INT), false FROM o WHERE place < (7 - n % 7) % 7""")
def rank_batches(spark, sf):
    """Which row goes to which rank, without the rest and with leading rows coming again."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    of = lambda drop: batch.rank_batches(c, 7, 11, epoch=2, drop_last=drop).select("row_id", F.col("at").alias("place"), "rank", F.lit(drop).alias("dropped"))
    return of(True).union(of(False))


@query("""WITH o AS (SELECT c_custkey AS row_id, row_number() OVER (ORDER BY md5('11/0/' || c_custkey), c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer)
SELECT row_id, place, place // 20 AS batch FROM o WHERE place < n - n % 20""")
def training_batches(spark, sf):
    """Which row goes to which batch."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
    return batch.training_batches(c, 16, 11, multiplier=1.25).select("row_id", F.col("at").alias("place"), "batch")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
SELECT p_partkey, 'train' AS split FROM r WHERE i < round_even(n * 0.7, 0) UNION ALL SELECT p_partkey, 'test' FROM r WHERE i >= n - round_even(n * 0.3, 0)""")
def reward_split(spark, sf):
    p = batch.numbered(read(spark, sf, "part").select("p_partkey"), [F.col("p_partkey")])
    return prep.reward_split(p, 0.7).select("p_partkey", "split")


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Q: ' || text || ' A:' ELSE text || ' Answer with a program.' END AS prompt FROM benchmark""")
def typed_prompts(spark, sf):
    b = read(spark, sf, "benchmark")
    kind = F.when(F.col("item_id") % 2 == 0, "direct").otherwise("tool")
    return b.select("item_id", prep.prompts(F.col("text"), kind, {"direct": "Q: {question} A:", "tool": "{question} Answer with a program."}).alias("prompt"))


@query(f"""SELECT label, {g('sqrt(sum(list_dot_product(embedding::double[], embedding::double[])))')} AS norm FROM embeddings GROUP BY label""")
def parameter_norms(spark, sf):
    return evaluation.norms(read(spark, sf, "embeddings"), "label", "embedding").withColumn("norm", grid(F.col("norm")))


@query(f"""SELECT event_type, {g('avg(value)')} AS mean, {g('stddev_pop(value)')} AS deviation, {g('sum(value) / 1e6::double')} AS total FROM events GROUP BY 1""")
def time_use(spark, sf):
    t = evaluation.time_use(read(spark, sf, "events"), "value", ["event_type"])
    return t.select("event_type", grid(F.col("mean")).alias("mean"), grid(F.col("deviation")).alias("deviation"), grid(F.col("total") / 1e6).alias("total"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY 1""")
def chat_lists(spark, sf):
    c = batch.lists(read(spark, sf, "conversations"), ["turn", "role"], [F.col("turn")], ["conv_id"])
    return c.select("conv_id", F.concat_ws(",", "role").alias("roles"), F.size("turn").cast("long").alias("turns"))
