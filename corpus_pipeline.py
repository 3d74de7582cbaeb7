"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.bpe import bpe_round_trip
from tracelake.llm.mixing import mixed_documents
from tracelake.llm.ngram_join import ngram_jaccard_components
from tracelake.llm.pii import redact_documents
from tracelake.llm.quality import quality_rules, without_lines
from tracelake.llm.storage import discard, keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines; ``n_chars`` follows.

    The next stage removes copies, so here equal texts count once and the first document
    with a line keeps it: of a group of copies at least one stays whole.  Rows are told apart
    by id, text and source; equal rows share their fate.  A null or empty text fails.  An
    empty table gives none; extra columns are carried along, whatever their names.
    """
    return _with_length(without_lines(docs, quality_rules(docs, copies_once=True, first_keeps=True)), docs)


def _with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``n_chars`` of a changed text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select([F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of smallest id, null ids last; of equal rows one.

    Rows are told apart by id and text, as rows that share an id are separate documents.
    Null and empty texts are alone, one for each id.  An empty table gives none; extra
    columns are carried along, whatever their names.
    """
    text = F.col("text").cast("string")
    # two hashes: rows that differ and share the first one are both kept
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("_key"), F.xxhash64(F.lit("row"), text, F.col("doc_id").cast("long")).alias("_more"))
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("_key"), text.alias("text"), F.col("doc_id").cast("long").alias("id"))
    classes = keep(ngram_jaccard_components(keyed, "_key").select(F.col("doc_id").alias("_key"), "component_id").distinct(), "classes")
    ids = keyed.select("_key", "id").distinct()
    first = classes.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_key"))["_key"].alias("_key"))
    first = keep(first.select("_key"), "first-of-class")
    repeated = keep(row.groupBy("_key", "_more").count().where("count > 1").select("_key", "_more"), "repeated")
    kept = row.join(first, "_key", "left_semi")
    if repeated.isEmpty():
        return kept.select("_row.*")
    once = kept.join(repeated, ["_key", "_more"], "left_semi").groupBy("_key", "_more").agg(F.first("_row").alias("_row"))
    return kept.join(repeated, ["_key", "_more"], "left_anti").select("_row.*").union(once.select("_row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows.

    A row for each row of ``docs``, repeated ones included; a null text stays null, an
    empty one empty.  Extra columns are carried along, whatever their names.
    """
    return _with_length(redact_documents(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Equal rows are taken alike; null and empty texts weigh nothing.  An empty table gives
    none; extra columns are carried along, whatever their names.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of what they decode to.

    A row for each row of ``docs``; a null text is an empty one; other columns are ignored.
    """
    return bpe_round_trip(docs, with_text=False)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("mix_to_weights", mix), ("bpe_encode_decode", tokens)]

#: The tokenizer's merges can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if n:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
