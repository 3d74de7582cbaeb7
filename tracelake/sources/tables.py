"""Schemas, readers and writers of trace tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


MESSAGE = _struct(role=StringType(), content=StringType())
PROBLEMS = _struct(problem=StringType(), gt_answer=StringType(), prompt=StringType(), source=StringType())
GENERATIONS = _struct(problem=StringType(), gt_answer=StringType(), source=StringType(), prompt=StringType(), gen=ArrayType(StringType()), gen_cumulative_logprob=ArrayType(DoubleType()), gen_cumulative_seq_len=ArrayType(LongType()), majority_answer=StringType(), time_use=DoubleType())
TRAINING_ROWS = _struct(
    data_source=StringType(), prompt=ArrayType(MESSAGE), ability=StringType(),
    reward_model=_struct(style=StringType(), ground_truth=StringType(), eval=StringType(), choices=ArrayType(StringType())),
    extra_info=_struct(split=StringType(), index=LongType(), answer=StringType(), question=StringType()),
)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet files as one table by column name; absent columns are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType = PROBLEMS, strict: bool = True) -> DataFrame:
    """JSON lines under a declared schema; a bad line fails the query when strict, else its row is null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def sharded_json_lines(spark: SparkSession, folder: str, prefix: str = "dp_rank", schema: StructType = GENERATIONS) -> DataFrame:
    """All files of a folder with a name prefix, with each row's ``file``."""
    return spark.read.schema(schema).json(f"{folder}/{prefix}*").select("*", F.col("_metadata.file_name").alias("file"))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    """``df``, or an error if it has no row or lacks the column."""
    if column not in df.columns:
        raise KeyError(column)
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def write_parquet(df: DataFrame, path: str, resume: bool = False) -> None:
    """Write once; with ``resume`` an existing output is left as it is."""
    df.write.mode("ignore" if resume else "errorifexists").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Add files to a folder; what is there is never overwritten."""
    df.write.mode("append").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Long-form metrics as CSV files, so runs with other metrics don't misalign."""
    df.write.mode("append").option("header", True).csv(path)


def metrics_document(report: DataFrame) -> str:
    """A long-form report, a row a source and metric, as nested JSON."""
    out: dict[str, dict[str, float]] = {}
    for r in report.orderBy("source", "metric").toLocalIterator():
        out.setdefault(r["source"], {})[r["metric"]] = r["value"]
    return json.dumps(out, indent=4)


def console_line(step: int, metrics: dict) -> str:
    """``step:N - name:0.123``: numbers only, three decimals."""
    return " - ".join([f"step:{step}", *(f"{k}:{v:.3f}" for k, v in metrics.items() if isinstance(v, int | float))])


def table_bytes(df: DataFrame) -> DataFrame:
    """Bytes of each text or binary column."""
    cols = [c for c, t in df.dtypes if t in ("string", "binary")]
    return df.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in cols))


def event_props(df: DataFrame, column: str = "props") -> DataFrame:
    """The integer ``k`` of JSON properties; null where absent or unreadable."""
    return df.withColumn("k", F.get_json_object(column, "$.k").cast("long"))
