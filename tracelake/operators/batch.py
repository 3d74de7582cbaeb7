"""Algebra on ordered batches: every batch has an explicit row order column, ``row_id`` by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep


def select(df: DataFrame, required: list[str] | None = None, optional: list[str] | None = None) -> DataFrame:
    """Columns by name: required ones must exist, optional ones are left out where absent; None keeps all."""
    if required is None and optional is None:
        return df
    names = [*(required or []), *(c for c in optional or [] if c in df.columns)]
    return df.select(*dict.fromkeys(names))


def pop(df: DataFrame, columns: list[str], key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The batch without ``columns``, and those with the key."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.drop(*columns), df.select(key, *columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones")
    return df.withColumnsRenamed(dict(zip(old, new)))


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case names; of columns that then clash the last stays."""
    last = {c.lower(): i for i, c in enumerate(df.columns)}
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.select(*(F.col(f"c{i}").alias(n) for n, i in last.items()))


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """Struct fields as top-level columns named by their path."""

    def leaves(schema, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            inner = getattr(f.dataType, "fields", None)
            out += leaves(f.dataType, (*path, f.name)) if inner else [(*path, f.name)]
        return out

    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p)) for p in leaves(df.schema)))


def nested(column: str, path: list[str]) -> Column:
    """A field by key path; arrays of one element are unwrapped first."""
    c = F.col(column)
    for key in path:
        c = c[key]
    return c


def union_columns(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns of both batches by row; a column that both have must agree, else the query fails."""
    common = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(key, *(F.col(c).alias(f"_b_{c}") if c in common else F.col(c) for c in b.columns if c != key))
    out = a.join(other, key)
    for c in common:
        same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType)))
    return out.drop(*(f"_b_{c}" for c in common))


def repeat(df: DataFrame, n: int, interleave: bool = True, key: str = "row_id", out: str = "new_id") -> DataFrame:
    """Each row ``n`` times with its copy number and new order: 1,1,2,2 interleaved, else 1,2,1,2.

    ``key`` counts rows from 0; the tiled order needs their number, one aggregate.
    """
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn(out, F.col(key) * n + F.col("copy"))
    total = df.agg(F.count("*").alias("_n"))
    return copies.crossJoin(F.broadcast(total)).withColumn(out, F.col("copy") * F.col("_n") + F.col(key)).drop("_n")


def pad_to_divisor(df: DataFrame, k: int, key: str = "row_id") -> DataFrame:
    """Recycle leading rows until the count divides by ``k``; added rows have ``is_pad``."""
    total = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    more = df.crossJoin(total).withColumn("_pad", F.pmod(-F.col("_n"), F.lit(k)))
    times = F.when(F.col("_pad") > F.col(key), F.floor((F.col("_pad") - F.col(key) - 1) / F.col("_n")))  # beyond the first
    more = more.where("_pad > 0").withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), times)))
    more = more.withColumn(key, F.col("_r") * F.col("_n") + F.col(key) + F.col("_n")).drop("_r", "_n", "_pad")
    return df.withColumn("is_pad", F.lit(False)).unionByName(more.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def _in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions, sorted, with partition ``_p`` and place ``_i``; written, so both stay as they are."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(placed.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "in-order")


def _before(sums: DataFrame) -> DataFrame:
    """Sums of the partitions before each; a row a partition."""
    return sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))


def numbered(df: DataFrame, order: list[Column], out: str = "row_id") -> DataFrame:
    """Row numbers from 0 in ``order``, without one task for all rows.

    A row's number is the rows of earlier range partitions plus its place in its own.  Ties
    must be excluded by ``order``.
    """
    marked = _in_order(df, order)
    before = _before(marked.groupBy("_p").agg(F.count("*").alias("_n")))
    return marked.join(before, "_p").select(*df.columns, (F.col("_before") + F.col("_i")).alias(out))


def offsets(df: DataFrame, key: str, length: str, out: str = "start") -> DataFrame:
    """Start of each sequence in the packed order of ``key``: earlier partitions' sum plus the running one."""
    marked = _in_order(df, [F.col(key)])
    before = _before(marked.groupBy("_p").agg(F.sum(length).alias("_n")))
    running = F.sum(length).over(Window.partitionBy("_p").orderBy("_i")) - F.col(length)
    return marked.withColumn("_r", running).join(before, "_p").select(*df.columns, (F.col("_before") + F.col("_r")).alias(out))


def chunk_of(key: Column, total: Column, n: int) -> Column:
    """Equal chunks in order; the count must divide."""
    size = F.when(total % n == 0, F.floor(total / n)).otherwise(F.raise_error(F.lit("count does not divide")).cast("long"))
    return F.floor(key / size).cast("int")


def rank_of(key: Column, total: Column, ranks: int) -> Column:
    """Contiguous shards whose first ones take the remainder, one row each."""
    base, extra = F.floor(total / ranks), total % ranks
    head = (base + 1) * extra
    return F.when(key < head, F.floor(key / (base + 1))).otherwise(extra + F.floor((key - head) / F.greatest(base, F.lit(1)))).cast("int")


def fold(df: DataFrame, n: int, key: str = "row_id", value: str = "value") -> DataFrame:
    """``[n, B/n]``: the values of each of ``n`` consecutive folds, in order."""
    total = df.count()
    if total % n:
        raise ValueError("count does not divide")
    size = total // n
    item = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    return df.groupBy(F.floor(F.col(key) / size).cast("int").alias("fold")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias("values"))


def unfold(df: DataFrame, key: str = "row_id", value: str = "value") -> DataFrame:
    out = df.select("fold", F.posexplode("values").alias("at", value), F.size("values").alias("_n"))
    return out.select((F.col("fold") * F.col("_n") + F.col("at")).cast("long").alias(key), value)


def mini_batches(df: DataFrame, size: int, epochs: int, key: str = "row_id") -> DataFrame:
    """Rows with ``epoch`` and ``batch``, every epoch the same order."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col(key) / size).cast("int"))


def reorder(df: DataFrame, permutation: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows renumbered by ``(old, new)``."""
    return df.join(permutation, df[key] == permutation["old"]).drop("old", key).withColumnRenamed("new", key)


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("new").alias("old"), F.col("old").alias("new"))


def keep_multiple(df: DataFrame, k: int, key: str = "row_id") -> DataFrame:
    """The longest prefix whose count divides by ``k``."""
    total = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    return df.crossJoin(total).where(F.col(key) < F.col("_n") - F.col("_n") % k).drop("_n")


def index_range(df: DataFrame, start: int = 0, end: int = -1, key: str = "row_id") -> DataFrame:
    """Rows ``start`` to ``end``, -1 for all; an end of 0 is an empty range."""
    out = df.where(F.col(key) >= start)
    return out if end == -1 else out.where(F.col(key) < end)


def sample(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def shuffled(df: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    """Rows in an order that depends on the seed and the key alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def first_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def without_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key was not produced before."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def positional_split(df: DataFrame, share: float, total: Column, key: str = "row_id") -> Column:
    """True in the leading ``share`` of the rows by position."""
    return F.col(key) < F.floor(total * F.lit(share))


def unpivot_pair(df: DataFrame, first: str, second: str, out: str = "response") -> DataFrame:
    """Two rows a row, ``first`` before ``second``, with their place."""
    return df.select("*", F.posexplode(F.array(first, second)).alias("place", out)).drop(first, second)


def lists(df: DataFrame, columns: list[str], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Rows to one ordered list a column, for each group of ``by``."""
    item = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)))
    one = df.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return one.select(*(by or []), *(F.col(f"_l._c{i}").alias(c) for i, c in enumerate(columns)))


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; the query fails where a row's arrays differ in length."""
    first, *rest = columns
    same = F.lit(True)
    for c in rest:
        same = same & F.size(first).eqNullSafe(F.size(c))
    return df.withColumn(first, F.when(same, F.col(first)).otherwise(F.raise_error(F.lit(f"lengths of {columns} differ")).cast(df.schema[first].dataType)))


def overridden(values: dict, config: dict) -> dict:
    """``values`` with those of ``config`` for the keys they have."""
    return {k: config.get(k, v) for k, v in values.items()}


def reduced(metrics: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The mean of each metric."""
    return metrics.groupBy(key).agg(F.avg(value).alias("mean"))


def shuffled(seed: int, epoch: int, key: str) -> list[Column]:
    """An order of the rows that depends on seed, epoch and key alone."""
    return [F.md5(F.concat_ws("/", F.lit(seed), F.lit(epoch), F.col(key)).cast("binary")), F.col(key)]


def rank_batches(df: DataFrame, ranks: int, seed: int, epoch: int = 0, key: str = "row_id", drop_last: bool = True) -> DataFrame:
    """Rows dealt to ``ranks`` in turn, in an order of seed and epoch: ``at`` is the place, ``rank`` its rank.

    Ranks get equally many: the rest goes with ``drop_last``, else leading rows come again.
    Keys must differ.
    """
    placed = numbered(df, shuffled(seed, epoch, key), "at")
    even = keep_multiple(placed, ranks, "at") if drop_last else pad_to_divisor(placed, ranks, "at").drop("is_pad")
    return even.withColumn("rank", F.pmod("at", F.lit(ranks)).cast("int"))


def training_batches(df: DataFrame, size: int, seed: int, multiplier: float = 1.0, epoch: int = 0, key: str = "row_id") -> DataFrame:
    """Full batches of ``size`` times the over-fetch ``multiplier``, rounded down, in a shuffled order; a last short one goes."""
    rows = int(size * multiplier)
    placed = numbered(df, shuffled(seed, epoch, key), "at")
    return keep_multiple(placed, rows, "at").withColumn("batch", F.floor(F.col("at") / rows))
