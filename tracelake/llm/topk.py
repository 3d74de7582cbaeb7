"""Exact top-k search by inner product.

Method (columnar branch-and-bound).  Vectors are integers, a table of candidates is held
vertically, a row a dimension.  For a tile of queries scores accumulate dimension block by
block; after each, a pair's final score is at most its partial score plus the product of
both vectors' remaining masses (Cauchy-Schwarz on the dimensions not yet read).  Candidates
that can no longer reach a query's current k-th score are dropped and the rest compacted
before the next block.  Dimensions are read in descending mass.

Queries are numbered and come in super-blocks of at most ``QUERY_BLOCK`` vectors: one is sent to all
executors, every candidate is read once for it, each task keeps its k best for each query,
and the k best of those are the answer.  Nothing depends on how many candidates there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import words
from .storage import discard, keep

QUERY_BLOCK, TILE, CANDIDATES, DIMS = 8192, 256, 8192, 16


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` in doubles; vectors that are null or hold a null or non-finite component are left out."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as whole doubles; as Python integers where doubles can't hold them."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if out.size and not np.abs(out).max() < 1 << 53:
        return np.array([math.floor(scale * Fraction(v)) for v in x.ravel().tolist()], object).reshape(x.shape)
    return out


def _matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of whole numbers, one a vector length."""
    ids, lists = np.asarray(batch.column(0)), batch.column(1)
    lengths, flat, starts = np.diff(np.asarray(lists.offsets)), np.asarray(lists.values), np.asarray(lists.offsets)[:-1]
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], scaled(flat[starts[rows][:, None] + np.arange(d)], scale)


class Best:
    """The k best (score, id) of each query so far; unused places have the lowest score."""

    def __init__(self, queries: int, k: int):
        self.k, self.none = k, np.iinfo(np.int64).min
        self.score = np.full((queries, k), self.none)
        self.id = np.full((queries, k), -1)

    def put(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[q], scores)), np.concatenate((self.id[q], ids))
        real = np.flatnonzero(s != self.none)
        order = real[np.lexsort((i[real], -s[real]))][: self.k]
        self.score[q, : len(order)], self.id[q, : len(order)] = s[order], i[order]
        self.score[q, len(order) :] = self.none

    def least(self) -> np.ndarray:
        return self.score[:, -1]


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, best: Best, places: np.ndarray) -> None:
    """Improve ``best`` (rows ``places`` for these queries) by the candidates ``c``, a row each."""
    d = q.shape[1]
    if not len(c) or not len(q):
        return
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(d, 1)
    kind = object if object in (q.dtype, c.dtype) else np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object  # exact in each
    if kind is object:
        return _search_large(q_ids, q, c_ids, c, best, places)
    order = np.argsort(-np.abs(c.astype(np.float64)).sum(axis=0), kind="stable")
    vertical, q = np.ascontiguousarray(c.T[order]).astype(kind), q[:, order].astype(kind)
    mass = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    rest_c, rest_q = mass(vertical), mass(q.T)
    for a in range(0, len(q), TILE):
        tile = slice(a, a + TILE)
        own = places[tile]
        first = min(2 * DIMS, d)
        partial = q[tile, :first] @ vertical[:first] if d else np.zeros((len(own), len(c)), np.int64)
        floor = best.least()[own].astype(np.float64)
        bound = partial.astype(np.float64)
        if first < d:
            bound += rest_q[first, tile][:, None] * rest_c[first][None, :] * (1 + 1e-9) + 1e-6
        open_pairs = bound >= floor[:, None]
        for i, place in enumerate(own.tolist()):
            alive = np.flatnonzero(open_pairs[i] & (c_ids != q_ids[a + i]))
            s = partial[i, alive]
            for at in range(first, d, DIMS):
                if not len(alive):
                    break
                end = min(at + DIMS, d)
                s = s + q[a + i, at:end] @ vertical[at:end, alive]
                if end < d:
                    good = s.astype(np.float64) + rest_q[end, a + i] * rest_c[end, alive] * (1 + 1e-9) + 1e-6 >= best.score[place, -1]
                    alive, s = alive[good], s[good]
            if len(alive):
                s = s.astype(np.int64)
                good = s >= best.score[place, -1]
                s, alive = s[good], alive[good]
                if len(s) > 4 * best.k:  # ties of the k-th stay in
                    cut = np.partition(s, len(s) - best.k)[len(s) - best.k]
                    s, alive = s[s >= cut], alive[s >= cut]
                best.put(place, s, c_ids[alive])


def _search_large(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, best: Best, places: np.ndarray) -> None:
    """The same for vectors whose products doubles can't hold, a query at a time; scores are cut to a long's range at the end."""
    whole = np.frompyfunc(int, 1, 1)
    q, c = whole(q), whole(c)
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    for i, place in enumerate(places.tolist()):
        other = np.flatnonzero(c_ids != q_ids[i])
        s = np.array([min(high, max(low, x)) for x in (c[other] @ q[i]).tolist()], np.int64)
        best.put(place, s, c_ids[other])


def _task(sent, first: int, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, by_length = sent.value
        best = Best(len(q_ids), k)
        held: dict[int, list] = {}

        def flush(d: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(d)))
            if d in by_length:
                places, q = by_length[d]
                for a in range(0, len(ids), CANDIDATES):
                    search_block(q_ids[places], q, ids[a : a + CANDIDATES], rows[a : a + CANDIDATES], best, places)

        for batch in batches:
            for ids, rows in _matrices(batch, scale):
                held.setdefault(rows.shape[1], []).append((ids, rows))
                if sum(len(x) for x, _ in held[rows.shape[1]]) >= CANDIDATES:
                    flush(rows.shape[1])
        for d in list(held):
            flush(d)
        q, place = np.nonzero(best.score != best.none)
        yield pa.RecordBatch.from_arrays([pa.array(first + q), pa.array(q_ids[q]), pa.array(best.id[q, place]), pa.array(best.score[q, place])], names=["nth", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best other rows for each row that ``queries`` selects: ``query_id, rank, vec_id, score``.

    Scores are inner products of ``floor(scale * x)``; ties go to the smaller id, ranks start
    at 1, and fewer rows come where there are fewer candidates.  A row is no candidate for
    queries of its own id.  Rows that repeat an id are candidates each, and queries each, with
    ranks of their own.  Rows with a null id or vector, or a null or non-finite component,
    take no part.  Vectors of another length than the query's are no candidates.  Any finite
    component takes part; scores beyond a long's range are cut to it and tie there.  Empty
    tables give none.  Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    data = finite_vectors(vectors, id_col, vector_col)
    asked, count = _numbered(finite_vectors(vectors.where(queries), id_col, vector_col))
    blocks = max(1, -(-count // QUERY_BLOCK))
    found = None
    for b in range(blocks):  # of queries by number, so each is bounded; not groups of the data
        first = b * QUERY_BLOCK
        table = asked.where(F.col("nth").between(first, first + QUERY_BLOCK - 1)).select("id", "v").toArrow().combine_chunks()
        ids, by_length, at = np.asarray(table["id"]), {}, 0
        for batch in table.to_batches():
            lengths = np.diff(np.asarray(batch.column(1).offsets))
            for own, rows in _matrices(batch, scale):
                by_length.setdefault(rows.shape[1], []).append((at + np.flatnonzero(lengths == rows.shape[1]), rows))
            at += batch.num_rows
        sent = spark.sparkContext.broadcast((ids, {d: tuple(map(np.concatenate, zip(*parts))) for d, parts in by_length.items()}))
        got = data.mapInArrow(words.tidy(_task(sent, first, k, scale)), "nth long, query_id long, vec_id long, score long")
        if blocks > 1:
            got = keep(got, "top-k")
        found = got if found is None else found.unionByName(got)
    discard(asked)
    w = Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _numbered(asked: DataFrame) -> tuple[DataFrame, int]:
    """The queries, written with a number ``nth`` from 0 each, and how many they are."""
    place = F.monotonically_increasing_id()
    table = keep(asked.withColumn("p", F.shiftright(place, 33).cast("long")).withColumn("i", place.bitwiseAND(F.lit((1 << 33) - 1))), "queries")
    before, total = [], 0
    for r in table.groupBy("p").count().orderBy("p").collect():  # a row a partition that holds queries
        before.append((r.p, total))
        total += r["count"]
    starts = asked.sparkSession.createDataFrame(before, "p long, before long")
    out = table.join(F.broadcast(starts), "p").select((F.col("before") + F.col("i")).alias("nth"), "id", "v")
    out.kept_path = table.kept_path
    return out, total
