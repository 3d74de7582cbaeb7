"""Token files: ids in Simple-8b words, written in document order and read back.

A file is a run of blocks, each followed by a newline:

    magic "TK8B", u32 shard, u32 documents, u32 ids, u32 words, u32 starts,
    i64 document ids, u32 document lengths, u32 word offset of each run, u64 words

A 64-bit word is a 4-bit selector and 60 bits of data.  ``SELECTORS`` lists how many ids of
which width a selector packs; the first two stand for runs of zeros and the last is the
escape, one id of up to 60 bits where nothing narrower fits.  Coding starts afresh every
``RUN`` ids; with each run's word offset, all runs of a block are coded and decoded at once
by numpy.  Spark's own writer commits the files, so a lost task or executor leaves no part
of a file behind, and any store that Spark can write to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import packed, words
from .bpe import encoded, vocabulary
from .storage import bucket_count, keep, new_path

#: Fixed values of the coding: (ids in a word, bits of each).
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([c for c, _ in SELECTORS])
RUN = 512
BLOCK_IDS = 1 << 20
HEAD = struct.Struct("<4sIIIII")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` and the word offset of each run of RUN ids.

    Runs are the rows of a table with zeros behind them, so windows past a run's end need
    no care.  The widest id of each window of a selector's length comes from two windows of
    a shorter one.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    rows, pitch = -(-n // RUN), RUN + int(COUNT.max())
    table = np.zeros((rows, RUN), np.uint64)
    table.ravel()[:n] = ids
    padded = np.zeros((rows, pitch), np.uint64)
    padded[:, :RUN] = table
    width = np.zeros((rows, pitch), np.uint8)
    width[:, :RUN] = np.frexp(table.astype(np.float64))[1]
    best = np.full((rows, RUN), len(SELECTORS) - 1, np.uint8)
    size, widest = 1, width
    for k in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[k]
        while size < count:
            more = min(2 * size, count)
            next_widest = widest.copy()
            np.maximum(widest[:, : pitch - more + size], widest[:, more - size :], out=next_widest[:, : pitch - more + size])
            size, widest = more, next_widest
        np.copyto(best, np.uint8(k), where=widest[:, :RUN] <= bits)
    length = np.full(rows, RUN)
    length[-1] = n - RUN * (rows - 1)
    step = COUNT[best].ravel()
    run, at, got = np.arange(rows), np.zeros(rows, np.int64), []
    while len(run):  # the next word of every run that isn't at its end
        got.append(run * RUN + at)
        at = at + step[got[-1]]
        more = at < length[run]
        run, at = run[more], at[more]
    starts = np.sort(np.concatenate(got))
    run_of = starts // RUN
    offsets = np.concatenate(([0], np.cumsum(np.bincount(run_of))[:-1])).astype(np.uint32)
    selector = best.ravel()[starts]
    out = selector.astype(np.uint64) << np.uint64(60)
    source, first = padded.ravel(), run_of * pitch + starts % RUN
    for k in np.unique(selector).tolist():
        count, bits = SELECTORS[k]
        if bits:
            mine = np.flatnonzero(selector == k)
            part, at = out[mine], first[mine]
            for j in range(count):
                part |= source[at + j] << np.uint64(j * bits)
            out[mine] = part
    return out, offsets


def unpack(code: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of ``pack``."""
    if not n:
        return np.zeros(0, np.uint32)
    selector = (code >> np.uint64(60)).astype(np.int64)
    counts = COUNT[selector]
    before = np.concatenate(([0], np.cumsum(counts)))
    run_of = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(code))))
    start = before[:-1] - before[offsets.astype(np.int64)][run_of] + run_of * RUN
    end = np.minimum(start + counts, np.minimum((run_of + 1) * RUN, n))
    out = np.zeros(n + 1, np.uint64)
    for k in np.unique(selector).tolist():
        count, bits = SELECTORS[k]
        if bits:
            mine = np.flatnonzero(selector == k)
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                i = start[mine] + j
                out[np.where(i < end[mine], i, n)] = (code[mine] >> np.uint64(j * bits)) & mask
    return out[:n].astype(np.uint32)


def block(shard: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    code, offsets = pack(ids)
    head = HEAD.pack(b"TK8B", shard, len(doc_ids), len(ids), len(code), len(offsets))
    return b"".join((head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), code.astype("<u8").tobytes()))


def blocks(content: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, document ids, document lengths, ids) of each block of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, shard, docs, n, n_words, n_runs = HEAD.unpack_from(view, at)
        if magic != b"TK8B":
            raise ValueError("not a token file")
        at += HEAD.size
        parts = []
        for dtype, count in (("<i8", docs), ("<u4", docs), ("<u4", n_runs), ("<u8", n_words)):
            parts.append(np.frombuffer(view, dtype, count, at))
            at += count * np.dtype(dtype).itemsize
        at += 1  # the newline
        yield shard, parts[0], parts[1].astype(np.int64), unpack(parts[3], parts[2], n)


def _block_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, shard = vocabulary(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids, owners, lengths, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = block(shard, np.array(owners, np.int64), np.array(lengths, np.int64), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["block"])

        try:
            for batch in words.text_batches(batches):
                own, at = packed.ids(batch.column(0)).tolist(), 0
                for got, bounds in encoded(batch.column(1), v):
                    cuts = bounds.tolist()
                    for i, j in zip(cuts, cuts[1:]):
                        ids += (got[i:j], end)
                        owners.append(own[at])
                        lengths.append(j - i + 1)
                        total += j - i + 1
                        at += 1
                        if total >= BLOCK_IDS:
                            yield flush()
                            ids, owners, lengths, total = [], [], [], 0
            if owners:
                yield flush()
        finally:
            v.forget()
            words.give_back()

    return run


def write_token_files(docs: DataFrame, where: str, path: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, each closed by ``end_id``, and write them to token files below ``where``.

    Files follow each other in ascending id order, rows without an id last; rows that share
    an id, or have none, follow each other by a hash of the text, and equal rows as they are
    read, so that any number of them spreads over the files.  A null text is an empty one
    and has just the end id.  An empty table gives no blocks.  Other columns are ignored,
    whatever their names.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("at")]
    placed = rows.repartitionByRange(bucket_count(rows, 4 << 20), *order).sortWithinPartitions(*order)
    coded = placed.select("doc_id", "text").mapInArrow(_block_rows(path, end_id), "block binary")
    coded.select(F.col("block").cast("string").alias("value")).write.text(where)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            start = 0
            for shard, owners, lengths, ids in blocks(content.as_buffer()):
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                cols = [packed.id_array(owners), pa.array(np.full(len(owners), shard, np.int64)), pa.array(bounds[:-1] + start), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "within", "n_tokens", "ids_crc32"])
                start += int(bounds[-1])


def read_token_files(spark, where: str) -> DataFrame:
    """Index of token files, from their decoded contents: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before, over all files in shard order.
    """
    ship_package(spark)
    content = spark.read.format("binaryFile").load(where).where("length > 0").select("content")
    docs = keep(content.mapInArrow(_read_rows, "doc_id long, shard long, within long, n_tokens long, ids_crc32 long"), "token-index")
    shards = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return their index, read back."""
    where = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, where, path, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, where)
