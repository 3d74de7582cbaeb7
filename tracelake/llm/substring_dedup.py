"""Substring dedup: remove passages of many words that an earlier document also holds.

Method (difference-cover anchors).  ``COVER`` is a difference cover modulo ``PERIOD``: any
residue is the difference of two members.  If the windows at word i of one document and at
word j of another are equal, some shift below ``PERIOD`` takes both i and j to cover
positions, so hashing only the ``window - PERIOD + 1`` words at cover positions (5 of 21)
finds an aligned anchor inside every equal window.  A packed exchange tells which anchors
two documents share; only windows around those are hashed whole and given their smallest
document by a second exchange, which extends each match to its full length.  Entries of
frequent passages are reduced in each chunk before they are sent (see ``packed``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import packed, words
from .storage import bucket_count, discard, keep

U64 = np.uint64
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
CHUNK_WORDS = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of runs of words of one chunk; equal runs hash equally wherever they stand."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * _powers(BASE, n), dtype=U64)))
        self.back = _powers(pow(BASE, -1, 1 << 64), n + 1)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return words.mix((self.sums[starts + length] - self.sums[starts]) * self.back[starts])


def _spread(batches: Iterator[pa.RecordBatch]):
    """(batch, first row, last row, word hashes, offsets) of chunks."""
    for batch in words.text_batches(batches):
        flat, offsets = words.split(batch.column(1))
        hashes = words.hashes(flat)
        for a, b in words.chunks(offsets, 1 << 15, CHUNK_WORDS):
            yield batch, a, b, hashes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _emit(keys: np.ndarray, ords: np.ndarray, extra: np.ndarray, owners: np.ndarray, texts: np.ndarray, buckets: int, later: bool) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, ords, extra = keys[order], ords[order], extra[order].astype(np.int32)
    ask, done, seen = packed.local_split(keys, owners[ords], later)
    out = list(packed.send(packed.ASK, keys[ask], ords[ask], extra[ask], owners, texts, buckets))
    out += packed.send(packed.DONE, np.zeros(int(done.sum()), U64), ords[done], extra[done], owners, texts, buckets, by_owner=True)
    if len(seen):
        which, bounds = packed.cut(seen, buckets)
        out += (packed.row(packed.SEEN, int(w), keys=seen[i:j]) for w, i, j in zip(which, bounds[:-1], bounds[1:]))
    return packed.batch(out)


def _anchor_rows(window: int, buckets: int):
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, hashes, offsets in _spread(batches):
            owners = packed.ids(batch.column(0).slice(a, b - a))
            lengths = np.diff(offsets)
            text_of = np.repeat(np.arange(b - a), lengths)
            place = np.arange(len(hashes)) - offsets[text_of]
            covered = np.isin(np.arange(PERIOD), COVER)[place % PERIOD]
            whole = covered & (place + length <= lengths[text_of]) & (lengths[text_of] >= window) & (owners != packed.NULL_ID)[text_of]
            starts = np.flatnonzero(whole)
            yield _emit(Rolling(hashes).at(starts, length), text_of[starts], place[starts], owners, np.asarray(batch.column(2).slice(a, b - a)), buckets, later=False)

    return run


def _answers(buckets: int, later: bool):
    def run(table: pa.Table) -> Iterator[dict]:
        e = packed.Entries(table, packed.ASK, np.int64)
        if later:
            packed.later_entries(e)
        else:
            seen = [packed.unplanes(x, U64) for x in table.filter(pa.compute.equal(table["kind"], packed.SEEN))["keys"].to_pylist()]
            packed.shared_entries(e, np.concatenate(seen) if seen else np.zeros(0, U64))
        yield from packed.send(packed.DONE, np.zeros(len(e.keys), U64), e.ords, e.extra, e.owners, e.sizes, buckets, by_owner=True)
        yield from table.filter(pa.compute.equal(table["kind"], packed.DONE)).to_pylist()

    return run


def _places(table: pa.Table) -> pa.Table:
    """The found word positions of each document of a bucket, ascending, as 4-byte integers."""
    e = packed.Entries(table, packed.DONE, np.int64)
    own, text = e.owners[e.ords], e.sizes[e.ords]
    order = np.lexsort((e.extra, text, own))
    own, text, places = own[order], text[order], e.extra[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    again = ~new  # equal rows have each found theirs
    again[1:] &= places[1:] == places[:-1]
    own, text, places, new = own[~again], text[~again], places[~again], new[~again]
    bounds = np.append(np.flatnonzero(new), len(own))
    spans = [places[i:j].astype("<i4").tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
    return pa.table({"id": pa.array(own[bounds[:-1]]), "text_hash": pa.array(text[bounds[:-1]]), "places": pa.array(spans, pa.binary())})


def _window_rows(window: int, buckets: int):
    """Entries of the whole windows around shared anchors."""
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, hashes, offsets in _spread(batches):
            owners = packed.ids(batch.column(0).slice(a, b - a))
            change = np.zeros(len(hashes) + 1, np.int64)
            for i, places in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                n = int(offsets[i + 1] - offsets[i])
                at = np.frombuffer(places, "<i4").astype(np.int64)
                at = at[at + length <= n]
                if n < window or not len(at):
                    continue
                first, last = np.maximum(0, at + length - window), np.minimum(at, n - window)
                first, last = first[first <= last], last[first <= last]
                np.add.at(change, offsets[i] + first, 1)
                np.add.at(change, offsets[i] + last + 1, -1)
            starts = np.flatnonzero(np.cumsum(change)[:-1] > 0)
            text_of = np.searchsorted(offsets, starts, side="right") - 1
            yield _emit(Rolling(hashes).at(starts, window), text_of, starts - offsets[text_of], owners, np.asarray(batch.column(2).slice(a, b - a)), buckets, later=True)

    return run


def kept_words(text: str | None, places: bytes | None, window: int) -> tuple[int, int, bytes]:
    """Words of a text, how many of them go, and the kept ones joined by one space."""
    own = text.encode("utf-8", "surrogatepass").split() if text else []
    n = len(own)
    if not places:
        return n, 0, b" ".join(own)
    at = np.frombuffer(places, "<i4").astype(np.int64)
    at = at[at < n]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + window, n), -1)
    gone = np.cumsum(change)[:n] > 0
    return n, int(gone.sum()), b" ".join(w for w, g in zip(own, gone.tolist()) if not g)


def _cut_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.text_batches(batches):
            got = [kept_words(t.as_py(), p.as_py(), window) for t, p in zip(batch.column(1), batch.column(3))]
            cols = [batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x[2].decode("utf-8") for x in got]))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document of smaller id.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by one
    space) and ``kept_text``, a row for each row of ``docs``.  Windows are judged on the
    input.  Words are compared unchanged; a null or empty text has none.  Repeats inside one
    document, or among rows that share an id, don't count; rows that share an id are separate
    documents, told apart by a hash of their texts.  A row without an id keeps its words and
    removes none elsewhere.  Texts below ``window`` words are kept.  Other columns are
    ignored, whatever their names.  An empty table gives none.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD} words")
    spark = docs.sparkSession
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.hash(text).alias("text_hash"))
    buckets, found = bucket_count(rows), "id long, text_hash int, places binary"
    anchors = packed.by_bucket(rows.mapInArrow(words.tidy(_anchor_rows(window, buckets)), packed.DDL), _answers(buckets, later=False))
    anchors = keep(packed.by_bucket(anchors, _places, found), "anchors")
    near = rows.join(anchors, ["id", "text_hash"]).select("id", "text", "text_hash", "places")
    windows = packed.by_bucket(near.mapInArrow(words.tidy(_window_rows(window, buckets)), packed.DDL), _answers(buckets, later=True))
    starts = keep(packed.by_bucket(windows, _places, found), "windows")
    discard(anchors)
    out = rows.join(starts, ["id", "text_hash"], "left").select("id", "text", "text_hash", "places")
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return out.mapInArrow(words.tidy(_cut_rows(window, with_text)), fields)
