"""Packed exchanges: many (key, owner, payload) entries in one shuffle row.

A window or shingle join moves several entries for every word of the corpus.  As single
rows each would cost some 40 bytes; here a task packs the entries of one key bucket into
one row of byte planes (all first bytes, all second bytes, ...), which compress well.

Entries of one bucket meet in one task.  A key that is frequent anywhere is reduced where
it arises: within a task's chunk, entries whose answer is already known leave by the side
(kind DONE) and at most one entry of such a key is sent on, so a key that a third of all
rows hold reaches its bucket once per chunk.  A bucket's size follows the input's through
``storage.bucket_count``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

ASK, SEEN, DONE, MEMBER = 0, 1, 2, 3
SCHEMA = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("keys", pa.binary()), ("ords", pa.binary()), ("extra", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary())])
DDL = "kind byte, bucket int, keys binary, ords binary, extra binary, owners binary, sizes binary"


#: Stands for a null id inside packed rows.
NULL_ID = np.iinfo(np.int64).min


def ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(column, NULL_ID))


def id_array(a: np.ndarray) -> pa.Array:
    return pa.array(a, mask=a == NULL_ID)


def planes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""


def unplanes(b: bytes | None, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not b:
        return np.zeros(0, dtype)
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def row(kind: int, bucket: int, keys=None, ords=None, extra=None, owners=None, sizes=None) -> dict:
    got = {"keys": keys, "ords": ords, "extra": extra, "owners": owners, "sizes": sizes}
    return {"kind": kind, "bucket": bucket} | {k: None if v is None else planes(v) for k, v in got.items()}


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def cut(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers present and the bounds of each in the sorted 64-bit ``keys``."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    which = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = runs(which)
    return which[at].astype(np.int64), np.append(at, len(keys))


def compact(ords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners that occur, and each entry's index among them."""
    mark = np.zeros(int(ords.max()) + 1 if len(ords) else 0, bool)
    mark[ords] = True
    return np.flatnonzero(mark), (np.cumsum(mark) - 1)[ords]


def send(kind: int, keys: np.ndarray, ords: np.ndarray, extra: np.ndarray | None, owners: np.ndarray, sizes: np.ndarray | None, buckets: int, by_owner: bool = False) -> Iterator[dict]:
    """Rows for entries, one per bucket; the bucket follows the key, or the owner."""
    if not len(keys):
        return
    if by_owner:
        spread = owners.astype(np.uint64) if sizes is None else owners.astype(np.uint64) + (sizes.astype(np.uint64) << np.uint64(20))
        spread = (spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        to = (spread % np.uint64(buckets)).astype(np.int64)[ords]
        order = np.argsort(to, kind="stable")
        keys, ords, to = keys[order], ords[order], to[order]
        extra = None if extra is None else extra[order]
        at = runs(to)
        which, bounds = to[at], np.append(at, len(to))
    else:
        which, bounds = cut(keys, buckets)
    for w, a, b in zip(which.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        own, local = compact(ords[a:b])
        yield row(kind, w, keys[a:b], local.astype(np.uint32), None if extra is None else extra[a:b], owners[own], None if sizes is None else sizes[own])


class Entries:
    """Entries of several packed rows, joined."""

    def __init__(self, table: pa.Table, kind: int, owner_type, extra_type=np.int32):
        keys, ords, extra, owners, sizes, base = [], [], [], [], [], 0
        part = table.filter(pa.compute.equal(table["kind"], kind))
        for r in part.to_pylist():
            own = unplanes(r["owners"], owner_type)
            keys.append(unplanes(r["keys"], np.uint64))
            ords.append(unplanes(r["ords"], np.uint32).astype(np.int64) + base)
            extra.append(unplanes(r["extra"], extra_type))
            owners.append(own)
            sizes.append(unplanes(r["sizes"], np.int32))
            base += len(own)
        join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.keys, self.ords, self.extra = join(keys, np.uint64), join(ords, np.int64), join(extra, extra_type)
        self.owners, self.sizes = join(owners, owner_type), join(sizes, np.int32)

    def take(self, which: np.ndarray) -> None:
        self.keys, self.ords = self.keys[which], self.ords[which]
        if len(self.extra):
            self.extra = self.extra[which]


def among(sorted_values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_values, keys)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == keys


def shared_entries(e: Entries, seen: np.ndarray) -> None:
    """Keep the entries whose key belongs to two different owners, or is in ``seen``."""
    ordered = np.sort(e.keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    seen = np.unique(seen)
    e.take(among(seen, e.keys) | among(twice, e.keys))
    order = np.argsort(e.keys)
    e.take(order)
    if not len(e.keys):
        return
    at, own = runs(e.keys), e.owners[e.ords]
    many = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
    e.take(np.repeat(many, np.diff(np.append(at, len(own)))) | among(seen, e.keys))


def later_entries(e: Entries) -> None:
    """Keep the entries whose key also belongs to a smaller owner."""
    ordered = np.sort(e.keys)
    e.take(among(np.unique(ordered[1:][ordered[1:] == ordered[:-1]]), e.keys))
    e.take(np.argsort(e.keys))
    if not len(e.keys):
        return
    at, own = runs(e.keys), e.owners[e.ords]
    e.take(own > np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(own)))))


def local_split(keys: np.ndarray, owner_of: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys of a chunk: masks of entries to ASK about and of those DONE, and keys SEEN with two owners."""
    if not len(keys):
        z = np.zeros(0, bool)
        return z, z, keys
    at = runs(keys)
    lengths = np.diff(np.append(at, len(keys)))
    least, most = np.minimum.reduceat(owner_of, at), np.maximum.reduceat(owner_of, at)
    if later:
        done = owner_of > np.repeat(least, lengths)
        return ~done, done, keys[:0]
    many = least != most
    done = np.repeat(many, lengths)
    return ~done, done, keys[at[many]]


def by_bucket(df, fn: Callable[[pa.Table], Iterator[dict]], fields: str | None = None):
    """Apply ``fn`` to all packed rows of each bucket; it yields packed rows, or rows of ``fields``."""
    if fields is None:
        def packed_rows(table: pa.Table) -> pa.Table:
            return pa.Table.from_pylist(list(fn(table)), SCHEMA)

        return df.groupBy("bucket").applyInArrow(packed_rows, DDL)
    return df.groupBy("bucket").applyInArrow(fn, fields)
