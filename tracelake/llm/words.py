"""Words and hashes of whole Arrow text columns, without a Python loop over words.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):  # freed arrays above 4 MB go back to the system at once (M_MMAP_THRESHOLD)
    _libc.mallopt(-3, 4 << 20)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """The usual 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) | U64(1)


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Flat words and the n+1 offsets of each text's words; a null text has none."""
    if texts.offset:  # the kernels below misread slices
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
    if empty.any():  # before a leading or after a trailing space
        before = np.concatenate(([0], np.cumsum(empty)))
        offsets = offsets - before[offsets]
        flat = flat.filter(pa.array(~empty))
    return flat, offsets


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word of the batch is hashed once."""
    if len(words) == 0:
        return np.zeros(0, U64)
    coded = words.dictionary_encode()
    own = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), U64, len(own))
    return table[np.asarray(coded.indices)]


def chunks(offsets: np.ndarray, most_docs: int, most_words: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most so many documents and words (one document may exceed the latter)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_words, side="right")) - 1
        end = min(n, start + most_docs, max(end, start + 1))
        yield start, end
        start = end


def give_back() -> None:
    """Return freed memory of this worker to the system; it may stay idle for long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, followed by ``give_back`` when the task ends."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds few bytes, whatever the length of single texts."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most_bytes:
            yield batch
            continue
        step = max(1, batch.num_rows * most_bytes // batch.nbytes)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
