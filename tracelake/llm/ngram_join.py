"""N-gram Jaccard join: documents whose sets of word shingles are similar, exactly.

Method (PartEnum, after Arasu, Ganti and Kaushik, "Efficient exact set-similarity joins"):

1. Sets are cut into size bands ``[l, l / threshold]``; two similar sets lie in one band
   or in neighbouring ones, so a set takes part in its own band's instance and the next.
   Equal sets become one node first; a node is the 64-bit hash of its set.
2. Only shingles that two nodes share can be common to a pair.  A packed exchange finds
   them; a node with less than ``threshold`` of its shingles shared links with nothing.
   What is left of a node is its shared part; its unshared shingles are known differences.
3. An instance hashes the shingle domain into ``n1`` groups of ``n2`` partitions.  Sets of
   the band differ in at most ``k = (|A| + |B|) * (1 - t) / (1 + t)`` elements, hence in at
   most ``k2`` of some group; a signature is a group and the contents of ``n2 - k2`` of its
   partitions, one for each such subset.  Signatures over empty partitions would be shared
   by strangers: a node emits them only if its groups without empty subsets are too few to
   force a common nonempty one (``covered``), so no pair is lost either way.
4. Signatures travel packed by bucket (see ``packed``), with node, sizes and label; they
   are made anew from the nodes for each round, so no table of them is ever written.  Nodes
   that share one are verified against the group's smallest node, exactly; links give
   components.  In a second round the smallest node of a group's second component is the
   pivot.  Both rounds need not find every pair, so they take each node's smallest
   signatures only, which similar nodes have in common; and they reduce a signature within
   each chunk first, so one that millions of nodes share reaches its bucket as one node a
   chunk.
5. By all signatures, groups that still hold several components are searched whole: those of at most
   ``SMALL_GROUP`` nodes pair by pair.  The nodes of larger ones mostly share a common line
   only, so they meet once more, by their rarest elements (prefix filter): where all elements
   are ordered from rare to frequent, similar sets share one of the first
   ``n - ceil(t * n) + 1``.  Elements of one component's nodes come first of all, as no pair
   of two components has them in common.  Groups by these are searched in the same way; what is still
   larger goes block against block, where nodes of a cluster's largest component need no
   comparison with each other.  A group of copies thus costs its length, not its square, and
   a line that many different texts hold costs nothing where they have enough rarer elements.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import packed, words
from .graph import components
from .storage import bucket_count, discard, keep

U64 = np.uint64
ORD_BITS = 12  # documents of a chunk; the other 52 bits of an entry are the shingle's hash
CHUNK_WORDS = 1_000_000
BUCKET_ENTRIES, DONE_ENTRIES = 1_000_000, 1 << 18  # shared shingles of a bucket of nodes, and of a packed row of them
NARROWINGS = 2
SMALL_GROUP = 32  # nodes of a signature's group up to which its pairs are looked at one by one
BLOCK, SLICE = 256, 2048  # nodes of a block, elements of a matrix
STAR_SIGNATURES = 64  # smallest signatures of a node that the first two rounds use; the last uses all
SIGNATURE_NODES, SIGNATURE_ELEMENTS = 1024, 400_000  # nodes of a chunk of signatures, and elements of their sets; a larger set is a chunk of its own
MOST_TOLD = 200_000  # pairs that a task remembers to have told; beyond that one may be told again
PAIR_BYTES = 8 << 20  # of sets that are verified in one group, on average
BLOCK_FIELDS = "cluster long, apart boolean, block string, low_n int, high_n int, data binary"
MASK = U64((1 << ORD_BITS) - 1)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its set's size and 64-bit set hash; and all entries hash << 12 | text number, by text."""
    flat, offsets = words.split(texts, lower=True)
    w = words.hashes(flat)
    lengths = np.diff(offsets)
    c = words.odd_constants(n, 5)
    total = max(0, len(w) - n + 1)
    s = np.zeros(total, U64)
    for k in range(n):
        s += w[k : k + total] * c[k]
    text_of = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    whole = text_of[: total] == text_of[n - 1 :] if total else np.zeros(0, bool)
    hashes, owner = [s[whole]], [text_of[:total][whole]]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        h = np.zeros(len(short), U64) + lengths[short].astype(U64) * U64(0x51ED270B0B5A1F35)
        for k in range(n - 1):
            inside = lengths[short] > k
            h[inside] += w[offsets[short[inside]] + k] * c[k]
        hashes.append(h)
        owner.append(short)
    h52 = words.mix(np.concatenate(hashes)) >> U64(ORD_BITS)
    e = np.sort((np.concatenate(owner).astype(U64) << U64(64 - ORD_BITS)) | h52)
    e = e[packed.runs(e)]
    owner_of = (e >> U64(64 - ORD_BITS)).astype(np.int64)
    sizes = np.bincount(owner_of, minlength=len(lengths)).astype(np.int32)
    h52 = e & U64((1 << (64 - ORD_BITS)) - 1)
    sums = np.zeros(len(lengths), U64)
    if len(e):
        at = packed.runs(owner_of)
        sums[owner_of[at]] = np.add.reduceat(words.mix(h52 * U64(0xD6E8FEB86659FD93) + U64(1)), at)
    nodes = words.mix(sums + sizes.astype(U64) * U64(0x2545F4914F6CDD1D))
    return sizes, nodes, (h52 << U64(ORD_BITS)) | owner_of.astype(U64)


def _shingle_rows(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.text_batches(batches):
            texts = batch.column(1)
            _, offsets = words.split(texts)
            for a, b in words.chunks(offsets, 1 << ORD_BITS, CHUNK_WORDS):
                sizes, nodes, e = shingle_sets(texts.slice(a, b - a), n)
                out = [packed.row(packed.MEMBER, int(words.mix(nodes[:1] + nodes[-1:])[0] % U64(buckets)), keys=nodes, extra=packed.ids(batch.column(0).slice(a, b - a)), sizes=sizes)]
                first = np.zeros(len(nodes), bool)  # equal sets of the chunk are one node
                first[np.unique(nodes, return_index=True)[1]] = True
                e = np.sort(e[first[(e & MASK).astype(np.int64)]])
                yield packed.batch(out + _entries(e, nodes, sizes, buckets))

    return run


def _entries(e: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, buckets: int) -> list[dict]:
    """Packed rows for sorted entries hash << 12 | number of the node."""
    keys, ords = e & ~MASK, (e & MASK).astype(np.int64)
    ask, done, seen = packed.local_split(keys, nodes[ords], later=False)
    out = list(packed.send(packed.ASK, keys[ask], ords[ask], None, nodes, sizes, buckets))
    if len(keys):
        out += _done(keys[done], ords[done], nodes, sizes, int(words.mix(nodes[:1] + nodes[-1:])[0] % U64(buckets)))
    if len(seen):
        which, bounds = packed.cut(seen, buckets)
        out += (packed.row(packed.SEEN, int(w), keys=seen[i:j]) for w, i, j in zip(which, bounds[:-1], bounds[1:]))
    return out


def _done(keys: np.ndarray, ords: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, bucket: int) -> Iterator[dict]:
    """Rows of entries whose answer is known; they aren't dealt by owner yet, as that would be a row for each two buckets."""
    for a in range(0, len(keys), DONE_ENTRIES):
        own, local = packed.compact(ords[a : a + DONE_ENTRIES])
        yield packed.row(packed.DONE, bucket, keys[a : a + DONE_ENTRIES], local.astype(np.uint32), None, nodes[own], sizes[own])


def _dealt(buckets: int):
    """Packed rows of known entries, by their owner's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                e = packed.Entries(pa.Table.from_batches([batch.slice(k, 1)]), packed.DONE, U64)
                yield packed.batch(list(packed.send(packed.DONE, e.keys, e.ords, None, e.owners, e.sizes, buckets, by_owner=True)))

    return run


def _node_rows(buckets: int):
    """Entries of the shared parts of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << ORD_BITS):
                part = batch.slice(a, 1 << ORD_BITS)
                nodes, sizes, lists = np.asarray(part.column(0)).view(U64), np.asarray(part.column(1)), part.column(2)
                times = np.diff(np.asarray(lists.offsets))
                e = (np.asarray(lists.flatten()).astype(U64) << U64(ORD_BITS)) | np.repeat(np.arange(len(nodes)), times).astype(U64)
                yield packed.batch(_entries(np.sort(e), nodes, sizes, buckets))

    return run


def _shared(buckets: int):
    def run(table: pa.Table) -> Iterator[dict]:
        e = packed.Entries(table, packed.ASK, U64)
        seen = [packed.unplanes(x, U64) for x in table.filter(pa.compute.equal(table["kind"], packed.SEEN))["keys"].to_pylist()]
        packed.shared_entries(e, np.concatenate(seen) if seen else np.zeros(0, U64))
        if len(e.keys):
            yield from _done(e.keys, e.ords, e.owners, e.sizes, int((e.keys[0] >> U64(32)) * U64(buckets) >> U64(32)))
        yield from table.filter(pa.compute.greater_equal(table["kind"], packed.DONE)).to_pylist()

    return run


def _nodes(percent: int):
    """All shared shingles of the nodes of a bucket -> nodes with at least ``percent`` of theirs shared."""

    def run(table: pa.Table) -> pa.Table:
        e = packed.Entries(table, packed.DONE, U64)
        own = e.owners[e.ords]
        order = np.lexsort((e.keys, own))
        own, keys, sizes = own[order], e.keys[order], e.sizes[e.ords[order]]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]))) if len(own) else np.zeros(0, bool)
        own, keys, sizes = own[new], keys[new], sizes[new]
        at = packed.runs(own)
        counts = np.diff(np.append(at, len(own)))
        good = 100 * counts >= percent * sizes[at].astype(np.int64)
        kept = np.repeat(good, counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts[good]))).astype(np.int32)), pa.array((keys[kept] >> U64(ORD_BITS)).astype(np.int64)))
        return pa.table({"node": pa.array(own[at][good].view(np.int64)), "n": pa.array(sizes[at][good]), "shared": lists})

    return run


def band_limits(percent: int, most: int) -> list[int]:
    """Upper sizes of the bands up to the one that holds ``most``."""
    out, low = [], 1
    while not out or out[-1] < most:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return out


def instance(limit: int, percent: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of the instance whose sets have at most ``limit`` elements.

    Small sets get about one element a partition, as their differences are few anyway.
    Larger ones get groups of three, two of which agree; a quarter more groups than the
    pigeonhole needs leaves room for groups with empty partitions.
    """
    k = 2 * limit * (100 - percent) // (100 + percent)
    if limit < 64:
        return 4 * limit, 1, 0
    return math.ceil((k + 1) / 2 * 1.25) + 1, 3, 1


def signatures(n: int, shared: np.ndarray, limits: list[int], percent: int) -> np.ndarray:
    """All signatures of a set of size ``n`` whose shared elements are given."""
    band, out = int(np.searchsorted(limits, n)), []
    for at in (band, band + 1):
        limit = limits[min(at, len(limits) - 1)]
        n1, n2, k2 = instance(limit, percent)
        h = words.mix(shared.astype(U64) + U64((at + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        part = ((h >> U64(32)) * U64(n1 * n2) >> U64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        content, filled = np.zeros(n1 * n2, U64), np.zeros(n1 * n2, bool)
        if len(order):
            starts = packed.runs(part[order])
            content[part[order][starts]] = np.add.reduceat(words.mix(h)[order], starts)
            filled[part] = True
        content, filled = content.reshape(n1, n2), filled.reshape(n1, n2)
        subsets = list(itertools.combinations(range(n2), n2 - k2))
        sigs, full = np.zeros((n1, len(subsets)), U64), np.zeros((n1, len(subsets)), bool)
        tag = words.mix(np.arange(n1, dtype=U64) + U64(at) * U64(1 << 40))
        for i, subset in enumerate(subsets):
            s = tag + U64((i + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
            for j in subset:
                s = words.mix(s + content[:, j] * U64(2 * j + 1))
                full[:, i] |= filled[:, j]
            sigs[:, i] = s
        k = (n + min(n * 100 // percent, limit)) * (100 - percent) // (100 + percent)
        covered = int(full.all(axis=1).sum()) * (k2 + 1) > k - (n - len(shared))
        out.append(sigs[full] if covered else sigs.ravel())
    return np.concatenate(out)


def prefix_signatures(n: int, prefix: np.ndarray, limits: list[int], percent: int) -> np.ndarray:
    """Of a set of size ``n``: its rarest elements, in its band and the next."""
    band = int(np.searchsorted(limits, n))
    return np.concatenate([words.mix(prefix.astype(U64) + U64((at + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) for at in (band, band + 1)])


PAIRS, ENTRIES, EDGES = 0, 1, 2
SIGNATURE_SCHEMA = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("sigs", pa.binary()), ("ords", pa.binary()), ("nodes", pa.binary()), ("n", pa.binary()), ("s", pa.binary()), ("labels", pa.binary())])
SIGNATURE_DDL = "kind byte, bucket int, sigs binary, ords binary, nodes binary, n binary, s binary, labels binary"


class Nodes:
    """Sizes and labels of nodes, and their signatures' entries sorted by signature."""

    def __init__(self, node, n, s, label, sigs, own):
        self.node, self.n, self.s, self.label = node, n.astype(np.int64), s.astype(np.int64), label
        order = np.argsort(sigs)
        self.sigs, self.own = sigs[order], own[order]
        at = packed.runs(self.sigs)
        times = np.diff(np.append(at, len(self.sigs)))
        several = times > 1
        self.single = np.repeat(~several, times)  # entries that are alone with their signature
        self.at, self.times = at[several], times[several]

    def possible(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the nodes at x and y could link: they have at most the smaller shared part in common."""
        common = np.minimum(self.s[x], self.s[y])
        return 100 * common >= percent * (self.n[x] + self.n[y] - common)

    def least(self, key: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """Of each group the entry with the least key (of those at ``where``; else the first entry)."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        places = np.concatenate([np.arange(a, a + t) for a, t in zip(self.at.tolist(), self.times.tolist())])
        group = np.repeat(np.arange(len(self.at)), self.times)
        rank = key[self.own[places]]
        order = np.lexsort((rank, ~where[places], group) if where is not None else (rank, group))
        return places[order][np.cumsum(self.times) - self.times]


def _distinct(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.unique(x * count + y)
    return k // count, k % count


def stars(g: Nodes, percent: int, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (pivot, other) of each group, and the entries that stand for it elsewhere.

    The pivot is the group's smallest node; or with ``second``, where the group holds several
    labels, the smallest of those that are not of the least label.
    """
    count = max(1, len(g.node))
    rank = np.argsort(np.argsort(g.node, kind="stable"), kind="stable")
    if not second:
        heads = g.least(rank)
        pivot = g.own[np.repeat(heads, g.times)]
        reps = heads
    else:
        by_label = np.argsort(np.lexsort((g.node, g.label)), kind="stable")
        first = g.least(by_label)
        low = np.zeros(len(g.sigs), np.int64)
        places = _members(g)
        low[places] = np.repeat(g.label[g.own[first]], g.times)
        other = g.label[g.own] != low
        heads = g.least(by_label, other)
        mixed = other[heads] if len(heads) else np.zeros(0, bool)
        reps = np.concatenate((first, heads[mixed]))
        pivot = np.repeat(np.where(mixed, g.own[heads], -1), g.times) if len(heads) else np.zeros(0, np.int64)
    other = g.own[_members(g)]
    good = (pivot >= 0) & (g.node[pivot] != g.node[other])
    if second:
        good &= g.label[pivot] != g.label[other]
    x, y = _distinct(pivot[good], other[good], count)
    good = g.possible(x, y, percent)
    return x[good], y[good], np.concatenate((np.flatnonzero(g.single), reps))


def _members(g: Nodes) -> np.ndarray:
    """The places of all groups' entries, group by group."""
    ends = np.cumsum(g.times)
    return np.repeat(g.at - ends + g.times, g.times) + np.arange(int(ends[-1]) if len(ends) else 0)


def _mixed(g: Nodes) -> np.ndarray:
    """Which groups hold several labels."""
    if not len(g.at):
        return np.zeros(0, bool)
    label, starts = g.label[g.own[_members(g)]], np.cumsum(g.times) - g.times
    return np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)


def _edges(g: Nodes, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the nodes of each of the groups: from a component's first node to its others."""
    x = g.own[np.repeat(g.at[which], g.times[which])]
    y = g.own[_members(g)[np.repeat(which, g.times)]]
    x, y = _distinct(np.minimum(x, y), np.maximum(x, y), max(1, len(g.node)))
    first = np.arange(len(g.node))
    while True:
        low = np.minimum(first[x], first[y])
        after = first.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == first).all():
            break
        first = after
    joined = np.flatnonzero(first != np.arange(len(first)))
    return first[joined], joined


def open_pairs(g: Nodes, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different labels in small groups."""
    small = np.flatnonzero(_mixed(g) & (g.times <= least))
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in np.unique(g.times[small]).tolist():
        own = g.own[g.at[small[g.times[small] == t]][:, None] + np.arange(t)]
        i, j = np.triu_indices(t, 1)
        x, y = own[:, i].ravel(), own[:, j].ravel()
        good = (g.label[x] != g.label[y]) & (g.node[x] != g.node[y])
        x, y = _distinct(np.minimum(x[good], y[good]), np.maximum(x[good], y[good]), max(1, len(g.node)))
        xs.append(x)
        ys.append(y)
    x, y = _distinct(np.concatenate(xs), np.concatenate(ys), max(1, len(g.node)))
    good = g.possible(x, y, percent)
    return x[good], y[good]


def _spokesmen(g: Nodes, least: int) -> np.ndarray:
    """Entries that stand for their groups in the last round: all of small ones; of larger ones just over ``least``, of two labels where there are two."""
    small = np.repeat(g.times <= least, g.times)
    places = _members(g)
    rest = [np.zeros(0, np.int64)]
    for a, t in zip(g.at[g.times > least].tolist(), g.times[g.times > least].tolist()):
        label = g.label[g.own[a : a + t]]
        rest.append(a + np.unique(np.append(np.arange(least + 1), int(np.argmax(label != label[0])))))
    return np.concatenate((np.flatnonzero(g.single), places[small], *rest))


def _packed_pairs(kind: int, node: np.ndarray, x: np.ndarray, y: np.ndarray, buckets: int) -> list[dict]:
    if not len(x):
        return []
    to = int(words.mix(node[x[:1]].view(U64))[0] % U64(buckets))
    return [{"kind": kind, "bucket": to, "sigs": packed.planes(node[x]), "nodes": packed.planes(node[y])}]


def _signature_rows(limits: list[int], percent: int, buckets: int, step: int, least: int, few: int):
    """Packed signatures of nodes ``(node, n, shared, label)``, reduced in each chunk; ``step`` counts the rounds, 2 is the last.

    Nodes with a fifth column, ``prefix``, have signatures of these elements instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(2))).astype(np.int64))
            for a, b in words.chunks(np.append(0, ends), SIGNATURE_NODES, SIGNATURE_ELEMENTS):
                part = batch.slice(a, b - a)
                part = part.take(pa.compute.sort_indices(part.column(0)))  # so that edges start at the smallest node
                node, n, label = (np.asarray(part.column(i)) for i in (0, 1, 3))
                sets = [np.asarray(x.values) for x in part.column(2)]
                if part.num_columns > 4:
                    sigs = [words.mix(prefix_signatures(int(k), np.asarray(x.values), limits, percent)) for k, x in zip(n, part.column(4))]
                else:
                    sigs = [words.mix(signatures(int(k), x, limits, percent)) for k, x in zip(n, sets)]
                if step < 2:
                    sigs = [np.partition(x, few)[:few] if len(x) > few else x for x in sigs]
                own = np.repeat(np.arange(len(node)), list(map(len, sigs)))
                g = Nodes(node, n, np.array(list(map(len, sets))), label, np.concatenate(sigs), own)
                if step < 2:
                    x, y, send = stars(g, percent, step == 1)
                    out = _packed_pairs(PAIRS, node, x, y, buckets)
                else:
                    send = _spokesmen(g, least)
                    out = _packed_pairs(EDGES, node, *_edges(g, g.times > least), buckets)
                send = send[np.argsort(g.sigs[send], kind="stable")]
                keys, ords = g.sigs[send], g.own[send]
                which, bounds = packed.cut(keys, buckets)
                for w, i, j in zip(which.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    at, local = packed.compact(ords[i:j])
                    planes = {k: packed.planes(v[at]) for k, v in (("nodes", node), ("n", n), ("s", g.s.astype(np.int32)), ("labels", label))}
                    out.append({"kind": ENTRIES, "bucket": w, "sigs": packed.planes(keys[i:j]), "ords": packed.planes(local.astype(np.uint16)), **planes})
                yield pa.RecordBatch.from_pylist(out, SIGNATURE_SCHEMA)

    return run


def _candidates(percent: int, step: int, least: int):
    """All packed rows of a bucket -> (kind, a, b): pairs to verify, and edges of large groups in the last round; a task tells recent ones once."""
    told: dict[int, set] = {}

    def run(table: pa.Table) -> pa.Table:
        task = TaskContext.get().taskAttemptId()
        if task not in told:
            told.clear()
            told[task] = set()
        seen = told[task]
        kinds, xs, ys = [], [], []

        def put(kind: int, x: np.ndarray, y: np.ndarray) -> None:
            kinds.append(np.full(len(x), kind, np.int8))
            xs.append(x)
            ys.append(y)

        sigs, ords, parts, base = [np.zeros(0, U64)], [np.zeros(0, np.int64)], {k: [] for k in ("nodes", "n", "s", "labels")}, 0
        for r in table.to_pylist():
            if r["kind"] != ENTRIES:
                put(r["kind"], packed.unplanes(r["sigs"], np.int64), packed.unplanes(r["nodes"], np.int64))
                continue
            sigs.append(packed.unplanes(r["sigs"], U64))
            ords.append(packed.unplanes(r["ords"], np.uint16).astype(np.int64) + base)
            for k, dtype in (("nodes", np.int64), ("n", np.int32), ("s", np.int32), ("labels", np.int64)):
                parts[k].append(packed.unplanes(r[k], dtype))
            base += len(parts["nodes"][-1])
        node, n, s, label = (np.concatenate([np.zeros(0, np.int64), *parts[k]]) for k in ("nodes", "n", "s", "labels"))
        node, first, which = np.unique(node, return_index=True, return_inverse=True)  # a node comes from one chunk
        g = Nodes(node, n[first], s[first], label[first], np.concatenate(sigs), which[np.concatenate(ords)] if len(which) else np.zeros(0, np.int64))
        if step < 2:
            x, y, _ = stars(g, percent, step == 1)
            put(PAIRS, node[x], node[y])
        else:
            x, y = open_pairs(g, percent, least)
            put(PAIRS, node[x], node[y])
            x, y = _edges(g, _mixed(g) & (g.times > least))
            put(EDGES, node[x], node[y])
        if len(seen) > MOST_TOLD:
            seen.clear()
        new = [t for t in zip(np.concatenate(kinds).tolist(), np.concatenate(xs).tolist(), np.concatenate(ys).tolist()) if t not in seen and not seen.add(t)]
        return pa.table({k: pa.array([t[i] for t in new], kind) for i, (k, kind) in enumerate((("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())))})

    return run


def _verify_group(percent: int):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        node, n = np.asarray(sets["node"]), np.asarray(sets["n"]).astype(np.int64)
        lists = sets["shared"].combine_chunks()
        bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        at = dict(zip(node.tolist(), range(len(node))))
        linked = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            i, j = at[a], at[b]
            both = np.concatenate((flat[bounds[i] : bounds[i + 1]], flat[bounds[j] : bounds[j + 1]]))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= percent * int(n[i] + n[j] - common))
        keep_ = pa.array(linked, pa.bool_())
        return pa.table({"a": pairs["a"].combine_chunks().filter(keep_), "b": pairs["b"].combine_chunks().filter(keep_)})

    return run


def verified(pairs: DataFrame, nodes: DataFrame, percent: int, pair_bytes: float) -> DataFrame:
    """The distinct ``(a, b)`` that link.  Pairs meet by their second node, so a pivot's set goes once to each of their groups.

    Both sides of the join grow with the corpus, so it is a sort-merge join at every size.
    """
    groups = max(8, math.ceil(pairs.count() * pair_bytes / PAIR_BYTES))
    pairs = pairs.select(F.pmod(F.xxhash64("b"), F.lit(groups)).cast("int").alias("q"), "a", "b")
    need = pairs.select("q", F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = need.join(nodes.select("node", "n", "shared").hint("merge"), "node").select((F.col("q") + 0).alias("at"), "node", "n", "shared")
    return sets.groupBy("at").cogroup(pairs.groupBy("q")).applyInArrow(_verify_group(percent), "a long, b long")


def similar_sets(nodes: DataFrame, percent: int) -> DataFrame:
    """``(node, n, shared)`` -> ``(node, label)``: components of nodes that link with others."""
    spark = nodes.sparkSession
    most, total, count = nodes.agg(F.max("n"), F.sum(F.size("shared")), F.count("*")).first()
    if most is None:
        return spark.createDataFrame([], "node long, label long")
    limits = band_limits(percent, most)
    buckets = max(8, -(-8 * total // (1 << 20)))
    pair_bytes, labels = 16 * total / count, None
    for step in range(3):
        own = nodes.withColumn("label", F.col("node")) if labels is None else nodes.hint("merge").join(labels, "node", "left").select("node", "n", "shared", F.coalesce("label", "node").alias("label"))
        found = _found(own, limits, percent, buckets, step)
        own_links = [keep(verified(_of(found, PAIRS), nodes, percent, pair_bytes), "links")]
        if step == 2:
            own_links += _in_crowds(_of(found, EDGES), nodes, labels, limits, percent, pair_bytes)
        discard(found)
        if step == 2 and all(x.isEmpty() for x in own_links):
            discard(*own_links)
            return labels
        links = reduce(DataFrame.union, own_links)
        before = labels
        if before is not None:
            links = links.union(before.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(links)
        discard(*own_links, *[before] * (before is not None))
    return labels


def _found(own: DataFrame, limits: list[int], percent: int, buckets: int, step: int) -> DataFrame:
    """Pairs to verify of nodes that share a signature, and edges of large groups in the last round."""
    sent = own.mapInArrow(words.tidy(_signature_rows(limits, percent, buckets, step, SMALL_GROUP, STAR_SIGNATURES)), SIGNATURE_DDL)
    return keep(sent.groupBy("bucket").applyInArrow(_candidates(percent, step, SMALL_GROUP), "kind byte, a long, b long").distinct(), "candidates")


def _of(found: DataFrame, kind: int) -> DataFrame:
    return found.where(f"kind = {kind}").select("a", "b")


def rarest(nodes: DataFrame, percent: int) -> DataFrame:
    """``(node, n, shared)`` -> ``(node, prefix)``: of each node the first elements from rare to frequent, of which similar nodes share one.

    Elements that no other of the nodes has come first; they fill a prefix and are left out.
    With a column ``label``, only nodes of different labels are to meet, and elements that
    nodes of one label have come first.  Nodes are dealt into parts of about
    ``BUCKET_ENTRIES`` elements; a part sends an element once, with its count, and gets its
    total back, so an element that all nodes have costs an entry a part.
    """
    total = nodes.agg(F.sum(F.size("shared"))).first()[0] or 0
    parts = max(8, -(-total // BUCKET_ENTRIES))
    label = F.col("label" if "label" in nodes.columns else "node")
    own = nodes.select(F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), "node", "n", "shared", label.alias("label"))
    counts = own.groupBy("part").applyInArrow(_counts(parts), "part int, bucket int, items binary, often binary, low binary, high binary")
    totals = counts.groupBy("bucket").applyInArrow(_totals, "part int, items binary, often binary")
    return own.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(_prefixes(percent), "node long, prefix array<bigint>")


def _flat(sets: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a table of sets, and the row of each."""
    lists = sets["shared"].combine_chunks()
    return np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists)))


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(packed.unplanes(x, dtype) for x in column.to_pylist())])


def _counts(buckets: int):
    """Nodes of a part -> for each bucket of elements: how many of the nodes have them, and their least and greatest labels."""

    def run(sets: pa.Table) -> pa.Table:
        items, row = _flat(sets)
        order = np.argsort(items, kind="stable")
        items, label = items[order], np.asarray(sets["label"])[row[order]]
        at = packed.runs(items)
        columns = {"items": items[at], "often": np.diff(np.append(at, len(items))), "low": np.minimum.reduceat(label, at), "high": np.maximum.reduceat(label, at)}
        which, bounds = packed.cut(columns["items"].astype(U64) << U64(ORD_BITS), buckets)
        cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        cells = {k: pa.array([packed.planes(v[i:j]) for i, j in cuts], pa.binary()) for k, v in columns.items()}
        return pa.table({"part": pa.array([sets["part"][0].as_py()] * len(cuts), pa.int32()), "bucket": pa.array(which.astype(np.int32)), **cells})

    return run


def _totals(counts: pa.Table) -> pa.Table:
    """Counts of a bucket's elements -> for each part the totals of its elements that nodes of two labels have."""
    items, often, low, high = (_joined(counts[k], np.int64) for k in ("items", "often", "low", "high"))
    row = np.repeat(np.arange(len(counts)), [len(x) // 8 for x in counts["items"].to_pylist()])
    order = np.argsort(items, kind="stable")
    at = packed.runs(items[order])
    total, several = np.zeros(len(items), np.int64), np.zeros(len(items), bool)
    times = np.diff(np.append(at, len(items)))
    total[order] = np.repeat(np.add.reduceat(often[order], at), times)
    several[order] = np.repeat(np.minimum.reduceat(low[order], at) != np.maximum.reduceat(high[order], at), times)
    items, total, row = items[several], total[several], row[several]
    bounds = np.searchsorted(row, np.arange(len(counts) + 1))
    cells = lambda v: pa.array([packed.planes(v[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
    return pa.table({"part": counts["part"], "items": cells(items), "often": cells(total)})


def _prefixes(percent: int):
    def run(sets: pa.Table, totals: pa.Table) -> pa.Table:
        known, often = _joined(totals["items"], np.int64), _joined(totals["often"], np.int64)
        order = np.argsort(known)
        known, often = known[order], often[order]
        items, row = _flat(sets)
        good = packed.among(known, items)
        items, row = items[good], row[good]
        order = np.lexsort((items, often[np.searchsorted(known, items)], row))
        items, row = items[order], row[order]
        n, count = np.asarray(sets["n"]).astype(np.int64), np.bincount(row, minlength=len(sets))
        length = np.maximum(0, count - (n * percent + 99) // 100 + 1)  # all other elements come first
        items = items[np.arange(len(items)) - np.repeat(np.cumsum(count) - count, count) < length[row]]
        some = length > 0
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[some])).astype(np.int32)), pa.array(items))
        return pa.table({"node": pa.array(np.asarray(sets["node"])[some]), "prefix": lists})

    return run


def _in_crowds(edges: DataFrame, nodes: DataFrame, labels: DataFrame, limits: list[int], percent: int, pair_bytes: float) -> list[DataFrame]:
    """Links between components that share large groups of signatures; edges connect the nodes of each."""
    if edges.isEmpty():
        return []
    crowd = keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.hint("merge"), "node").join(labels.hint("merge"), "node", "left").select("node", "n", "shared", F.coalesce("label", "node").alias("label")), "crowds")
    prefixes = keep(rarest(crowd, percent), "prefixes")
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    own = crowd.join(prefixes.hint("merge"), "node").select("node", "n", "shared", "label", "prefix")
    found = _found(own, limits, percent, max(8, -(-16 * total // (1 << 20))), 2)
    links = [keep(verified(_of(found, PAIRS), nodes, percent, pair_bytes), "links")]
    if not _of(found, EDGES).isEmpty():
        links.append(keep(_in_blocks(_of(found, EDGES), nodes, labels, percent), "links"))
    discard(crowd, prefixes, found)
    return links


def _in_blocks(edges: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between components that share large groups.

    Nodes that large groups connect form clusters.  Those outside a cluster's largest
    component are dealt into blocks of about ``BLOCK`` of similar size, and so are the
    others; each of the former blocks is compared with all blocks of compatible sizes, by
    products of 0/1 matrices, in memory that does not depend on the number of nodes.
    """
    cluster = components(edges).withColumnRenamed("label", "cluster")
    own = cluster.join(labels, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label"))
    own = keep(own, "clusters")
    share = own.groupBy("cluster", "label").count()
    main = share.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    main = keep(main, "clusters")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) * 2).cast("int")
    placed = own.join(main, "cluster").select("node", "cluster", "label", (F.col("label") != F.col("main")).alias("apart"))
    placed = keep(placed.join(nodes.select("node", "n"), "node").withColumn("band", band), "clusters")
    sizes = keep(placed.groupBy("cluster", "apart", "band").count(), "clusters")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / BLOCK))
    dealt = placed.join(sizes, ["cluster", "apart", "band"]).select("node", "n", "label", "cluster", "apart", F.concat_ws(":", "cluster", "apart", "band", block).alias("block"))
    packs = keep(dealt.join(nodes.select("node", "shared"), "node").groupBy("block").applyInArrow(_pack_block, BLOCK_FIELDS), "blocks")
    discard(own, main, placed, sizes)
    size = packs.select("cluster", "apart", "block", "low_n", "high_n")
    left, right = size.where("apart").alias("x"), size.alias("y")
    tasks = left.join(right, "cluster").where("not y.apart or x.block <= y.block").where(f"{percent} * y.low_n <= 100 * x.high_n and {percent} * x.low_n <= 100 * y.high_n").select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    data = lambda k: packs.select(F.col("block").alias(k), F.col("data").alias(f"data_{k}"))
    return tasks.join(data("i"), "i").join(data("j"), "j").select("data_i", "data_j").mapInArrow(words.tidy(_compare_blocks(percent)), "a long, b long")


def _pack_block(table: pa.Table) -> pa.Table:
    part = table.select(["node", "n", "label", "shared"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_table(part)
    n = np.asarray(table["n"])
    fields = pa.schema([("cluster", pa.int64()), ("apart", pa.bool_()), ("block", pa.string()), ("low_n", pa.int32()), ("high_n", pa.int32()), ("data", pa.binary())])
    first = {k: table[k].slice(0, 1) for k in ("cluster", "apart", "block")}
    return pa.table({**first, "low_n": [int(n.min())], "high_n": [int(n.max())], "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())}).cast(fields)


def _compare_blocks(percent: int):
    def read(data: bytes):
        t = pa.ipc.open_stream(data).read_all().combine_chunks()
        lists = t["shared"].combine_chunks()
        row = np.repeat(np.arange(len(t)), np.diff(np.asarray(lists.offsets)))
        return np.asarray(t["node"]), np.asarray(t["n"]).astype(np.int64), np.asarray(t["label"]), np.asarray(lists.flatten()), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data_i, data_j in zip(batch.column(0), batch.column(1)):
                x, y = read(data_i.as_py()), read(data_j.as_py())
                both = np.intersect1d(x[3], y[3])
                common = np.zeros((len(x[0]), len(y[0])), np.float64)
                px, py = np.searchsorted(both, x[3]), np.searchsorted(both, y[3])
                in_x, in_y = packed.among(both, x[3]), packed.among(both, y[3])
                for a in range(0, len(both), SLICE):
                    tables = []
                    for part, inside, side in ((px, in_x, x), (py, in_y, y)):
                        mine = inside & (part >= a) & (part < a + SLICE)
                        m = np.zeros((len(side[0]), SLICE), np.float32)
                        m[side[4][mine], part[mine] - a] = 1
                        tables.append(m)
                    common += tables[0] @ tables[1].T
                union = x[1][:, None] + y[1][None, :] - common
                linked = (100 * common >= percent * union) & (x[2][:, None] != y[2][None, :])
                i, j = np.nonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[0][i], y[0][j])), pa.array(np.maximum(x[0][i], y[0][j]))], names=["a", "b"])

    return run


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.75) -> DataFrame:
    """Near-duplicate classes of whole texts: ``(doc_id, n_shingles, component_id)``, a row for each row of ``docs``.

    Words are lower-cased (A-Z) runs of other characters than space and U+0009..U+000D; a
    set holds the distinct runs of ``n`` words, or the whole sequence where it is shorter.
    Sets link when ``100 * common >= 100 * threshold * union``; ``component_id`` is the
    smallest id reachable by links.  Texts that are null or without words have size 0 and
    are alone.  A null id stays null, is alone in its row's result and passes no id on; rows
    that repeat an id are separate documents of that id.  An empty table gives none.
    Other columns are ignored, whatever their names.
    """
    percent = round(threshold * 100)
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(rows)
    node_fields = "node long, n int, shared array<bigint>"
    entries = rows.mapInArrow(words.tidy(_shingle_rows(n, buckets)), packed.DDL)
    hits = keep(packed.by_bucket(entries, _shared(buckets)), "shared-shingles")
    member = hits.where(f"kind = {packed.MEMBER}").select("keys", "extra", "sizes")
    members = keep(member.mapInArrow(_member_rows, "doc_id long, n_shingles long, node long"), "members")

    def shared_parts(known: DataFrame, total: int) -> DataFrame:
        dealt = known.mapInArrow(words.tidy(_dealt(max(8, -(-total // BUCKET_ENTRIES)))), packed.DDL)
        return keep(packed.by_bucket(dealt, _nodes(percent), node_fields), "shared-nodes")

    known = hits.where(f"kind = {packed.DONE}")
    nodes = shared_parts(known, (known.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8)
    discard(hits)
    for _ in range(NARROWINGS):  # shingles whose other owners are gone aren't shared any more
        total = nodes.agg(F.sum(F.size("shared"))).first()[0] or 0
        buckets = max(8, -(-total // BUCKET_ENTRIES))
        entries = nodes.mapInArrow(words.tidy(_node_rows(buckets)), packed.DDL)
        fewer = shared_parts(packed.by_bucket(entries, _shared(buckets)), total)
        discard(nodes)
        nodes = fewer
    labels = similar_sets(nodes, percent)
    discard(nodes)
    # of each node the smallest id, of each label the smallest of its nodes'; many rows may share a node, many nodes a label
    own = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = own.join(labels, "node").select("node", "label", "least")
    least = keep(linked.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    classes = keep(labels.join(least, "label").select("node", "component_id"), "classes")
    own = keep(own.join(classes, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "classes")
    discard(least, classes)
    out = members.join(own, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, sizes = packed.id_array(packed.unplanes(r["extra"], np.int64)), packed.unplanes(r["sizes"], np.int32)
            nodes = packed.unplanes(r["keys"], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(nodes)], names=["doc_id", "n_shingles", "node"])
