"""How a source's terms diverge from its language's and from the other sources'.

Method (mergeable radix tries).  Each task counts the terms of its documents in a byte trie
whose leaves have counters by (lang, source); the root counts the documents.  Tries are flat
arrays in preorder, so they are built, sent and merged without a loop over terms.  A trie
leaves its task in UTF-8 order, cut into the subtries below each short prefix.  Spark deals
these by ranges of the prefix and sorts them, and a task adds up subtries of a few prefixes
after the other, so it never holds a whole range.  Reading them in order streams the kept
terms as blocks of rows: sums of p differences for each pair of sources, and each source's best
candidates, are then made block by block.  A task adds up its blocks before it returns them, so
its rows depend on the sources only; Spark adds, or ranks, those of all tasks.

All numbers are exact: products that don't fit 64 bits are made with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import words
from .bpe import gather
from .storage import bucket_count, discard, keep

SCALE, MORE = 1_000_000_000, 5
MOST_LEAVES = 300_000  # of the batches of a task's trie, repeated ones counted each time; a larger one is sent and a new one begun
CARRY_BYTES = 8 << 20  # of rows of one prefix that wait for more of it
BLOCK_CELLS = 1 << 18  # terms x sources of a block
RANGE_BYTES = 16 << 20  # of input for each range of prefixes
_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
SUBTRIE = pa.schema([("prefix", pa.binary()), ("shared", pa.list_(pa.int32())), ("labels", pa.list_(pa.binary())), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
SUBTRIE_DDL = "prefix binary, shared array<int>, labels array<binary>, langs array<string>, sources array<string>, sizes array<int>, groups array<int>, counts array<long>, docs array<long>"
BLOCK = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
BLOCK_DDL = "lang string, terms array<string>, sources array<string>, totals array<long>, sizes array<int>, groups array<int>, counts array<long>"


def shared_bytes(paths: pa.Array) -> np.ndarray:
    """How many bytes each of the sorted paths shares with the one before."""
    at, raw = _bytes(paths)
    out = np.zeros(len(paths), np.int64)
    sizes = np.diff(at)
    todo = np.arange(1, len(paths))
    while len(todo):
        k = out[todo]
        todo = todo[(k < sizes[todo - 1]) & (k < sizes[todo])]
        k = out[todo]
        todo = todo[raw[at[todo - 1] + k] == raw[at[todo] + k]]
        out[todo] += 1
    return out


def paths_of(shared: np.ndarray, labels: pa.Array) -> pa.Array:
    """The paths of all leaves, each from its label and the path of the leaf before."""
    at, raw = _bytes(labels)
    sizes = shared + np.diff(at)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    rows, depth = np.flatnonzero(sizes > 0), 0
    while len(rows):  # a byte of all paths at once; it stands in the last label that reaches so far up
        own = np.maximum.accumulate(np.where(shared[rows] <= depth, np.arange(len(rows)), 0))
        source = rows[own]
        out[ends[rows] - sizes[rows] + depth] = raw[at[source] + depth - shared[source]]
        depth += 1
        rows = rows[sizes[rows] > depth]
    return _binary(np.concatenate(([0], ends)), out)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n+1 bounds and the bytes of a large string or binary array."""
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _binary(at: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


class Trie:
    """A radix trie over bytes, flat: leaves in byte order, and counters by (leaf, group).

    Leaf k keeps ``shared[k]`` bytes of the path of the leaf before it and adds its label, so the
    arrays list the trie's edges in preorder.
    """

    def __init__(self, terms: pa.Array, leaves: np.ndarray, groups: np.ndarray, counts: np.ndarray, docs: np.ndarray):
        """Of terms in any order; equal ones, as those of several tries, become one leaf and their counters are added."""
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.paths = coded.dictionary.take(order)
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        base = int(groups.max()) + 1 if len(groups) else 1
        keys = (place[np.asarray(coded.indices)] if len(order) else place)[leaves] * base + groups
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else by
        self.leaves, self.groups = keys[new] // base, keys[new] % base
        self.counts, self.docs = (np.add.reduceat(x[by], new) if len(new) else x for x in (counts, docs))


def term_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat terms of a large string array without nulls, A-Z lower-cased, and the n+1 bounds of each text's."""
    at, raw = _bytes(texts)
    inside = _letter[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = at[:-1][np.diff(at) > 0]
    opens[borders] = inside[borders]
    starts = np.flatnonzero(opens)
    kept = _low[raw[inside]]
    before = np.concatenate(([0], np.cumsum(inside)))
    return _binary(np.append(before[starts], len(kept)), kept), np.searchsorted(starts, at)


def _lists(bounds: np.ndarray, flat) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)


def subtries(trie: Trie, names: list[tuple[str, str]], prefix_bytes: int) -> Iterator[pa.RecordBatch]:
    """The trie cut below each short prefix, a row for each; the first leaf of a row has its whole path."""
    paths, leaf, group = trie.paths, trie.leaves, trie.groups
    heads = pc.binary_slice(paths, 0, prefix_bytes)
    new = np.concatenate(([True], np.asarray(pc.not_equal(heads.slice(1), heads.slice(0, max(0, len(heads) - 1))))))[: len(paths)]
    shared = np.where(new, 0, shared_bytes(paths))
    bounds, raw = _bytes(paths)
    sizes = np.diff(bounds) - shared
    labels = _binary(np.concatenate(([0], np.cumsum(sizes))), raw[gather(bounds[:-1] + shared, sizes)]).cast(pa.binary())
    starts = np.append(np.flatnonzero(new), len(paths))
    langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
    for a in range(0, len(starts) - 1, 2000):  # so many rows a batch
        at = starts[a : a + 2001]
        cells = np.searchsorted(leaf, at)
        low, high, base = cells[0], cells[-1], len(names)
        row = np.searchsorted(at, leaf[low:high], side="right") - 1
        keys, local = np.unique(row * base + group[low:high], return_inverse=True)
        firsts, own = np.searchsorted(keys, np.arange(len(at)) * base), pa.array(keys % base)
        per = np.bincount(leaf[low:high] - at[0], minlength=at[-1] - at[0])
        lists = [(at - at[0], pa.array(shared[at[0] : at[-1]], pa.int32())), (at - at[0], labels.slice(at[0], at[-1] - at[0])), (firsts, langs.take(own)), (firsts, sources.take(own)), (at - at[0], pa.array(per, pa.int32()))]
        lists += [(cells - low, pa.array(local - firsts[row], pa.int32())), (cells - low, pa.array(trie.counts[low:high])), (cells - low, pa.array(trie.docs[low:high]))]
        yield pa.RecordBatch.from_arrays([heads.take(pa.array(at[:-1])).cast(pa.binary()), *(_lists(*x) for x in lists)], schema=SUBTRIE)


def joined(rows: pa.Table) -> tuple[Trie, list[tuple[str, str]]]:
    """Subtries of any tasks, added up, and the names of the groups."""
    cols = {n: rows[n].combine_chunks() for n in rows.column_names}
    flat = {n: c.flatten() for n, c in cols.items() if n != "prefix"}
    size = lambda n: np.asarray(pc.list_value_length(cols[n])).astype(np.int64)
    paths = paths_of(np.asarray(flat["shared"]).astype(np.int64), flat["labels"].cast(pa.large_binary()))
    langs, sources = flat["langs"].dictionary_encode(), flat["sources"].dictionary_encode()
    many = max(1, len(sources.dictionary))
    pairs, code = np.unique(np.asarray(langs.indices).astype(np.int64) * many + np.asarray(sources.indices), return_inverse=True)
    names = [*zip(langs.dictionary.take(pa.array(pairs // many)).to_pylist(), sources.dictionary.take(pa.array(pairs % many)).to_pylist())]
    firsts = np.cumsum(size("langs")) - size("langs")
    group = code[np.asarray(flat["groups"]) + np.repeat(firsts, size("groups"))]
    return Trie(paths, np.repeat(np.arange(len(paths)), np.asarray(flat["sizes"])), group, np.asarray(flat["counts"]), np.asarray(flat["docs"])), names


def _count(prefix_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        held, leaves = [], 0  # what the batches so far would add to the trie

        def trie() -> Trie:
            first = np.cumsum([0, *(len(t) for t, *_ in held[:-1])])
            return Trie(pa.concat_arrays([t for t, *_ in held]), np.concatenate([x[1] + n for x, n in zip(held, first)]), *(np.concatenate([x[k] for x in held]) for k in (2, 3, 4)))

        for batch in words.text_batches(batches, 8 << 20):
            if not batch.num_rows:
                continue
            group = np.fromiter((codes.setdefault(x, len(codes)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), np.int64, batch.num_rows)
            many = np.bincount(group)
            seen = np.flatnonzero(many)
            held.append((pa.array([b""], pa.large_binary()), np.zeros(len(seen), np.int64), seen, many[seen], many[seen]))  # the root
            flat, bounds = term_array(batch.column(2).cast(pa.large_string()))
            coded = flat.dictionary_encode()
            size = len(coded.dictionary)
            if size:
                keys, times = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(bounds)) * size + np.asarray(coded.indices), return_counts=True)
                cells, where = np.unique(group[keys // size] * size + keys % size, return_inverse=True)  # a document has one group
                held.append((coded.dictionary, cells % size, cells // size, np.bincount(where, weights=times).astype(np.int64), np.bincount(where)))
                leaves += size
            if leaves > MOST_LEAVES:
                yield from subtries(trie(), [*codes], prefix_bytes)
                codes, held, leaves = {}, [], 0
        if held:
            yield from subtries(trie(), [*codes], prefix_bytes)

    return words.tidy(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Trie, list[tuple[str, str]]]]:
    """Tries of the sorted rows, some prefixes at a time; a prefix is in one of them only."""
    carry = SUBTRIE.empty_table()  # rows of the last prefix
    for batch in words.text_batches(batches):
        if not batch.num_rows:
            continue
        rows = pa.concat_tables([carry, pa.Table.from_batches([batch], SUBTRIE)])
        last = np.asarray(pc.equal(rows["prefix"], rows["prefix"][-1]))
        at = int(np.argmax(last))
        if at:
            yield joined(rows.slice(0, at))
        carry = rows.slice(at)
        if len(carry) > 1 and carry.nbytes > CARRY_BYTES:
            trie, names = joined(carry)
            carry = pa.Table.from_batches(subtries(trie, names, len(carry["prefix"][0].as_py())), SUBTRIE)
    if len(carry):
        yield joined(carry)


class _Block:
    """Kept terms of one lang, until there are enough for a row."""

    def __init__(self, lang: str):
        self.lang, self.terms, self.sizes, self.codes, self.groups, self.counts, self.cells = lang, [], [], {}, [], [], 0

    def add(self, term: str, sources: list[str], counts: np.ndarray) -> None:
        self.terms.append(term)
        self.sizes.append(len(sources))
        self.groups += [self.codes.setdefault(s, len(self.codes)) for s in sources]
        self.counts.append(counts)

    def full(self) -> bool:
        return len(self.terms) * len(self.codes) >= BLOCK_CELLS

    def row(self) -> pa.RecordBatch:
        groups, counts = np.array(self.groups, np.int64), np.concatenate(self.counts)
        totals = np.zeros(len(self.codes), np.int64)
        np.add.at(totals, groups, counts)
        return _rows(self.lang, self.terms, [*self.codes], totals.tolist(), self.sizes, groups.tolist(), counts.tolist())


def _rows(lang: str, terms=(), sources=(), totals=None, sizes=(), groups=(), counts=()) -> pa.RecordBatch:
    cells = [lang, terms, sources, [0] * len(sources) if totals is None else totals, sizes, groups, counts]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, BLOCK)], schema=BLOCK)


def _blocks(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of kept terms; the root's row has no terms, but all sources of its lang."""
        open_: dict[str, _Block] = {}
        for trie, names in _merged(batches):
            langs: dict[str, int] = {}
            lang_of = np.array([langs.setdefault(x, len(langs)) for x, _ in names])
            names_of, by = [s for _, s in names], [*langs]
            if len(trie.paths[0].as_py()) == 0:
                root = trie.groups[trie.leaves == 0]
                for k, name in enumerate(by):
                    yield _rows(name, sources=[names_of[g] for g in root[lang_of[root] == k].tolist()])
            order = np.lexsort((trie.groups, lang_of[trie.groups], trie.leaves))
            order = order[np.asarray(pc.binary_length(trie.paths))[trie.leaves[order]] > 0]
            if not len(order):
                continue
            leaf, group, counts = trie.leaves[order], trie.groups[order], trie.counts[order]
            lang = lang_of[group]
            starts = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (lang[1:] != lang[:-1]))))
            ends = np.append(starts[1:], len(leaf))
            often = np.flatnonzero(np.add.reduceat(trie.docs[order], starts) >= least_docs)
            terms = trie.paths.take(pa.array(leaf[starts[often]])).cast(pa.large_string()).to_pylist()
            for term, i, j in zip(terms, starts[often].tolist(), ends[often].tolist()):
                name = by[lang[i]]
                block = open_.setdefault(name, _Block(name))
                block.add(term, [names_of[g] for g in group[i:j].tolist()], counts[i:j])
                if block.full():
                    yield open_.pop(name).row()
        for block in open_.values():
            yield block.row()

    return words.tidy(run)


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + MORE) / (total + MORE * kept)), exactly."""
    below = total + MORE * kept
    if below < 1 << 32:  # no count is larger than the total
        return 1 + SCALE * (counts + MORE) // below
    return np.array([1 + SCALE * (c + MORE) // below for c in counts.tolist()], np.int64)


class _Best:
    """A source's terms of largest value, equal ones by their bytes, of any number of blocks."""

    def __init__(self, most: int):
        self.most, self.terms, self.values = most, [], []

    def add(self, terms: pa.Array, values: np.ndarray) -> None:
        self.terms += terms.to_pylist()
        self.values += values.tolist()
        if len(self.terms) > 4 * self.most:
            self.cut()

    def cut(self) -> None:
        order = sorted(range(len(self.terms)), key=lambda k: (-self.values[k], self.terms[k].encode()))[: self.most]
        self.terms, self.values = [self.terms[k] for k in order], [self.values[k] for k in order]


def _compared(most_ranks: int):
    def pairs(lang: str, sources: list[str], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, source in enumerate(sources):
            others = [x for x in range(len(sources)) if x != k]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(others), pa.string()) for x in (lang, source, "pair")] + [pa.array([sources[x] for x in others], pa.string()), pa.array(sums[k, others])], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the task's differences for each pair of a lang's sources, and each source's best terms."""
        added: dict[str, tuple[list[str], np.ndarray]] = {}
        ranked: dict[tuple[str, str], _Best] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, own in added.items():
                yield from pairs(name, *own)
            for (lang, source), own in ranked.items():
                own.cut()
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(own.terms), pa.string()) for x in (lang, source, "term")] + [pa.array(own.terms, pa.string()), pa.array(own.values, pa.int64())], schema=OUT)

        for batch in batches:
            for lang, terms, names, sizes, groups, counts, sources, totals, kept in zip(*(batch.column(k) for k in range(9))):
                lang, sources, totals, kept = lang.as_py(), sources.as_py(), totals.as_py(), kept.as_py()
                width, n, terms = len(sources), len(terms.values), terms.values
                place = {s: k for k, s in enumerate(sources)}
                row = np.array([place[s] for s in names.as_py()], np.int64)[np.asarray(groups.values)]
                column, counts = np.repeat(np.arange(n), np.asarray(sizes.values)), np.asarray(counts.values)
                sums = added.setdefault(lang, (sources, np.zeros((width, width), np.int64)))[1]
                step = max(1, 4 * BLOCK_CELLS // width)
                for at in range(0, n, step):  # so many terms at once
                    size, (i, j) = min(step, n - at), np.searchsorted(column, (at, at + step))
                    dense = np.zeros((width, size), np.int64)
                    dense[row[i:j], column[i:j] - at] = counts[i:j]
                    p = np.array([shares(dense[k], totals[k], kept) for k in range(width)])
                    q = shares(dense.sum(axis=0), sum(totals), kept)
                    for k, source in enumerate(sources):
                        sums[k] += np.abs(p - p[k]).sum(axis=1)
                        gap = np.where(dense[k] > 0, p[k] - q, 0)
                        best = np.flatnonzero(gap > 0)
                        best = best[np.argsort(-gap[best], kind="stable")][:most_ranks]  # the terms are in order
                        if len(best):
                            ranked.setdefault((lang, source), _Best(most_ranks)).add(terms.take(pa.array(best + at)), gap[best])
                if sum(x.size for _, x in added.values()) > 16 * BLOCK_CELLS:
                    yield from sent()
                    added.clear()
                    ranked.clear()
        yield from sent()

    return words.tidy(run)


OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, most_ranks: int = 50) -> DataFrame:
    """Divergence of each (lang, source) from the lang's other sources and, by term, from the lang.

    Returns ``lang, source, part, item, value, rank``.  A lang keeps the terms in at least
    ``least_docs`` of its documents.  Part ``pair``: each other source of the lang with the sum
    of the differences of all kept terms' shares, 0 without kept terms.  Part ``term``: the
    terms whose share in the group is above the lang's by most, up to ``most_ranks``.  Larger
    values come first, equal ones by the item's UTF-8 bytes.

    Null texts, langs and sources are empty strings, which are a lang and a source of their
    own.  Groups without terms take part.  Repeated rows count each time.  Texts and terms of
    any length are taken whole; a term is one leaf.  Other columns are ignored.  An empty table
    gives no rows.  The result has a row for each ordered pair of a lang's sources.
    """
    spark = docs.sparkSession
    ship_package(spark)
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    buckets = bucket_count(docs, RANGE_BYTES)
    prefix_bytes = 5 + sum(buckets > 1 << k for k in (8, 12, 16, 20))  # larger inputs are cut finer
    tries = docs.select(whole(lang_col).alias("lang"), whole(source_col).alias("source"), whole(text_col).alias("text")).mapInArrow(_count(prefix_bytes), SUBTRIE_DDL)
    tries = keep(tries, "subtries")  # the ranges' samples then read the prefixes only
    blocks = keep(tries.repartitionByRange(buckets, "prefix").sortWithinPartitions("prefix").mapInArrow(_blocks(least_docs), BLOCK_DDL), "term-blocks")
    discard(tries)
    sums = blocks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    langs = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("own")).join(kept, "lang")
    salts = buckets // 4  # so that the blocks of one lang meet its row in several tasks, each with some ranges' blocks
    spread = langs.select("lang", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "own", "kept")
    salted = blocks.withColumnRenamed("sources", "names").withColumn("salt", F.pmod(F.hash(F.get("terms", F.lit(0))), F.lit(salts)))
    pairs = salted.join(spread, ["lang", "salt"]).select("lang", "terms", "names", "sizes", "groups", "counts", F.col("own.source").alias("sources"), F.col("own.total").alias("totals"), "kept")
    found = pairs.mapInArrow(_compared(most_ranks), "lang string, source string, part string, item string, value long")
    found = keep(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence")
    discard(blocks)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    ranked = lambda part: found.where(F.col("part") == part).select("lang", "source", "part", "item", "value", rank)
    return ranked("pair").union(ranked("term").where(F.col("rank") <= most_ranks))
