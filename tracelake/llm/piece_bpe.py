"""SentencePiece BPE encoding and decoding, exactly as the library does.

Method (merge-type prefix table).  In these models any two neighbours whose joint text is a
piece may merge, the best score first, leftmost among equals.  Every prefix of a text then has
one last token: of the pieces that end where the prefix ends, the one that is compatible with
the last token of the prefix before it, that is, encoding the two pieces' joint text gives the
pair back.  An automaton finds all pieces that end at each character, the table of last tokens
is filled from left to right for all distinct units of a batch at once, and the ids are read
from the table backwards.

A unit is a run of spaces with the characters up to the next space, or a line feed: no piece
goes on over such a border, so a unit's ids don't depend on its neighbours.  A task keeps the
units that it met first, in a table of bounded bytes.  Characters outside the vocabulary become
the ids of their bytes.  A unit of any length is taken in sections, so memory grows by a few
bytes a character.  Where the pieces of several spaces have one score below all others, they
are left out of the table: such merges come last, from left to right, so what is left of a
run of spaces is dealt out in the longest pieces.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import words
from .bpe import NONE, PairTable, gather

MARK = "▁"  # stands for a space within pieces
KNOWN_BYTES = 40 << 20  # up to which a task keeps units from batch to batch
BATCH_BYTES = 8 << 20  # of text that is encoded at once
CHUNK_CHARS = 256 << 10  # of distinct units whose table is filled at once
LONG = 64  # characters from which a unit's table is filled in sections
SECTION = 16 << 10
UNKNOWN, FREE = -2, -1  # in the table: a character of no piece; nothing before
SEPARATOR = "￿"
BORDER = re.compile(r"(?<=[^ ]) |\n")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Tables of one model file: BPE with byte fallback, text not normalised, a space put before it."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, self.size = self.library, self.library.get_piece_size()
        every = range(self.size)
        control = [i for i in every if sp.is_control(i) or sp.is_unknown(i)]
        self.bytes = np.array([i for i in every if sp.is_byte(i)], np.int64)
        apart = {*control, *self.bytes.tolist()}
        ids = {sp.id_to_piece(i): i for i in every if i not in apart}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        if len(self.bytes) != 256 or any(map(sp.is_unused, every)) or self.bos < 0 or self.eos < 0:
            raise ValueError("not a model with byte fallback, begin and end ids")
        if sp.normalize(" ﬁ  Á \n ") != f"{MARK * 2}ﬁ{MARK * 2}Á{MARK}\n{MARK}":
            raise ValueError("the model normalises texts")
        if any(MARK in p.lstrip(MARK) or "\n" in p or SEPARATOR in p for p in ids):
            raise ValueError("pieces go on over white space")
        ids = self._without_runs(ids)
        self._merges(ids)
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[list(ids.values())] = list(map(len, ids))
        self.longest = int(self.lengths.max())
        self.is_char = np.zeros(0x110000, bool)
        self.is_char[[ord(p) for p in ids if len(p) == 1]] = True
        self.automaton = ahocorasick.Automaton()
        for p, i in ids.items():
            if all(self.is_char[ord(c)] for c in p):
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        spelled = [b""] * self.size
        for p, i in ids.items():
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            spelled[i] = bytes([b])
        for n, i in self.run_pieces.items():
            spelled[i] = b" " * n
        self.spelled = pa.array(spelled, pa.large_binary())
        self.visible = np.ones(self.size, bool)
        self.visible[control] = False
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[*(i for p, i in ids.items() if p[0] == MARK), *self.run_pieces.values()]] = True
        self.cached, self.verdicts = np.full(1 << 20, -1), np.zeros(1 << 20, bool)
        self.forget()

    def _without_runs(self, ids: dict[str, int]) -> dict[str, int]:
        """The pieces but for those of several spaces, if these share one score below all others.

        ``runs`` then has, for each size up to the longest of them, what a run of spaces becomes:
        an id at each place where a piece begins, -1 elsewhere.
        """
        own = {len(p): i for p, i in ids.items() if len(p) > 1 and not p.strip(MARK)}
        rest = {p: i for p, i in ids.items() if len(p) == 1 or p.strip(MARK)}
        scores = {self.library.get_score(i) for i in own.values()}
        self.runs, self.run_pieces = np.zeros((0, 0), np.int64), {}
        if len(scores) != 1 or MARK not in ids or min(self.library.get_score(i) for p, i in rest.items() if len(p) > 1) <= min(scores):
            return ids
        most, own[1] = max(own), ids[MARK]

        def dealt(n: int) -> list[int]:
            sizes = [1] * n
            while joint := [k for k in range(len(sizes) - 1) if sizes[k] + sizes[k + 1] in own]:
                sizes[joint[0] : joint[0] + 2] = [sizes[joint[0]] + sizes[joint[0] + 1]]
            return sizes

        if any(dealt(n) != [most, *dealt(n - most)] for n in range(most, 3 * most)):
            raise ValueError("runs of spaces don't repeat")
        self.runs = np.full((most + 1, most), -1)
        for n in range(1, most + 1):
            sizes = dealt(n)
            self.runs[n, np.cumsum(sizes) - sizes] = [own[k] for k in sizes]
        self.run_pieces = own
        return rest

    def _merges(self, ids: dict[str, int]) -> None:
        """Merge orders of all pairs, and the two parts of which each piece is made."""
        scores = np.array([-self.library.get_score(i) if len(p) > 1 else -np.inf for p, i in ids.items()])
        _, dense = np.unique(scores, return_inverse=True)
        order = dict(zip(ids, dense.tolist()))  # 0 for characters
        self.order = np.zeros(self.size, np.int64)
        self.order[list(ids.values())] = list(order.values())
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        for p, i in ids.items():
            parts = list(p)
            while len(parts) > 2:
                found = [(order[z], k) for k in range(len(parts) - 1) if (z := parts[k] + parts[k + 1]) in order]
                if not found:
                    break
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(p) > 1:
                if len(parts) != 2 or not all(x in ids and order[x] < order[p] for x in parts):
                    raise ValueError(f"merging never yields the piece {p!r}, or not in the order of scores")
                self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
        split = [(ids[p[:k]] * self.size + ids[p[k:]], order[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*split)))

    def forget(self) -> None:
        """Empty the table of known units."""
        self.known: dict[str, int] = {}
        self.known_bytes = 0
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tested(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether encoding the joint text of pieces x and y gives x, y; for all pairs at once.

        From the whole pieces down, the one that is made last is taken apart along the border.
        If two parts that touch the border could merge before the taken-apart piece is made,
        merging crosses the border.
        """
        good, limit, todo = np.ones(len(x), bool), np.full(len(x), NONE), np.arange(len(x))
        x, y = x.copy(), y.copy()
        while len(todo):
            a, b = x[todo], y[todo]
            crossed = self.pairs.find(a * self.size + b)[0] < limit[todo]
            good[todo[crossed]] = False
            oa, ob = self.order[a], self.order[b]
            on = ~crossed & ((oa > 0) | (ob > 0))
            todo, a, b, oa, ob = todo[on], a[on], b[on], oa[on], ob[on]
            first = oa > ob  # of equals the right one is made later
            limit[todo] = np.where(first, oa, ob + 1)  # a pair of the same order wins on the left
            x[todo] = np.where(first, self.right[a], a)
            y[todo] = np.where(first, b, self.left[b])
        return good

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``tested``, with recent pairs' verdicts kept."""
        keys = x * self.size + y
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.verdicts[slots]
        missing = np.flatnonzero(self.cached[slots] != keys)
        if len(missing):
            new, at, where = np.unique(keys[missing], return_index=True, return_inverse=True)
            good = self.tested(new // self.size, new % self.size)
            slots = slots[missing[at]]
            self.cached[slots], self.verdicts[slots] = new, good
            out[missing] = good[where]
        return out

    def _matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends and ids of all pieces in the text, by end."""
        got = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]

    def _fill_long(self, last: np.ndarray, text: str, a: int, b: int) -> None:
        """The table for the characters a..b, a run without unknown ones, section by section."""
        for at in range(a, b, SECTION):
            low, high = max(a, at - self.longest), min(b, at + SECTION)
            ends, ids = self._matches(text[low:high])
            ends, ids = ends[ends >= at - low] + low, ids[ends >= at - low]
            before = ends - self.lengths[ids]
            inner, outer = before >= at, (before < at) & (before >= a)
            first = np.searchsorted(ends, np.arange(at, high + 1))
            counts = np.where(inner, np.diff(first)[np.where(inner, before - at, 0)], outer.astype(np.int64))
            base = np.cumsum(counts) - counts
            y, x = np.repeat(ids, counts), np.repeat(np.where(outer, last[before], 0), counts)
            inside = np.repeat(inner, counts)
            start = np.where(inner, first[np.where(inner, before - at, 0)], 0)
            x[inside] = ids[gather(start[inner], counts[inner])]
            good = self.compatible(x, y).tolist()
            chosen, found = [0] * (high - at), [0] * (high - at)
            for m, (e, p, k) in enumerate(zip((ends - at).tolist(), (before - at).tolist(), base.tolist())):
                if p < a - at or good[k + chosen[p] if p >= 0 else k]:
                    chosen[e], found[e] = m - int(first[e]), m
            last[at:high] = ids[found]

    def _fill(self, text: str, points: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """For each character the last token of its unit's prefix up to there."""
        n = len(points)
        known = self.is_char[points]
        fresh = opens | ~known
        fresh[1:] |= ~known[:-1]
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        last = np.full(n + 1, UNKNOWN)
        last[n] = FREE
        long = np.flatnonzero(place - start == LONG)
        if len(long):
            after = np.append(np.flatnonzero(fresh), n)
            for a in start[long].tolist():
                self._fill_long(last, text, a, int(after[np.searchsorted(after, a, side="right")]))
        ends, ids = self._matches(text)
        level = ends - start[ends]
        short = np.ones(n, bool)
        for a in start[long].tolist():
            short[a : int(after[np.searchsorted(after, a, side="right")])] = False
        ends, ids, level = ends[short[ends]], ids[short[ends]], level[short[ends]]
        before = ends - self.lengths[ids]
        before = np.where(before < start[ends], n, before)
        by = np.argsort(level.astype(np.int16), kind="stable")
        ends, ids, before = ends[by], ids[by], before[by]
        bounds = np.searchsorted(level[by], np.arange(LONG + 2))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if i == j:
                continue
            y, e, x = ids[i:j], ends[i:j], last[before[i:j]]
            fits = x < 0
            ask = np.flatnonzero(~fits)
            fits[ask] = self.compatible(x[ask], y[ask])
            last[e[fits]] = y[fits]
        return last[:n]

    def _encode_chunk(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        text = SEPARATOR.join(units).replace(" ", MARK)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        opens = np.zeros(len(points), bool)
        opens[starts] = True
        last = self._fill(text, points, opens)
        steps = np.where(last < 0, 1, self.lengths[last])
        mark, at, low = np.zeros(len(points), bool), starts + sizes - 1, starts
        while len(at):  # backwards from each unit's end
            mark[at] = True
            at = at - steps[at]
            on = at >= low
            at, low = at[on], low[on]
        at = np.flatnonzero(mark)
        token, point = last[at], points[at]
        if len(self.runs):
            at, token, point = self._with_runs(at, token, point)
        spread = np.where(token >= 0, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        ids = np.repeat(token, spread)
        odd = ids < 0
        if odd.any():
            raw = np.frombuffer("".join(map(chr, point[token < 0].tolist())).encode(), np.uint8)
            ids[odd] = self.bytes[raw]
        unit = np.searchsorted(starts, at, side="right") - 1
        return ids.astype(np.uint32), np.bincount(unit, weights=spread, minlength=len(units)).astype(np.int64)

    def _with_runs(self, at: np.ndarray, token: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Single spaces side by side, joined as ``runs`` says."""
        single = token == self.run_pieces[1]
        follows = np.zeros(len(at), bool)
        follows[1:] = single[1:] & single[:-1] & (at[1:] == at[:-1] + 1)
        if not follows.any():
            return at, token, point
        place, most = np.arange(len(at)), self.runs.shape[1]
        start = np.maximum.accumulate(np.where(follows, 0, place))
        nth = place - start
        left = np.minimum(most, np.bincount(start, minlength=len(at))[start] - nth + nth % most)
        token = np.where(single, self.runs[left, nth % most], token)
        stay = token != -1
        return at[stay], token[stay], point[stay]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units that aren't empty, and how many each has."""
        ids, counts, at = [], [], 0
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        while at < len(units):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK_CHARS, side="right")))
            got = self._encode_chunk(units[at:to])
            ids.append(got[0])
            counts.append(got[1])
            at = to
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units of texts that have their space in front, and the n+1 bounds of each text's."""
        texts = pa.concat_arrays([texts, texts.slice(0, 0)]) if texts.offset else texts
        at = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: at[-1]]
        space, feed = raw == 0x20, raw == 0x0A
        opens = feed.copy()
        opens[1:] |= space[1:] & ~space[:-1]
        opens[1:] |= feed[:-1]
        opens[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(opens)
        offsets = np.append(starts, at[-1]).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), texts.buffers()[2]])
        return flat, np.searchsorted(starts, at)

    def encode_spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that have their space in front, without begin and end, and their n+1 bounds."""
        flat, offsets = self.units(texts)
        coded = flat.dictionary_encode()
        own, where = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        codes = np.fromiter(map(self.known.get, own, itertools.repeat(-1)), np.int64, len(own))
        ids, starts, counts = self.ids, self.starts, self.counts
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = [own[i] for i in missing.tolist()]
            more, times = self.encode_units(new)
            starts = np.concatenate((starts, len(ids) + np.cumsum(times) - times))
            base, ids, counts = len(counts), np.concatenate((ids, more)), np.concatenate((counts, times))
            codes[missing] = np.arange(base, base + len(new))
            if self.known_bytes < KNOWN_BYTES:
                self.ids, self.starts, self.counts = ids, starts, counts
                self.known |= zip(new, range(base, base + len(new)))
                self.known_bytes += 4 * len(more) + 150 * len(new) + sum(map(len, new))
        code = codes[where] if len(flat) else np.zeros(0, np.int64)
        counts = counts[code]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids[gather(starts[code], counts)], bounds[offsets]

    def encoded(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts of a column with begin and end ids, and their bounds, some texts at a time; a null text is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.asarray(pc.binary_length(column))
        space, none, at = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()), 0
        while at < len(column):
            n = int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, side="right"))
            if n:
                texts = pc.replace_substring(column.slice(at, n), MARK, " ")
                texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))
                ids, bounds = self.encode_spaced(texts)
            else:  # one long text; its parts' memory is bounded, its ids are held whole
                n, parts = 1, [self.encode_spaced(pa.array([x], pa.large_string()))[0] for x in _cut(" " + column[at].as_py().replace(MARK, " "))]
                ids = np.concatenate(parts)
                bounds = np.array([0, len(ids)])
            yield self._framed(ids, bounds)
            at += n

    def _framed(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, n = np.diff(bounds), len(bounds) - 1
        out, ends = np.empty(len(ids) + 2 * n, np.uint32), bounds + 2 * np.arange(n + 1)
        out[ends[:-1]], out[ends[1:] - 1] = self.bos, self.eos
        out[np.arange(len(ids)) + np.repeat(2 * np.arange(n) + 1, counts)] = ids
        return out, ends

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes | memoryview]:
        """The UTF-8 texts of ids: control ids are silent, the space in front goes, stray bytes become U+FFFD each."""
        flat = self.spelled.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(flat.buffers()[1], np.int64)[: len(ids) + 1]
        raw = memoryview(flat.buffers()[2] or b"")
        heard = np.append(np.flatnonzero(self.visible[ids]), len(ids))
        first = heard[np.searchsorted(heard, bounds[:-1])]
        strip = (first < bounds[1:]) & self.spaced[ids[np.minimum(first, len(ids) - 1)]] if len(ids) else np.zeros(len(bounds) - 1, bool)
        out = [raw[i:j] for i, j in zip((at[bounds[:-1]] + strip).tolist(), at[bounds[1:]].tolist())]
        if (np.isin(ids, self.bytes[128:])).any():  # bytes make a character only side by side
            silent = np.flatnonzero(~self.visible[ids])
            for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                cuts = [i, *silent[np.searchsorted(silent, i) : np.searchsorted(silent, j)].tolist(), j]
                parts = [raw[at[x] : at[y]] for x, y in zip(cuts, cuts[1:])]
                out[k] = "".join(codecs.utf_8_decode(x, "each_byte", True)[0] for x in parts).encode()[int(strip[k]) :]
        return out


def _cut(text: str) -> Iterator[str]:
    """A long text in parts, cut where units begin."""
    at = 0
    while at < len(text):
        cut = BORDER.search(text, at + BATCH_BYTES // 4)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model's tables, loaded once per worker; ``path`` is a file, or a name of public_tokenizers."""
    if path not in _loaded:
        where = path
        if "/" not in path:
            import public_tokenizers

            where = public_tokenizers.path(path)
        _loaded[path] = Pieces(where)
    return _loaded[path]


def _digest_rows(path: str, with_ids: bool, with_text: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        try:
            for batch in words.text_batches(batches):
                at = 0
                for ids, bounds in v.encoded(batch.column(1)):
                    n, raw = len(bounds) - 1, memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    back = v.decoded(ids, bounds)
                    own = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist())]
                    cols = [batch.column(0).slice(at, n), pa.array(np.diff(bounds)), pa.array(own, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
                    if with_text:
                        cols.append(pa.array([bytes(x) for x in back], pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    at += n
        finally:
            v.forget()
            words.give_back()

    return run


def piece_round_trip(docs: DataFrame, path: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encode whole texts with begin and end ids and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` and
    ``decoded``; a row for each row of ``docs``, repeated rows included.  A null or empty text
    has the two ids only and decodes to nothing.  Names of control pieces in a text are
    ordinary text.  A text of any length is encoded whole, in parts that end where units end;
    only its ids are held at once.  Null or repeated ids and other columns have no influence.
    An empty table gives none.  No shuffle.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return rows.mapInArrow(_digest_rows(path, with_ids, with_text), fields)
