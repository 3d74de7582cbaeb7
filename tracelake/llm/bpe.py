"""BPE encoding and decoding with a word-level vocabulary file, exactly as its library does.

Method (speculate and verify).  The distinct words of a batch that are not yet known are
joined into one string; one pass of an Aho-Corasick automaton proposes greedy longest tokens
for all of them.  A token sequence is the BPE result exactly if every adjacent pair is
compatible, that is, if encoding the pair's joint text gives the pair back.  All distinct
adjacent pairs are tested at once with numpy, walking both tokens' merge trees along their
common border.  Only words with a failing pair are merged exactly, step by step.

A batch's words are dictionary-encoded by Arrow, so a word costs one look-up a batch and its
ids are gathered by numpy.  A task keeps its first words in a table of bounded bytes and
empties it when it ends.  Words are normalised as the file says (NFC, white space to one space,
lower case by character) and cut into pieces by its pattern; none of this looks across white
space.  Only words with a character that Python's Unicode tables don't assign are left to
the library: the two may know different versions of Unicode.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..plans.ship import ship_package
from . import words

#: White space as the vocabulary's pattern has it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that every Unicode version treats alike and that NFC leaves alone: Latin blocks, general punctuation, currency.
PLAIN_RANGES = r"\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
PLAIN = re.compile(f"[{PLAIN_RANGES}]*")
WHITE = re.compile(f"[{SPACE}]")
KNOWN_BYTES = 40 << 20  # up to which a task keeps words from batch to batch; the frequent ones come first
BATCH_BYTES = 8 << 20  # of text that is encoded at once; longer texts are cut at white space
NONE = np.iinfo(np.int64).max
END = 0x1000  # added to a word's last letter: the letter with the end-of-word suffix


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


def piece_pattern(source: str) -> re.Pattern:
    r"""The file's pattern with \s, \p{L} and \p{N} spelled out for the characters of PLAIN."""
    every = [c for c in map(chr, range(0x2100)) if PLAIN.fullmatch(c)]
    group = lambda kind: "".join(re.escape(c) for c in every if unicodedata.category(c)[0] == kind)
    letters = group("L")
    out = source.replace(r"\s", SPACE).replace(r"\p{N}", group("N")).replace(r"[\p{L}]", f"[{letters}]").replace(r"\p{L}", letters)
    contractions, rest = out.split(f"[{letters}]+", 1)
    return re.compile(f"[{letters}]+|{contractions.strip('|')}{rest}|\\n")  # letters first: nothing else starts with one


class PairTable:
    """Merge orders and results of token pairs, looked up by numpy; a few small hash tables, each for what collided in the one before."""

    BITS = 19

    def __init__(self, keys: np.ndarray, order: np.ndarray, joined: np.ndarray):
        self.levels, rest, seed = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(rest):
            slots = self._slots(keys[rest], seed)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << self.BITS, -1)
            table[slots[first]] = rest[first]
            self.levels.append((seed, table))
            rest = np.delete(rest, first)
            seed = (seed * 0xD6E8FEB86659FD93 + 2) & 0xFFFFFFFFFFFFFFFF | 1
        self.keys, self.order, self.joined = np.append(keys, -1), np.append(order, NONE), np.append(joined, -1)

    def _slots(self, keys: np.ndarray, seed: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(seed)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, joined token) of each pair; order NONE where there is no merge."""
        found = np.full(len(keys), -1)
        for seed, table in self.levels:
            at = table[self._slots(keys, seed)]
            found = np.where(self.keys[at] == keys, at, found)
        return self.order[found], self.joined[found]


class Vocabulary:
    """Tables of one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.loaded = path, None
        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pattern = piece_pattern(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.wide = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE) + r"|\n")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        ids: dict[str, int] = model["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.text_of: list[str] = [""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            self.text_of[i] = t
        letters = byte_letters()
        self.letters = np.array(list(map(ord, letters)), np.uint32)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.full(size, -1), np.full(size, -1)
        order = np.zeros(size, np.int64)  # 0 for letters, 1 + rank for merged tokens
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank.setdefault((x, y), (r, z))
            if left[z] < 0:
                left[z], right[z], order[z] = x, y, 1 + r
        self.left, self.right, self.order = left, right, order
        self.base = {}
        for c in letters:
            for key, name in ((ord(c), c), (ord(c) + END, c + self.suffix)):
                if name in ids:
                    self.base[key] = ids[name]
        self.size = size
        self.pairs = PairTable(np.array([x * size + y for x, y in self.rank]), np.array([1 + r for r, _ in self.rank.values()]), np.array([z for _, z in self.rank.values()]))
        self.lengths = np.array([len(t) - len(self.suffix) * t.endswith(self.suffix) for t in self.text_of])
        self.texts = pa.array(self.text_of, pa.large_string())
        self.automaton, keys, own = ahocorasick.Automaton(), [], []
        for t, i in ids.items():
            core, ends = (t[: -len(self.suffix)], True) if t.endswith(self.suffix) else (t, False)
            if core:
                keys.append(core[:-1] + chr(ord(core[-1]) + END) if ends else core)
                own.append(i)
        merged, bounds = self.merge_all(keys)
        single = np.diff(bounds) == 1  # tokens that no merging yields are never proposed
        single[single] = merged[bounds[:-1][single]] == np.array(own)[single]
        for key, i, good in zip(keys, own, single.tolist()):
            if good:
                self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self.forget()

    @property
    def library(self) -> Tokenizer:
        if self.loaded is None:
            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def forget(self) -> None:
        """Empty the table of known words."""
        self.known: dict[str, int] = {}
        self.known_bytes = 0
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, word: str) -> list[int]:
        """Exact merging of one word of letters: the lowest rank first, leftmost among equals."""
        ids = [self.base[x] for x in map(ord, word) if x in self.base]
        while len(ids) > 1:
            found = [(self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not found:
                break
            best = min(found)[0]
            i, out = 0, []
            while i < len(ids):
                got = self.rank.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if got and got[0] == best:
                    out.append(got[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_all(self, todo: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merge for many words at once: all ids, and the n+1 bounds of each word's."""
        text = np.frombuffer("".join(todo).encode("utf-16-le"), np.uint16).astype(np.int64)
        base = np.full(2 * END, -1)
        base[list(self.base)] = list(self.base.values())
        ids, word_of = base[text], np.repeat(np.arange(len(todo)), np.fromiter(map(len, todo), np.int64, len(todo)))
        word_of, ids = word_of[ids >= 0], ids[ids >= 0]
        done_ids, done_words = [], []
        while len(ids):
            order, joined = self.pairs.find(ids[:-1] * self.size + ids[1:])
            order[word_of[:-1] != word_of[1:]] = NONE
            order = np.append(order, NONE)
            starts = np.flatnonzero(np.concatenate(([True], word_of[1:] != word_of[:-1])))
            best = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(ids))))
            hit = (order == best) & (order != NONE)
            place = np.arange(len(ids))
            before = np.concatenate(([False], hit[:-1]))
            since = place - np.maximum.accumulate(np.where(hit & ~before, place, -1))
            hit &= since % 2 == 0  # of overlapping equal pairs the first, the third, ...
            at = np.flatnonzero(hit)
            ids[at] = joined[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            over = best == NONE
            done_ids.append(ids[over])
            done_words.append(word_of[over])
            stay &= ~over
            ids, word_of = ids[stay], word_of[stay]
        ids, word_of = np.concatenate([*done_ids, ids]), np.concatenate([*done_words, word_of])
        order = np.argsort(word_of, kind="stable")
        return ids[order], np.searchsorted(word_of[order], np.arange(len(todo) + 1))

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether encoding the joint text of tokens x and y gives x, y; for all pairs at once.

        From the whole tokens down, the token that was merged last is taken apart along the
        border.  If two pieces that touch the border could merge before the taken-apart
        token was made, merging would have crossed the border.
        """
        good = np.ones(len(x), bool)
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), NONE)
        todo = np.arange(len(x))
        while len(todo):
            a, b = x[todo], y[todo]
            crossed = self.pairs.find(a * self.size + b)[0] < limit[todo]
            good[todo[crossed]] = False
            oa, ob = self.order[a], self.order[b]
            done = crossed | ((oa == 0) & (ob == 0))
            first = oa > ob  # the left token is younger; of equals the right one is taken apart
            # on the left a pair of the same rank comes first, on the right it comes too late
            limit[todo] = np.where(first, oa, ob + 1)
            x[todo] = np.where(first & ~done, self.right[a], a)
            y[todo] = np.where(~first & ~done, self.left[b], b)
            todo = todo[~done]
        return good

    def normal_pieces(self, new: list[str]) -> list[str]:
        """Pieces of words without special tokens, a newline after each word but the last; white space in them is skipped."""
        text = "\n".join(new)
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        return self.wide.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        coded = pa.array(self.normal_pieces(new), pa.large_string()).dictionary_encode()
        which, distinct = np.asarray(coded.indices), coded.dictionary
        between = np.flatnonzero(np.asarray(pc.equal(distinct, "\n")))
        inside = which != between[0] if len(between) else np.ones(len(which), bool)
        word_of, which = np.cumsum(~inside)[inside], which[inside]
        ids, counts = self.encode_pieces(distinct)
        starts = (np.cumsum(counts) - counts)[which]
        counts = counts[which]
        return ids[gather(starts, counts)], np.bincount(word_of, weights=counts, minlength=len(new)).astype(np.int64)

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and how many each has."""
        at = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
        sizes, bounds = np.diff(at), at[1:]
        if not len(pieces):
            return np.zeros(0, np.uint32), sizes
        spelled = self.letters[np.frombuffer(pieces.buffers()[2], np.uint8)[: at[-1]]]
        spelled[bounds - 1] += END
        text = spelled.tobytes().decode("utf-32-le")
        got = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        ends, ids = got[:, 0], got[:, 1]
        piece_of = np.searchsorted(bounds, ends, side="right")
        inner = piece_of[1:] == piece_of[:-1]
        keys, where = np.unique(ids[:-1][inner] * self.size + ids[1:][inner], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)
        bad = np.zeros(len(sizes), bool)
        bad[piece_of[1:][inner][~good[where]]] = True
        bad |= np.bincount(piece_of, weights=self.lengths[ids], minlength=len(sizes)).astype(np.int64) != sizes  # a proposal must cover the whole piece
        counts = np.bincount(piece_of, minlength=len(sizes))
        failed = np.flatnonzero(bad)
        if len(failed):
            starts = np.cumsum(counts) - counts
            merged, own = self.merge_all([text[i:j] for i, j in zip((bounds - sizes)[failed].tolist(), bounds[failed].tolist())])
            starts[failed], counts[failed] = len(ids) + own[:-1], np.diff(own)
            ids = np.concatenate((ids, merged))[gather(starts, counts)]
        return ids.astype(np.uint32), counts

    def _apart(self, word: str) -> np.ndarray:
        """Ids of a word with special tokens or unassigned characters."""
        out = []
        for part in self.specials.split(word) if self.specials else [word]:
            if part in self.special:
                out.append(np.array([self.special[part]]))
            elif any(unicodedata.category(c) == "Cn" for c in part):
                out.append(np.array(self.library.encode(part, add_special_tokens=False).ids))
            elif part:
                out.append(self.encode_words([part])[0])
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)

    def learn(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, all their ids, and how many each has."""
        plain, wide, apart = [], [], []
        for w in new:
            if "<|" in w and self.specials and self.specials.search(w):
                apart.append(w)
            elif w.isascii() or PLAIN.fullmatch(w):
                plain.append(w)
            else:
                (apart if any(unicodedata.category(c) == "Cn" for c in w) else wide).append(w)
        parts = [self.encode_words(x) for x in (plain, wide) if x]
        odd = list(map(self._apart, apart))
        ids = np.concatenate([*(x for x, _ in parts), *odd]).astype(np.uint32)
        return plain + wide + apart, ids, np.concatenate([*(x for _, x in parts), np.array(list(map(len, odd)), np.int64)])

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, and the n+1 bounds of each text's."""
        flat, offsets = words.split(texts)
        coded = flat.dictionary_encode()
        distinct, where = coded.dictionary, np.asarray(coded.indices)
        plain = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<|")))
        lower = pc.if_else(plain, pc.ascii_lower(distinct), distinct).dictionary_encode()
        own = lower.dictionary.to_pylist()
        codes = np.fromiter(map(self.known.get, own, itertools.repeat(-1)), np.int64, len(own))
        ids, starts, counts = self.ids, self.starts, self.counts
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new, more, times = self.learn([own[i] for i in missing.tolist()])
            starts = np.concatenate((starts, len(ids) + np.cumsum(times) - times))
            base, ids, counts = len(counts), np.concatenate((ids, more)), np.concatenate((counts, times))
            at = dict(zip(new, range(base, base + len(new))))
            codes[missing] = np.fromiter((at[own[i]] for i in missing.tolist()), np.int64, len(missing))
            if self.known_bytes < KNOWN_BYTES:
                self.ids, self.starts, self.counts = ids, starts, counts
                self.known |= at
                self.known_bytes += 4 * len(more) + 150 * len(new) + sum(map(len, new))
        code = codes[np.asarray(lower.indices)][where] if len(flat) else np.zeros(0, np.int64)
        counts = counts[code]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids[gather(starts[code], counts)], bounds[offsets]

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode without a decoder: the tokens' texts joined by a space."""
        return self.decode_all(np.asarray(ids), np.array([0, len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """decode of each of several texts."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.texts.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all runs of ``counts`` from ``starts``."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's tables, loaded once per worker; ``path`` is a file, or a name of public_tokenizers."""
    if path not in _loaded:
        where = path
        if "/" not in path:
            import public_tokenizers

            where = public_tokenizers.path(path)
        _loaded[path] = Vocabulary(where)
    return _loaded[path]


def _cut(text: str) -> Iterator[str]:
    """A long text in parts, cut at white space."""
    at = 0
    while at < len(text):
        cut = WHITE.search(text, at + BATCH_BYTES // 4)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def encoded(column: pa.Array, v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the texts of a column and their bounds, some texts at a time; a null text is empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    at = 0
    while at < len(column):
        before = np.cumsum(sizes[at:])
        n = int(np.searchsorted(before, BATCH_BYTES, side="right"))
        if n:
            yield v.encode_texts(column.slice(at, n))
        else:  # one long text; its parts' memory is bounded, its ids are held whole
            n, parts = 1, [v.encode_texts(pa.array([x]))[0] for x in _cut(column[at].as_py())]
            ids = np.concatenate(parts)
            yield ids, np.array([0, len(ids)])
        at += n


def _digest_rows(path: str, with_ids: bool, with_text: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
    digest = lambda raw, bounds: pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        try:
            for batch in words.text_batches(batches):
                at = 0
                for ids, bounds in encoded(batch.column(1), v):
                    n = len(bounds) - 1
                    back = v.decode_all(ids, bounds)
                    where = np.frombuffer(back.buffers()[1], np.int64)[back.offset : back.offset + n + 1]
                    cols = [batch.column(0).slice(at, n), pa.array(np.diff(bounds)), digest(memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 4 * bounds), digest(memoryview(back.buffers()[2] or b""), where)]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
                    if with_text:
                        cols.append(back.cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    at += n
        finally:
            v.forget()
            words.give_back()

    return run


def bpe_round_trip(docs: DataFrame, path: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` and
    ``decoded``; a row for each row of ``docs``.  A null text is an empty one: no ids, empty
    string.  Special tokens written in a text become their ids, as in the library; none is
    added.  Null or repeated ids and other columns have no influence.  No shuffle.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return rows.mapInArrow(_digest_rows(path, with_ids, with_text), fields)
