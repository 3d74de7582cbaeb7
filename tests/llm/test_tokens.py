"""BPE and token files against the tokenizers library."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm.bpe import bpe_round_trip, encoded, vocabulary
from tracelake.llm.token_files import BLOCK_IDS, block, blocks, pack, token_files, unpack

from . import helpers as h

NAME = "word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
ALPHABET = list("aàâeéiosxyz'sStTlLdDrR1234567890!?#.,-<|>endoftext \t\n\x1c\x85\xa0 ΣσςİßÅẹ́̇中文한글🙂́​€ǅŉﬁ")


def ids_of(texts):
    out = []
    for ids, bounds in encoded(pa.array(texts, pa.string()), vocabulary(NAME)):
        out += (ids[i:j] for i, j in zip(bounds[:-1], bounds[1:]))
    return out


def check(texts):
    v = vocabulary(NAME)
    for t, ids in zip(texts, ids_of(texts)):
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert v.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_same_as_the_library(texts):
    check(texts)


def test_awkward_texts():
    r = random.Random(2)
    letters = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 16))) for _ in range(4000))
    check(["a<|endoftext|>b <|startoftext|><|endoftext|>", "it's WE'RE i'll 'S 'T", "", " ", "x" * 3000, None, "é" * 300, "aaaaaaa", "<|endoftext|", letters, "\x00\x01\x7f"])


def test_every_adjacent_pair_verdict():
    """The vectorised verdict equals merging the joint text."""
    v, r = vocabulary(NAME), random.Random(4)
    plain = [i for i, t in enumerate(v.text_of) if t and not t.endswith(v.suffix) and v.merge(t) == [i]]
    ends = [i for i, t in enumerate(v.text_of) if t.endswith(v.suffix) and len(t) > 4]
    x = np.array([r.choice(plain) for _ in range(3000)])
    y = np.array([r.choice(ends) for _ in range(3000)])
    good = v.compatible(x, y)
    for a, b, g in zip(x.tolist(), y.tolist(), good.tolist()):
        t = v.text_of[b].removesuffix(v.suffix)
        ended = t[:-1] + chr(ord(t[-1]) + 0x1000)
        if v.merge(ended) == [b]:
            assert (v.merge(v.text_of[a] + ended) == [a, b]) == g


def test_small_cache_gives_the_same(monkeypatch):
    import tracelake.llm.bpe as bpe

    monkeypatch.setattr(bpe, "KNOWN_BYTES", 4000)
    monkeypatch.setattr(bpe, "BATCH_BYTES", 500)
    check([t for _, t, *_ in h.corpus()])


def test_other_scripts_without_the_library():
    """Any script goes the dealt way; the library is asked only for unassigned characters."""
    v = vocabulary(NAME)
    r = random.Random(8)
    blocks_of = [(0x400, 0x4FF), (0x370, 0x3FF), (0x5D0, 0x5EA), (0x620, 0x64A), (0x900, 0x97F), (0xE01, 0xE30), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F6FF), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x660, 0x669), (0x2150, 0x218B)]
    texts = [" ".join("".join(chr(r.randint(*r.choice(blocks_of))) if k % 5 == 0 else chr(r.randint(*b)) for k in range(r.randint(1, 9))) for _ in range(60)) for b in blocks_of for _ in range(3)]
    texts = ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in texts]
    texts += ["Привет, мир! 2024 год", "你好，世界。今天", "👩‍👩‍👧 ok 🙂🙂", "ΟΔΥΣΣΕΥΣ ΣΣ", "İstanbul e\u0301te\u0301 \u1100\u1161", "<|endoftext|>мир<|startoftext|>世"]
    v.loaded = None
    ids_of(texts)
    assert v.loaded is None
    check(texts)
    check(["\u0558x \U0001fae9"])
    assert v.loaded is not None


def test_query(spark):
    rows = h.corpus()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in bpe_round_trip(h.documents(spark, rows, clashing=True)).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), h.sha(back), tuple(ids), back))
    assert got == want
    assert bpe_round_trip(h.documents(spark, [])).count() == 0
    assert bpe_round_trip(h.documents(spark, [(None, None, None, None, None)] * 2)).collect()[0].n_tokens == 0


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49407), st.integers(0, 2**32 - 1)), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_coding_round_trip(ids):
    a = np.array(ids, np.uint32)
    code, offsets = pack(a)
    assert (unpack(code, offsets, len(a)) == a).all() and len(offsets) == -(-len(a) // 512)


def test_blocks_round_trip():
    ids = np.arange(5000, dtype=np.uint32) * 9
    content = block(3, np.array([5, 6]), np.array([2000, 3000]), ids) + b"\n" + block(3, np.array([9]), np.array([0]), ids[:0]) + b"\n"
    got = list(blocks(content))
    assert [g[0] for g in got] == [3, 3] and (got[0][3] == ids).all() and got[0][2].tolist() == [2000, 3000] and BLOCK_IDS > 0
    with pytest.raises(ValueError):
        list(blocks(b"x" * 40))


def test_token_files(spark):
    rows = h.corpus() + [(None, "tail text", None, None, None)]
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files(h.documents(spark, rows, clashing=True).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_files(h.documents(spark, [])).count() == 0
    repeated = token_files(h.documents(spark, [(1, "a", None, None, None), (1, "b", None, None, None), (1, "a", None, None, None)])).collect()
    assert sorted(r.start for r in repeated) == [0, 2, 4]
