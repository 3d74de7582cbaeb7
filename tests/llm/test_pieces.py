"""SentencePiece round trips against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import tracelake.llm.piece_bpe as piece_bpe
from tracelake.llm.piece_bpe import Pieces, piece_round_trip, pieces

from . import helpers as h

NAME = "piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))
ALPHABET = list("aeithnrsoTHE1234567890!?#.,;:(){}*/-<>_'\" \t\n\r\x00\x1c\x85\xa0 ▁ΣσßÅẹ́中文한글🙂́​￿�ǅﬁ")


def want(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def check(texts):
    v, at = pieces(NAME), 0
    for ids, bounds in v.encoded(pa.array(texts, pa.string())):
        back = v.decoded(ids, bounds)
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = want(texts[at + k])
            assert ids[i:j].tolist() == own, texts[at + k]
            assert bytes(back[k]).decode() == LIBRARY.decode(own)
        at += len(back)
    assert at == len(texts)


@given(st.lists(st.text(alphabet=ALPHABET, max_size=80), max_size=8))
@settings(max_examples=300, deadline=None)
def test_same_as_the_library(texts):
    check(texts)


@given(st.lists(st.lists(st.integers(259, 31999), max_size=30), max_size=4))
@settings(max_examples=300, deadline=None)
def test_pieces_side_by_side(lists):
    check(["".join(LIBRARY.id_to_piece(i) for i in x) for x in lists])


def test_awkward_texts():
    r = random.Random(3)
    check([None, "", " ", "  ", " a", "a ", "  a  b  ", "\n", "\n\n", " \n \n", "a\n b", "▁", "▁▁a▁", "<s>a</s><unk><0x0A>", "\x00", "x" * 5000, " " * 5000, "▁" * 70, "é" * 3000, "中" * 3000, "🙂" * 200, "\U0010ffff￿"])
    check(["".join(r.choice("aeiouthns") for _ in range(40_000)), "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(40_000)), "".join(r.choice(["th", "e", "中", "\x07", "ing", "é"]) for _ in range(30_000))])


def test_every_length_around_the_sections(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("aethinors") for _ in range(n)) for n in range(1, 160)]
    monkeypatch.setattr(piece_bpe, "SECTION", 17)
    check(texts)
    monkeypatch.setattr(piece_bpe, "LONG", 1)
    check(texts)


def test_small_tables_give_the_same(monkeypatch):
    monkeypatch.setattr(piece_bpe, "KNOWN_BYTES", 4000)
    monkeypatch.setattr(piece_bpe, "BATCH_BYTES", 500)
    monkeypatch.setattr(piece_bpe, "CHUNK_CHARS", 100)
    check([t for _, t, *_ in h.corpus()])


def test_every_verdict():
    """The vectorised verdict equals encoding the joint text, step by step."""
    v, r = pieces(NAME), random.Random(4)
    runs = set(v.run_pieces.values())
    text = {i: LIBRARY.id_to_piece(i) for i in range(259, 32000) if i not in runs}
    order = {t: int(v.order[i]) for i, t in text.items()}

    def merged(t):
        parts = list(t)
        while found := [(order[z], k) for k in range(len(parts) - 1) if (z := parts[k] + parts[k + 1]) in order]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    some = [i for i, t in text.items() if len(t) < 4 and t.isascii()]
    x, y = (np.array([*(r.choice([*text]) for _ in range(3000)), *(r.choice(some) for _ in range(3000))]) for _ in range(2))
    good = v.tested(x, y)
    assert 500 < good.sum() < 5900
    for a, b, g in zip(x.tolist(), y.tolist(), good.tolist()):
        assert (merged(text[a] + text[b]) == [text[a], text[b]]) == g
    assert (v.compatible(x, y) == good).all() and (v.compatible(x[::-1], y[::-1]) == good[::-1]).all()


def test_decoding_of_any_ids():
    r = random.Random(6)
    for _ in range(300):
        ids = [r.choice([1, 2, r.randint(3, 258), r.randint(128, 258), 28705, r.randint(259, 31999)]) for _ in range(r.randint(0, 12))]
        got = pieces(NAME).decoded(np.array(ids, np.uint32), np.array([0, len(ids)]))[0]
        assert bytes(got).decode() == LIBRARY.decode(ids), ids


def test_query(spark):
    rows = h.corpus()
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in piece_round_trip(h.documents(spark, rows, clashing=True)).collect())
    expected = []
    for i, t, *_ in rows:
        ids = want(t)
        back = LIBRARY.decode(ids)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), h.sha(back), tuple(ids), back))
    assert got == sorted(expected)
    assert piece_round_trip(h.documents(spark, [])).count() == 0
    assert [r.n_tokens for r in piece_round_trip(h.documents(spark, [(None, None, None, None, None)] * 2)).collect()] == [2, 2]


def test_other_models_are_refused():
    with pytest.raises(Exception):
        Pieces(public_tokenizers.path("word_bpe_49k.json"))
