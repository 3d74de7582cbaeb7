"""Filter interactions and source divergence against plain re-statements."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import tracelake.llm.filter_audit as filter_audit_module
import tracelake.llm.source_tries as source_tries
from tracelake.llm.filter_audit import _masks_of_range, failure_masks, filter_audit
from tracelake.llm.source_tries import Trie, shares, source_divergence, term_array

from . import helpers as h

BIG = 1 << 60


def fails(rows, least_words):
    low = {}
    key = lambda i: BIG if i is None else i
    for i, t, *_ in rows:
        low[t or ""] = min(low.get(t or "", BIG), key(i))
    for i, t, part, *_ in rows:
        w, t = h.words(t), t or ""
        tests = [len(w) < least_words, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), key(i) > low[t]]
        yield i, part or "", sum(x << k for k, x in enumerate(tests))


def audit(rows, labels, least_words):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    found = list(fails(rows, least_words))
    out = []
    for part in {p for _, p, _ in found}:
        own = [(i, m) for i, p, m in found if p == part]
        shapley, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                removed = [x for x in left if x[1] & bit]
                gone = sum(1 for _, m in own if m & bit) - len(removed)
                left = [x for x in left if not x[1] & bit]
                shapley[f] += len(removed)
                lines.append([part, "".join(order), step, len(left), len(removed), gone, sum(m == bit for _, m in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), f])
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


def audit_rows():
    r = random.Random(7)
    rows = h.corpus(4)
    rows += [(1000 + k, "a copy of many # 100%", "en", "s1", 0) for k in range(300)]
    rows += [(5000, "the same row", "de", "s1", 0)] * 200 + [(4000, "the same row", "fr", "s1", 0), (None, "the same row", "fr", None, 0), (None, "null ids only", "", None, 0), (None, "null ids only", "", None, 0)]
    rows += [(i, "SHOUT " * r.randint(1, 30), r.choice(["en", "de"]), None, 0) for i in range(6000, 6040)] + [(5, "", "x", None, 0), (None, None, "x", None, 0), (3, "\t \n", "x", None, 0)]
    r.shuffle(rows)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*range(0, 70, 2), *range(1000, 1200, 3), 5000, 5000, 4000, 99999]] + [(None, 1, 1)]
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_filter_audit(spark, monkeypatch):
    rows, labels = audit_rows()
    monkeypatch.setattr(filter_audit_module, "RANGE_BYTES", 2000)  # many ranges: groups of copies go over their borders
    got = filter_audit(h.documents(spark, rows, clashing=True).repartition(4), labelled(spark, labels), least_words=20)
    assert sorted(map(tuple, got.collect())) == audit(rows, labels, 20)


def test_failure_masks(spark, monkeypatch):
    rows, _ = audit_rows()
    for size in (500, 1 << 20):
        monkeypatch.setattr(filter_audit_module, "RANGE_BYTES", size)
        got = Counter()
        for x in failure_masks(h.documents(spark, rows).repartition(3), least_words=20).collect():
            got[x.doc_id, x.part, x.mask] += x.n
        assert got == Counter(fails(rows, 20))


def test_filter_audit_of_nothing(spark):
    none = h.documents(spark, [])
    assert filter_audit(none, labelled(spark, [])).count() == 0
    got = filter_audit(h.documents(spark, [(1, None, None, None, None)]), labelled(spark, [])).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120 and {r.good_lost for r in got} == {0}


@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("xyz"), st.one_of(st.none(), st.integers(0, 4))), max_size=30), st.integers(1, 7), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_borders(rows, ranges, batch_rows):
    """Cut anywhere, with different texts of one fingerprint: open rows and smallest ids settle everything."""
    key = lambda i: BIG if i is None else i
    dealt = sorted(rows, key=lambda x: (x[0], key(x[2])))
    cut = -(-len(dealt) // ranges) or 1
    out, lows = [], {}
    for a in range(0, len(dealt), cut):
        own = sorted(dealt[a : a + cut], key=lambda x: (x[0], x[1], key(x[2])))
        batches = [pa.RecordBatch.from_arrays([pa.array([x[2] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.string()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.string())], names=list("abcd")) for part in (own[k : k + batch_rows] for k in range(0, len(own), batch_rows))]
        for b in _masks_of_range(1)(iter(batches)):
            for i, part, mask, edge in zip(*(c.to_pylist() for c in b.columns)):
                if mask < 0:
                    lows[edge] = min(lows.get(edge, BIG), key(i))
                else:
                    out.append((i, part, mask, edge))
    copies = Counter((part, i, bool(mask & 16) or edge is not None and key(i) > lows.get(edge, BIG)) for i, part, mask, edge in out)
    least = {}
    for f, t, i in rows:
        least[f, t] = min(least.get((f, t), BIG), key(i))
    assert copies == Counter((t, i, key(i) > least[f, t]) for f, t, i in rows)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least_docs, most_ranks=50):
    groups, df, count = set(), Counter(), defaultdict(Counter)
    for _, t, lang, source, *_ in rows:
        g = (lang or "", source or "")
        groups.add(g)
        own = TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        count[g].update(own)
        df.update((g[0], w) for w in set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((w for (x, w), n in df.items() if x == lang and n >= least_docs), key=str.encode)
        sources = [s for x, s in groups if x == lang]
        own = {s: [count[lang, s][w] for w in kept] for s in sources}
        p = lambda c: [1 + (10**9 * (x + 5)) // (sum(c) + 5 * len(kept)) for x in c]
        ps, q = {s: p(c) for s, c in own.items()}, p([sum(x) for x in zip(*own.values())])
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(ps[s], ps[x])), x.encode(), x) for x in sources if x != s]
            terms = [(b - a, w.encode(), w) for w, n, a, b in zip(kept, own[s], ps[s], q) if n and a > b]
            out += [(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(sorted(terms)[:most_ranks], 1)]
    return sorted(out)


def divergence_rows():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abàé中🙂ǅΣ") for _ in range(r.randint(1, 7))) for _ in range(120)] + ["Word", "word", "don't", "x-ray", "é" * 500]
    rows = h.corpus(6)
    for i in range(300):
        own = vocabulary[: r.randint(20, 125)]
        rows.append((i, r.choice([" ", ",", "1", "\n", "_"]).join(r.choice(own) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s1", "é", "z", "", None, "中"]), 0))
    rows += [(1, None, "only", "a", 0), (2, "", "only", "b", 0), (3, "rare", "few", None, 0), rows[-1], rows[-1]]
    return rows


def test_source_divergence(spark, monkeypatch):
    rows = divergence_rows()
    want = divergence(rows, 5)
    assert sum(x[2] == "term" for x in want) > 100
    docs = h.documents(spark, rows, clashing=True).repartition(5)
    assert sorted(map(tuple, source_divergence(docs, least_docs=5).collect())) == want
    monkeypatch.setattr(source_tries, "RANGE_BYTES", 1 << 10)
    assert sorted(map(tuple, source_divergence(docs, least_docs=5, most_ranks=3).collect())) == divergence(rows, 5, 3)


def test_source_divergence_of_nothing(spark):
    assert source_divergence(h.documents(spark, [])).count() == 0
    got = source_divergence(h.documents(spark, [(1, None, None, None, None), (2, "a b", None, "s", None)])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_small_tries_and_blocks(monkeypatch):
    """Tries sent early, subtries merged and blocks cut: the same sums, in process."""
    rows = divergence_rows()
    for name, value in (("MOST_LEAVES", 40), ("BLOCK_CELLS", 60), ("CARRY_BYTES", 300)):
        monkeypatch.setattr(source_tries, name, value)
    sent = []
    for a in range(0, len(rows), 70):
        own = rows[a : a + 70]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] or "" for x in part], pa.string()) for k in (2, 3, 1)], names=list("lst")) for part in (own[:30], own[30:])]
        for b in source_tries._count(2)(iter(batches)):
            sent += b.to_pylist()
    assert len({x["prefix"] for x in sent}) < len(sent)
    sent.sort(key=lambda x: x["prefix"])
    blocks = [x for b in source_tries._blocks(5)(iter([pa.RecordBatch.from_pylist(sent[k : k + 9], source_tries.SUBTRIE) for k in range(0, len(sent), 9)])) for x in b.to_pylist()]
    got = Counter()
    for x in blocks:
        names = [t for t, n in zip(x["terms"], x["sizes"]) for _ in range(n)]
        got.update({(x["lang"], t, x["sources"][g]): n for t, g, n in zip(names, x["groups"], x["counts"])})
        assert x["terms"] == sorted(x["terms"], key=str.encode)
    df, count = Counter(), Counter()
    for _, t, lang, source, *_ in rows:
        own = TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        count.update((lang or "", w, source or "") for w in own)
        df.update((lang or "", w) for w in set(own))
    assert got == Counter({k: n for k, n in count.items() if df[k[:2]] >= 5})


def test_rows_of_a_task_do_not_grow_with_its_blocks():
    """Many blocks make the rows of one: a row for each pair, and each source's best terms of all blocks."""
    r = random.Random(4)
    sources, terms = ["a", "b", "c"], [f"t{k:03d}" for k in range(300)]
    counts = {t: [r.randint(0, 9) for _ in sources] for t in terms}
    totals = [sum(c[k] for c in counts.values()) for k in range(3)]
    fields = pa.schema([*source_tries.BLOCK.remove(3).remove(2).insert(2, pa.field("names", pa.list_(pa.string()))), source_tries.BLOCK.field("sources"), source_tries.BLOCK.field("totals"), pa.field("kept", pa.int64())])

    def made(size):
        dealt = r.sample(range(0, 300, size), 300 // size)
        rows = []
        for a in dealt:
            own = terms[a : a + size]
            cells = [[k for k in range(3) if counts[t][k]] for t in own]
            rows.append({"lang": "x", "terms": own, "names": sources, "sizes": [len(c) for c in cells], "groups": sum(cells, []), "counts": [counts[t][k] for t, c in zip(own, cells) for k in c], "sources": sources, "totals": totals, "kept": 300})
        batches = (pa.RecordBatch.from_pylist(rows[k : k + 4], fields) for k in range(0, len(rows), 4))
        return sorted(tuple(x.values()) for b in source_tries._compared(7)(batches) for x in b.to_pylist())

    assert len(made(300)) == 3 * 2 + 3 * 7
    assert made(5) == made(300)


@given(st.lists(st.binary(max_size=6), max_size=40))
@settings(max_examples=300, deadline=None)
def test_trie(terms):
    n = len(terms)
    trie = Trie(pa.array(terms, pa.large_binary()), np.arange(n), np.arange(n) % 3, np.arange(n), np.ones(n, np.int64))
    assert trie.paths.to_pylist() == sorted(set(terms))
    want = defaultdict(lambda: [0, 0])
    for k, t in enumerate(terms):
        want[t, k % 3][0] += k
        want[t, k % 3][1] += 1
    assert {(trie.paths[i].as_py(), g): [c, d] for i, g, c, d in zip(trie.leaves.tolist(), trie.groups.tolist(), trie.counts.tolist(), trie.docs.tolist())} == want
    shared, own = source_tries.shared_bytes(trie.paths), trie.paths.to_pylist()
    assert all(own[k - 1][:x] == own[k][:x] and own[k - 1][x : x + 1] != own[k][x : x + 1] for k, x in enumerate(shared.tolist()) if k)
    labels = pa.array([t[x:] for t, x in zip(own, shared.tolist())], pa.large_binary())
    assert source_tries.paths_of(shared, labels).to_pylist() == own


@given(st.lists(st.one_of(st.none(), st.text(alphabet=list("aBZ@[`{ \n1é中🙂\x00\x7f\x80"), max_size=12)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_terms(texts):
    texts = [t or "" for t in texts]
    flat, bounds = term_array(pa.array(["cut", *texts], pa.large_string()).slice(1))
    own = [x.decode() for x in flat.to_pylist()]
    want = [TERM.findall(t.translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert [own[i:j] for i, j in zip(bounds, bounds[1:])] == want


def test_shares_are_exact():
    for total in (10, 10**9, 2**32, 10**13, 2**60):
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert shares(counts, total, 7).tolist() == [1 + 10**9 * (c + 5) // (total + 35) for c in counts.tolist()]
