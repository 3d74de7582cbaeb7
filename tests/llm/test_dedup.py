"""Substring dedup and n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from tracelake.llm import ngram_join, packed
from tracelake.llm.ngram_join import ngram_jaccard_components
from tracelake.llm.substring_dedup import COVER, PERIOD, substring_dedup

from . import helpers as h


def order(rows):
    return sorted(rows, key=str)


AWKWARD = [(1, None), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A B C D E F"), (3, ""), (4, "x"), (5, "x"), (7, " ".join(map(str, range(80)))), (6, " ".join(map(str, range(5, 85)))), (7, "other"), (-3, "x")]


@pytest.fixture(params=["corpus", "awkward", "empty"])
def rows(request):
    if request.param == "corpus":
        return h.corpus()
    return [(i, t, None, None, None) for i, t in AWKWARD] if request.param == "awkward" else []


def test_substring_dedup(spark, rows):
    got = substring_dedup(h.documents(spark, rows, clashing=True)).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == order(h.windows_removed(rows))
    assert all(h.sha(r.kept_text) == r.kept_sha256 for r in got)


def test_substring_dedup_long_document_and_hot_passage(spark):
    r = random.Random(5)
    passage = [f"p{i}" for i in range(55)]
    rows = [(i, " ".join([f"w{r.randrange(9999)}" for _ in range(20)] + passage), None, None, None) for i in range(60)]
    rows.append((100, " ".join(passage * 40), None, None, None))
    got = substring_dedup(h.documents(spark, rows).repartition(7)).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == order(h.windows_removed(rows))


def test_repeated_ids_keep_their_own_words(spark):
    words = lambda n: " ".join(f"{n}{k}" for k in range(60))
    rows = [(i, t, None, None, None) for i, t in [(1, words("p")), (2, words("p")), (2, words("q")), (2, words("p")), (3, words("q")), (None, words("q"))]]
    got = substring_dedup(h.documents(spark, rows)).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == order(h.windows_removed(rows))
    assert sorted(x.n_removed for x in got) == [0, 0, 0, 60, 60, 60]


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_window_below_period_is_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup(h.documents(spark, []), window=20)


def test_components(spark, rows):
    got = ngram_jaccard_components(h.documents(spark, rows, clashing=True)).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(h.classes(rows))


def test_components_around_the_threshold(spark, monkeypatch):
    """A chain and a crowd of near misses, with small blocks and groups so that every path is taken."""
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "STAR_SIGNATURES", 3)  # leaves more to the last round
    r = random.Random(3)
    base, rows = [f"b{i}" for i in range(130)], []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w), None, None, None))
    for i in range(30):  # a window that slides over one long text
        rows.append((200 + i, " ".join(f"c{k}" for k in range(9 * i, 9 * i + 100)), None, None, None))
    for n in range(1, 30):  # short sets of every size
        rows.append((300 + n, " ".join(f"d{k}" for k in range(n)), None, None, None))
    got = ngram_jaccard_components(h.documents(spark, rows).repartition(5)).collect()
    assert order((x.doc_id, x.n_shingles, x.component_id) for x in got) == order(h.classes(rows))


def test_crowd_with_a_common_line(spark, monkeypatch):
    """Texts that share a line only aren't compared with each other, and their near copies are found."""
    r = random.Random(3)
    line = [f"line{k}" for k in range(14)]
    rows = []
    for i in range(150):
        own = [f"w{i}x{k}" for k in range(r.randint(20, 40))]
        rows.append((2 * i, " ".join(line + own), None, None, None))
        rows.append((2 * i + 1, " ".join(line + own[: r.randint(len(own) - 12, len(own) - 1)]), None, None, None))
    base = [f"b{k}" for k in range(60)]
    rows += [(1000 + i, " ".join(base[:k] + [f"c{i}"] + base[k + 1 :] if i else base), None, None, None) for i, k in enumerate(r.choices(range(60), k=50))]
    met = []
    in_blocks = ngram_join._in_blocks
    monkeypatch.setattr(ngram_join, "_in_blocks", lambda edges, *a: met.append(edges.selectExpr("explode(array(a, b)) node").distinct().count()) or in_blocks(edges, *a))
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 8)
    got = ngram_jaccard_components(h.documents(spark, rows).repartition(3)).collect()
    assert order(map(tuple, got)) == order(h.classes(rows))
    assert sum(met) < 100  # of 350 texts


@pytest.mark.parametrize("percent", [50, 60, 75])
def test_similar_sets_share_a_rare_element(spark, percent):
    r = random.Random(percent)
    sets = []
    for _ in range(25):
        base = r.sample(range(60), r.randint(1, 40))
        sets += [frozenset(x for x in base if r.random() > 0.1) | {r.randrange(90)} for _ in range(3)]
    sets = [*set(sets)]
    alone = [r.randint(0, len(s) // 5) for s in sets]
    rows = [(k, len(s) + a, sorted(s)) for k, (s, a) in enumerate(zip(sets, alone)) if 100 * len(s) >= percent * (len(s) + a)]
    got = {x.node: set(x.prefix) for x in ngram_join.rarest(spark.createDataFrame(rows, "node long, n int, shared array<bigint>"), percent).collect()}
    linked = 0
    for k, n, s in rows:
        for j, m, t in rows[:k]:
            common = len(set(s) & set(t))
            if j < k and 100 * common >= percent * (n + m - common):
                linked += 1
                assert got[k] & got[j]
    assert linked > 10


def most_rows(plan):
    """The most rows that an operator of an executed plan, its stages' plans included, has made."""
    made = plan.metrics().get("numOutputRows")
    inner = [plan.children().apply(i) for i in range(plan.children().size())]
    inner += [getattr(plan, k)() for k, kind in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if plan.getClass().getSimpleName().endswith(kind)]
    return max([made.get().value() if made.isDefined() else 0, *map(most_rows, inner)])


def test_rarest_elements_are_found_in_few_rows(spark):
    """They were found by a row for each element of each node."""
    sets = [sorted({0, *range(1000 * (k // 2) + 1, 1000 * (k // 2) + 201)}) for k in range(200)]  # pairs, and an element of all
    got = ngram_join.rarest(spark.createDataFrame([(k, len(s), s) for k, s in enumerate(sets)], "node long, n int, shared array<bigint>"), 75)
    assert {x.node: x.prefix for x in got.collect()} == {k: s[1:52] for k, s in enumerate(sets)}
    assert most_rows(got._jdf.queryExecution().executedPlan()) < 2000  # of 40200 elements


def test_elements_of_one_component_are_no_meeting_place(spark):
    rows = [(1, 4, [1, 2, 3, 4], 1), (2, 4, [1, 2, 3, 5], 1), (3, 4, [2, 3, 4, 6], 3), (4, 4, [7, 8, 9, 10], 4), (5, 4, [7, 8, 9, 10], 4), (6, 4, [], 6)]
    frame = spark.createDataFrame(rows, "node long, n int, shared array<bigint>, label long")
    # 2, 3 and 4 are of two labels, 4 of fewer nodes than 2 and 3; a set of 4 needs 3 in common with another
    assert {x.node: x.prefix for x in ngram_join.rarest(frame, 75).collect()} == {1: [4], 3: [4]}
    assert ngram_join.rarest(frame.where("label = 6"), 75).collect() == ngram_join.rarest(frame.where("label = 4"), 75).collect() == []


def test_known_entries_are_few_rows(spark, monkeypatch):
    """Shared shingles leave a bucket together; they were a row for each two buckets."""
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 300)), None, None, None) for i in range(200)]
    seen, keep = [], ngram_join.keep

    def counted(df, name):
        out = keep(df, name)
        if name == "shared-shingles":
            seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    monkeypatch.setattr(ngram_join, "bucket_count", lambda df: 40)
    got = ngram_jaccard_components(h.documents(spark, rows).repartition(5)).collect()
    assert order(map(tuple, got)) == order(h.classes(rows))
    assert seen[0] < 200  # 40 x 40


def test_signatures_are_shared_by_similar_sets():
    """Every pair at the threshold shares a signature, whatever its size."""
    r = np.random.default_rng(1)
    limits = ngram_join.band_limits(75, 4000)
    for _ in range(300):
        n = int(r.integers(1, 700))
        a = r.integers(1, 1 << 51, n)
        common = -(-3 * n // 4)
        extra = int(r.integers(0, max(1, (100 * common - 75 * n) // 75 + 1)))
        b = np.concatenate((a[:common], r.integers(1, 1 << 51, extra)))
        m = len(b)
        if 100 * common < 75 * (n + m - common):
            continue
        x, y = ngram_join.signatures(n, a, limits, 75), ngram_join.signatures(m, b, limits, 75)
        assert len(np.intersect1d(x, y))


def test_planes_round_trip():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (packed.unplanes(packed.planes(a), np.uint64) == a).all() and len(packed.unplanes(b"", np.int32)) == 0


def test_words_of_slices():
    import pyarrow as pa

    from tracelake.llm import words

    texts = pa.array([f"w{i} x y\tz {'v ' * (i % 7)}" for i in range(3000)])
    flat, offsets = words.split(texts.slice(1000, 500))
    assert np.diff(offsets).tolist() == [len(t.split()) for t in texts.slice(1000, 500).to_pylist()] and flat[0].as_py() == "w1000"
