"""The pipeline's stages on planted rows, and run() over the smallest tables."""

import corpus_pipeline
from tracelake.llm.storage import keep

from . import helpers as h


def test_stages(spark):
    rows = h.corpus() + [(1, "again", None, None, None), (None, "null id words " + " ".join(f"n{i}" for i in range(30)), None, "s1", 9)]
    docs = h.documents(spark, rows, clashing=True)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "pii", "mix_to_weights", "bpe_encode_decode"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = keep(out, name)
        kept[name] = docs.collect()
    ids = lambda n: [r.doc_id for r in kept[n]]
    assert all(len(h.words(r.text)) >= 20 for r in kept[names[0]]) and None in ids(names[0])
    survivors = [(r.doc_id, r.text) for r in kept[names[0]]]
    assert sorted(map(str, ids(names[1]))) == sorted(str(i) for i, _, c in h.classes(survivors) if i == c)
    assert sorted(map(str, ids(names[2]))) == sorted(map(str, ids(names[1])))
    assert all(r.n_chars == len(r.text) for r in kept[names[2]]) and not any("a.b@c.org" in r.text for r in kept[names[2]])
    assert set(ids(names[3])) <= set(ids(names[2])) and max(ids(names[3]).count(i) for i in set(ids(names[3]))) <= 2
    assert sorted(map(str, ids(names[4]))) == sorted(map(str, ids(names[3]))) and all(r.n_tokens == len(r.ids) for r in kept[names[4]])


def test_near_duplicates_with_repeated_and_null_ids(spark):
    words = lambda n, at: [f"{n}{k}" for k in range(at, at + 60)]
    text = lambda n, last="end": " ".join([*words(n, 0), last])
    rows = [(3, text("a")), (7, text("b")), (7, text("a")), (8, text("c")), (8, text("c", "other")), (None, text("d")), (None, text("d", "other")), (None, text("a")), (9, text("e")), (9, text("e")), (None, text("f")), (4, None), (5, None)]
    out = corpus_pipeline.near_duplicates(spark, h.documents(spark, [(i, t, None, None, None) for i, t in rows]), "").collect()
    got = sorted(((r.doc_id, (r.text or "-")[0]) for r in out), key=str)
    assert got == sorted([(3, "a"), (7, "b"), (8, "c"), (None, "d"), (9, "e"), (None, "f"), (4, "-"), (5, "-")], key=str)


def test_empty(spark):
    docs = h.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
