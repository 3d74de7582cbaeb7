"""A loop with a token budget against a hand trace, token masks against the row function, metrics against numpy."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.functions import rewards, tokens
from tracelake.operators import evaluation
from tracelake.plans import loop
from tracelake.plans.loop import Reply

TOKENIZER = tokens.CodePoints()
CALL = "\n```python\nprint({})\n```\n"


def replies(script):
    """A generator that reads from the prompt's number and the calls so far what to say."""

    def generate(asked, budgets):
        out = []
        for ids in asked:
            text = TOKENIZER.decode(ids)
            say = script[text[:2]][text.count("```output")]
            out.append(Reply(TOKENIZER.encode(say)))
        return out

    return generate


def test_budget_by_hand(spark):
    call, output = CALL.format(7), "```output\n7\n```\n"
    n, m = len(call), len(output)
    script = {
        "q0": [call, "seven"],  # a call, then an answer
        "q1": ["x" * 100],  # the first reply is longer than the budget
        "q2": ["y" * (100 - n - m) + call, "never asked"],  # the output would leave no token
        "q3": [call, "z" * 100],  # the second reply is cut
        "q4": ["no call`", "never asked"],
        "q5": ["`\n", "never asked"],  # a call without a program: nothing is appended
        "q6": ["y" * (99 - n - m) + call, "zz"],  # the output leaves one token
    }
    script["q5"] = ["`\n"] * 3
    rows = [(k, f"q{k}") for k in range(7)]
    df = spark.createDataFrame(rows, "idx long, query string").repartition(2)
    got = {r.idx: r for r in loop.rollout(df, replies(script), TOKENIZER, 100, most_rounds=4).collect()}
    want = {
        0: (call + output + "seven", 2, "stop"), 1: ("x" * 100, 1, "budget"), 2: ("y" * (100 - n - m) + call, 1, "output"), 3: ((call + output + "z" * 100)[:100], 2, "budget"),
        4: ("no call`", 1, "stop"), 5: ("`\n" * 4, 4, "rounds"), 6: ("y" * (99 - n - m) + call + output + "z", 2, "budget"),
    }
    assert {k: (r.response, r.rounds, r.ended) for k, r in got.items()} == want
    for k, r in got.items():
        assert TOKENIZER.decode(r.ids) == r.response and len(r.ids) == len(r.own) <= 100
        shown = output if output in r.response else ""
        assert r.own.count(0) == len(shown) and "".join(c for c, o in zip(r.response, r.own) if not o) == shown


def test_notice_samples_and_nothing(spark):
    script = {"q0": [CALL.format(k) for k in range(9)]}
    df = spark.createDataFrame([(0, "q0")], "idx long, query string")
    got = loop.rollout(df, replies(script), TOKENIZER, 10_000, samples=3, most_rounds=3).collect()
    assert sorted(r.sample for r in got) == [0, 1, 2] and {r.ended for r in got} == {"rounds"}
    assert all(r.response.count("```output") == 2 and r.response.count("used up") == 1 and r.response.index("used up") > r.response.index("0\n```\n") for r in got)
    assert loop.rollout(df.limit(0), replies(script), TOKENIZER, 10).count() == 0


def test_words_travel():
    t = tokens.Words(["run", " it", "\n"])
    text = "run it\nnow é"
    assert t.decode(t.encode(text)) == text and t.encode("run it")[:2] == [0, 1] and len(t.spans(text)) == len(t.encode(text))


PARTS = ["```output", "```\n", "```", "\n", " ", "word", "12", "é", "  x", "output", "\n\n", "a-b"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=500, deadline=None)
def test_masks_equal_the_row_function(text):
    for t in (tokens.Pieces(), tokens.CodePoints(), tokens.Words(["word", "\n", "```"[:1]])):
        start = [1] * len(t.encode(text))
        spans = [m.span() for m in tokens.OUTPUT_BLOCK.finditer(text)]
        got = tokens.mask_spans(np.array(start, np.int64), tokens.span_tokens(text, spans, t)).tolist()
        assert got == rewards.masked_outputs(text, start, t.encode)


def test_mask_column(spark):
    r = random.Random(3)
    rows = [(k, None if k == 5 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 40))), [1] * r.randint(0, 60)) for k in range(80)]
    df = spark.createDataFrame(rows, "k long, t string, m array<int>").repartition(3)
    t = tokens.Pieces()
    for x in tokens.with_output_mask(df, "t", t, mask="m").collect():
        assert x.response_mask == rewards.masked_outputs(x.t or "", x.m, t.encode)
    for x in tokens.with_output_mask(df, "t", t, out="own").collect():
        assert x.own == rewards.masked_outputs(x.t or "", [1] * len(t.encode(x.t or "")), t.encode)


def test_masks_are_linear_in_the_text():
    import time

    def seconds(n: int) -> float:
        text = "word ```output\n1\n```\n" * n
        start = time.perf_counter()
        spans = [m.span() for m in tokens.OUTPUT_BLOCK.finditer(text)]
        tokens.span_tokens(text, spans, tokens.Pieces())
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000)


def test_data_metrics(spark):
    r = random.Random(5)
    rows = []
    for _ in range(60):
        n = r.randint(0, 9)
        arrays = [[r.uniform(-2, 2) for _ in range(9)] for _ in range(5)]
        rows.append((*arrays, [int(k < n) for k in range(9)], r.randint(1, 6)))
    names = ("token_level_scores", "token_level_rewards", "advantages", "returns", "values", "response_mask", "prompt_length")
    df = spark.createDataFrame(rows, ", ".join(f"{n} array<double>" for n in names[:5]) + ", response_mask array<int>, prompt_length int").repartition(4)
    got = evaluation.data_metrics(df, 9, 6, values="values").first().asDict()
    table = {n: np.array([x[k] for x in rows]) for k, n in enumerate(names)}
    mask = table["response_mask"] == 1
    want = {}
    for name, x in (("score", table["token_level_scores"].sum(1)), ("reward", table["token_level_rewards"].sum(1)), ("response_length", mask.sum(1)), ("prompt_length", table["prompt_length"]), *((n, table[n][mask]) for n in ("advantages", "returns", "values"))):
        want |= {f"{name}_mean": x.mean(), f"{name}_max": x.max(), f"{name}_min": x.min()}
    want |= {"response_length_clip_ratio": (mask.sum(1) == 9).mean(), "prompt_length_clip_ratio": (table["prompt_length"] == 6).mean()}
    own, rest = table["returns"][mask], (table["returns"] - table["values"])[mask]
    want["vf_explained_var"] = 1 - rest.var(ddof=1) / (own.var(ddof=1) + 1e-5)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    plan = evaluation.data_metrics(df, 9, 6, values="values")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    none = evaluation.data_metrics(df.limit(0), 9, 6, values="values").first()
    assert none.advantages_mean is None and none.vf_explained_var is None
    assert "values_mean" not in evaluation.data_metrics(df, 9, 6).columns


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizer_of_a_file(name):
    public = pytest.importorskip("public_tokenizers")
    t = tokens.FromFile(public.path(name))
    text = "so\n```output\n12 34\n```\nand more words"
    ids, spans = t.encode(text), t.spans(text)
    found = tokens.span_tokens(text, [m.span() for m in tokens.OUTPUT_BLOCK.finditer(text)], t)
    assert len(ids) == len(spans) and found.shape == (1, 2) and 0 < found[0, 0] < found[0, 1] < len(ids)
