"""Rewards of whole solutions, and their routing by data source."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers, blocks

PENALTY = 0.1


def judge_shift(verdict: str | None) -> float:
    """A judge's boxed 0, 1 or 2 as -0.1, 0 or 0.1; anything else 0."""
    got = answers.boxed_answer(verdict)
    try:
        return {0.0: -PENALTY, 2.0: PENALTY}.get(float(got), 0.0) if got is not None else 0.0
    except ValueError:
        return 0.0


def is_right(solution: str | None, truths: list[str] | None) -> bool:
    """Whether the answer after the thoughts equals any of the truths; both thought tags are needed."""
    if not solution or "<think>" not in solution or "</think>" not in solution:
        return False
    given = answers.boxed_answer(answers.between_thoughts(solution))
    accepted = [answers.boxed_answer(t) if "\\boxed" in t else t for t in map(str, truths or [])]
    return given is not None and any(t is not None and (answers.same_competition_answer(given, t) or answers.same_expression(given, t)) for t in accepted)


def tool_reward(solution: str | None, truths: list[str] | None, with_code: bool = True, verdict: str | None = None, with_judge: bool = False) -> float:
    """1 for a right answer, else 0, shifted by -0.1 if no program ran well and by a judge's verdict."""
    shift = -PENALTY if with_code and blocks.only_errors(solution) else 0.0
    return float(is_right(solution, truths)) + shift + (judge_shift(verdict) if with_judge else 0.0)


def lenient_boxed(text: str) -> str | None:
    r"""The last boxed part, also written ``\boxed answer`` up to a dollar sign, or ``\fbox{...}`` (which is then refused)."""
    if "\\boxed " in text:
        return text.split("\\boxed ")[-1].split("$")[0]
    return answers.boxed_answer(text)


def competition_score(solution: str | None, truth: str | None) -> float:
    """Score of the plain competition grader: equal normal forms, or equal texts where one can't be formed."""
    given = lenient_boxed(solution or "")
    if given is None or truth is None:
        return 0.0

    def form(text: str) -> str:
        out = answers._competition(text)
        if (m := re.fullmatch(r"([^/]*)/([^/]*)", out)) and not all(re.fullmatch(r"\s*[+-]?\d+\s*", x) for x in m.groups()):
            raise answers.Unreadable(text)
        return out

    try:
        return float(form(given) == form(truth))
    except answers.Unreadable:
        return float(given == truth)


Reward = Callable[[str, str], float]


def scored(df: DataFrame, table: dict[str, Reward], source: str = "data_source", solution: str = "solution", truth: str = "ground_truth", ready: str = "rm_score", out: str = "score") -> DataFrame:
    """Scores by the reward of each row's source prefix; rows that carry a model's score keep it, unknown sources fail."""
    from ..plans.ship import ship_package

    ship_package(df.sparkSession)
    score = F.col(ready) if ready in df.columns else F.lit(None).cast("double")
    known = F.lit(None).cast("int")
    for i, prefix in reversed(list(enumerate(table))):  # the first prefix that fits
        known = F.when(F.col(source).startswith(prefix), i).otherwise(known)
    chosen = list(table.values())
    # one function for all: Spark runs a Python function on every row, whatever condition stands around it
    graded = answers.apply(lambda i, s, t: None if i is None else float(chosen[int(i)](s, t)), "double")(F.when(score.isNull(), known), F.col(solution), F.col(truth))
    return df.withColumn(out, F.when(score.isNotNull(), score).when(known.isNotNull(), graded).otherwise(F.raise_error(F.lit("no reward for this source")).cast("double")))


def masked_outputs(text: str, mask: list[int], encode: Callable[[str], list[int]]) -> list[int]:
    """The response mask with tool outputs zeroed; token places come from encoding the text before each block."""
    out = list(mask)
    for m in re.finditer(r"```output([\s\S]*?)```\n", text):
        first = len(encode(text[: m.start()]))
        last = first + len(encode(m[0]))
        out[first:last] = [0] * len(out[first:last])
    return out


class PatternTokenizer:
    """A deterministic tokenizer for tests and default lengths: words, numbers and signs, ids by order of appearance."""

    pattern = re.compile(r"\s*(?:[A-Za-z]+|\d|[^\sA-Za-z\d])|\s+")

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.texts: list[str] = []

    def encode(self, text: str) -> list[int]:
        out = []
        for t in self.pattern.findall(text):
            if t not in self.ids:
                self.ids[t] = len(self.texts)
                self.texts.append(t)
            out.append(self.ids[t])
        return out

    def decode(self, ids: list[int]) -> str:
        return "".join(self.texts[i] for i in ids)


def token_count(text: Column) -> Column:
    """Tokens of the default tokenizer, on the JVM side."""
    return F.regexp_count(text, F.lit(r"\s*(?:[A-Za-z]+|\d|[^\sA-Za-z\d])|\s+"))
