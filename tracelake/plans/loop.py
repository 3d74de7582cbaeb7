"""A bounded loop of generation and tool calls over sequences.

Each round is one Arrow pass over the active sequences: an injected generator continues
them, programs at their ends are run by an injected executor, and outputs are appended.
State is written to the shared folder after every round, so a lost executor repeats at most
one task and the plan stays short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import middle_cut
from ..functions.blocks import PROGRAM, notebook_program
from ..functions.tokens import Tokenizer
from ..sources.shared import keep
from .execute import arithmetic
from .ship import ship_package

Generate = Callable[[list[str]], list[tuple[str, float, int]]]
Execute = Callable[[str], tuple[str, str]]
STOP = "```\n"
FIELDS = "idx long, query string, logprob double, length long, rounds int, done boolean"


def _round(generate: Generate, execute: Execute, last: bool, notice: str, most_length: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for (_, row), (text, logprob, length) in zip(part.iterrows(), generate(part["query"].tolist())):
                query, total = row["query"] + text, row["length"] + length
                done = last or not text.endswith(STOP)
                if not done:
                    result, report = execute(notebook_program(query))
                    appended = query + f"```output\n{middle_cut(result or report)}\n```\n" + notice
                    if most_length is not None and len(appended) > most_length:
                        done = True  # over-length: the output is dropped
                    else:
                        query = appended
                rows.append((row["idx"], query, row["logprob"] + logprob, total, row["rounds"] + 1, done))
            yield pd.DataFrame(rows, columns=["idx", "query", "logprob", "length", "rounds", "done"])

    return run


def generate_with_tools(prompts: DataFrame, generate: Generate, execute: Execute = arithmetic, most_rounds: int = 4, most_length: int | None = None, notice: str = "The budget of tool calls is used up.\n") -> DataFrame:
    """``(idx, query)`` -> final transcripts with log-probability, length and rounds.

    The second-to-last round tells sequences that no call is left; the last one ends all.
    """
    spark = prompts.sparkSession
    ship_package(spark)
    active = prompts.select(F.col("idx").cast("long").alias("idx"), "query", F.lit(0.0).alias("logprob"), F.lit(0).cast("long").alias("length"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    finished = None
    for r in range(most_rounds):
        step = _round(generate, execute, r == most_rounds - 1, notice if r == most_rounds - 2 else "", most_length)
        after = keep(active.mapInPandas(step, FIELDS), "loop")
        over = after.where("done")
        finished = over if finished is None else finished.unionByName(over)
        active = after.where("not done")
        if active.isEmpty():
            break
    return finished.drop("done")


def regrouped(samples: DataFrame, n: int) -> DataFrame:
    """``n`` consecutive samples as one ordered array a problem."""
    item = F.struct("idx", "query", "logprob", "length")
    g = samples.groupBy(F.floor(F.col("idx") / n).cast("long").alias("problem_id")).agg(F.sort_array(F.collect_list(item)).alias("s"))

    def field(name: str):
        return F.transform("s", lambda x: x[name]).alias(name)

    return g.select("problem_id", *map(field, ("query", "logprob", "length")))


@dataclass
class Reply:
    """Ids that a generator gave, and whether it ended by itself."""

    ids: list[int]
    ended: bool = False


#: A generator of token ids: prompts with all that followed, and how many ids each may still have.
GenerateIds = Callable[[list[list[int]], list[int]], list[Reply]]
NOTICE = "The budget of tool calls is used up.\n"
STATE = "idx long, sample int, prompt array<int>, ids array<int>, own array<int>, rounds int, ended string"


def _budget_round(generate: GenerateIds, tokenizer: Tokenizer, execute: Execute, limit: int, last: bool, notice: str, stop: str, rows_at_once: int):
    def step(rows: list[dict]) -> None:
        asked = [limit - len(r["ids"]) for r in rows]
        for r, budget, reply in zip(rows, asked, generate([r["prompt"] + r["ids"] for r in rows], asked)):
            new = reply.ids[:budget]
            r["ids"], r["own"], r["rounds"] = r["ids"] + new, r["own"] + [1] * len(new), r["rounds"] + 1
            text = tokenizer.decode(new)
            if len(new) < len(reply.ids) or len(r["ids"]) >= limit:
                r["ended"] = "budget"
            elif reply.ended or not text.endswith(stop):
                r["ended"] = "stop"
            elif last:
                r["ended"] = "rounds"
            else:
                program = notebook_program(tokenizer.decode(r["ids"])) if PROGRAM in text else ""
                result, report = execute(program)
                # only what is appended is encoded; what there was before keeps its ids
                output = [] if report == "empty code" else tokenizer.encode(f"```output\n{result or report}{notice}\n```\n")
                if len(r["ids"]) + len(output) >= limit:
                    r["ended"] = "output"  # no room for it: dropped, and nothing follows
                else:
                    r["ids"], r["own"] = r["ids"] + output, r["own"] + [0] * len(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(at, rows_at_once).to_pylist()
                step(rows)
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


def rollout(prompts: DataFrame, generate: GenerateIds, tokenizer: Tokenizer, limit: int, execute: Execute = arithmetic, samples: int = 1, most_rounds: int = 7, notice: str = NOTICE, stop: str = "`\n", rows_at_once: int = 256) -> DataFrame:
    """Samples with tool calls under a budget of tokens: ``idx, sample, response, ids, own, rounds, ended``.

    ``prompts`` has ``idx`` and ``query``.  ``ids`` are the response's tokens, at most ``limit``;
    ``own`` is 1 on those that the generator gave, 0 on outputs.  Each round every active
    sequence is continued within what is left of its budget; a reply that ends with ``stop``
    calls a tool, whose output is encoded alone and appended.  ``ended`` says why a sequence
    is over: ``stop`` (a reply without a call), ``budget`` (the reply was cut at the limit),
    ``output`` (an output that leaves no token was dropped), ``rounds``.  The round before the
    last one puts ``notice`` into its outputs.  A null query is an empty one.

    A round is one pass over the active sequences only; its state is written, and the active
    rows of the round before are read once, so the plan stays short and a lost executor
    repeats one task.
    """
    spark = prompts.sparkSession
    ship_package(spark)
    encode = F.udf(lambda q: tokenizer.encode(q or ""), "array<int>", useArrow=True)
    empty = F.array().cast("array<int>")
    start = prompts.select(F.col("idx").cast("long").alias("idx"), encode(F.col("query").cast("string")).alias("prompt"))
    active = start.select("idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), "prompt", empty.alias("ids"), empty.alias("own"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("ended"))
    finished = None
    for r in range(most_rounds):
        step = _budget_round(generate, tokenizer, execute, limit, r == most_rounds - 1, notice if r == most_rounds - 2 else "", stop, rows_at_once)
        after = keep(active.mapInArrow(step, STATE), "rollout")
        over = after.where("ended IS NOT NULL").drop("prompt")
        finished = over if finished is None else finished.unionByName(over)
        active = after.where("ended IS NULL")
        if active.isEmpty():
            break
    decode = F.udf(lambda ids: tokenizer.decode(ids), "string", useArrow=True)
    return finished.select("idx", "sample", decode("ids").alias("response"), "ids", "own", "rounds", "ended")
