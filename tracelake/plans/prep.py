"""Raw question sets to training rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, token_math
from ..operators import batch
from .ship import ship_package


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def training_row(source: Column, question: Column, instruction: str, ability: str, truth: Column, split: str, index: Column, answer: Column | None = None, style: str = "rule") -> list[Column]:
    """The five columns of a training row."""
    none = F.lit(None).cast("string")
    return [
        source.alias("data_source"),
        F.array(message("user", F.concat_ws(" ", question, F.lit(instruction)) if instruction else question)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.cast("long").alias("index"), (answer if answer is not None else none).alias("answer"), question.alias("question")).alias("extra_info"),
    ]


def arithmetic_rows(df: DataFrame, split: str, instruction: str, key: str = "row_id", source: str = "gsm8k") -> DataFrame:
    """``question, answer`` with a ``####`` number -> training rows; a missing number fails the query."""
    truth = F.regexp_replace(F.regexp_extract("answer", r"#### (\-?[0-9\.\,]+)", 1), ",", "")
    truth = F.when(truth == "", F.raise_error(F.lit("answer without number")).cast("string")).otherwise(truth)
    return df.select(*training_row(F.lit(source), F.col("question"), instruction, "math", truth, split, F.col(key), F.col("answer")))


def competition_rows(df: DataFrame, split: str, instruction: str, key: str = "row_id", source: str = "math") -> DataFrame:
    """``problem, solution`` -> training rows; the truth is the last boxed part of the solution."""
    from .ship import ship_package

    ship_package(df.sparkSession)
    boxed = answers.apply(answers.boxed_answer)
    return df.select(*training_row(F.lit(source), F.col("problem"), instruction, "math", boxed(F.col("solution")), split, F.col(key), F.col("solution")))


def completion_rows(df: DataFrame, split: str, source: str = "hellaswag") -> DataFrame:
    """Sentence completions: rows without a label go first, then rows are numbered."""
    d = batch.numbered(df.where(F.length("label") > 0), [F.col("row_id")], out="index")
    context = F.concat(F.col("ctx_a"), F.lit(" "), answers.capitalised(F.col("ctx_b")))
    query = answers.tidy_title(F.concat(F.col("activity_label"), F.lit(": "), context))
    return d.select(
        F.lit(source).alias("data_source"), F.array(message("user", query)).alias("prompt"), F.lit("nlp").alias("ability"),
        F.struct(F.lit("model").alias("style"), F.col("label").alias("ground_truth"), F.lit("multiple_choice").alias("eval"), F.transform("endings", answers.tidy_title).alias("choices")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("index")).alias("extra_info"),
    )


def preference_sft(df: DataFrame) -> DataFrame:
    """``prompt, chosen, rejected`` -> two ``prompt, response`` rows, the chosen one first."""
    return batch.unpivot_pair(df, "chosen", "rejected").select("row_id", "place", "prompt", "response")


def preference_split(df: DataFrame, share: float = 0.75, key: str = "row_id") -> DataFrame:
    """Preference pairs marked ``train`` or ``test`` by position."""
    total = df.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(total)).withColumn("split", F.when(batch.positional_split(df, share, F.col("_n"), key), "train").otherwise("test")).drop("_n")


def reward_split(df: DataFrame, share: float = 0.75, key: str = "row_id") -> DataFrame:
    """Leading rows as ``train``, trailing ones as ``test``.

    The two boundaries are rounded to the closest row each on its own, halves to the even
    one, so a row may be in both parts or in none.
    """
    total = df.agg(F.count("*").alias("_n"))
    head, tail = F.bround(F.col("_n") * F.lit(share)), F.bround(F.col("_n") * F.lit(1 - share))
    parts = F.array(F.when(F.col(key) < head, "train"), F.when(F.col(key) >= F.col("_n") - tail, "test"))
    return df.crossJoin(F.broadcast(total)).withColumn("split", F.explode(F.array_compact(parts))).drop("_n")


def prompts(question: Column, kind: Column, templates: dict[str, str], place: str = "{question}") -> Column:
    """Each question in the template of its row's kind; a kind without one is an error."""
    out = None
    for name, template in templates.items():
        text = F.replace(F.lit(template), F.lit(place), question)
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise(F.raise_error(F.lit("no template for this kind")).cast("string"))


def without_pad(texts: Column, pad: str) -> Column:
    """Texts without a tokenizer's pad token, of an array one a line."""
    return F.replace(F.concat_ws("\n", texts), F.lit(pad), F.lit(""))


def rendered_again(df: DataFrame, ids: str, chat: str, decode: Callable[[list[int]], str], render: Callable[[list[dict]], list[int]], length: int, pad: int, end: str = "") -> DataFrame:
    """Each chat with its response as the assistant's turn, in another tokenizer's ids: ``input_ids, attention_mask``.

    ``ids`` are decoded by the first tokenizer and lose ``end``; ``render`` gives the whole
    chat's ids in the second, which are cut and padded at the right to ``length``.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("array<bigint>")
    def again(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for answers_, asked in batches:
            out = []
            for response, turns in zip(answers_, asked):
                text = decode([] if response is None else list(response)).removesuffix(end)
                out.append(render([*([] if turns is None else map(dict, turns)), {"role": "assistant", "content": text}])[:length])
            yield pd.Series(out, dtype=object)

    found = df.withColumn("_ids", again(F.col(ids), F.col(chat)))
    mask = token_math.pad_to(F.transform("_ids", lambda _: F.lit(1)), length, 0)
    return found.withColumns({"input_ids": token_math.pad_to(F.col("_ids"), length, pad), "attention_mask": mask}).drop("_ids")


def chats(turns: DataFrame, chat: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns as one ordered array of messages a chat."""
    item = F.struct(F.col(order).alias("o"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return turns.groupBy(chat).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("prompt"))


def routed(source: Column, table: dict[str, str], default: str | None) -> Column:
    """The reward function's name for a data source by prefix; without a default unknown sources are an error."""
    out = None
    for prefix, name in table.items():
        out = F.when(source.startswith(prefix), name) if out is None else out.when(source.startswith(prefix), name)
    return out.otherwise(F.lit(default) if default is not None else F.raise_error(F.lit("no reward for this source")).cast("string"))


def question_text(df: DataFrame, columns: tuple[str, ...] = ("question", "problem", "Question", "input")) -> Column:
    """The first question column that a data set has."""
    return F.coalesce(*(F.col(c) for c in columns if c in df.columns))


#: Where each kind of set keeps its reasoning and its answer.
TRUTH_COLUMNS = {"gsm-hard": ("code", "target"), "svamp": ("Equation", "Answer"), "asdiv": ("formula", "answer"), "mawps": (None, "target"), "bbh": (None, "target"), "tabmwp": ("solution", "answer"), "math": ("solution", None), "ocw": ("solution", None)}


def ground_truth(row: dict, kind: str) -> tuple[str, str]:
    """``(reasoning, answer)`` of a raw row of a known kind of set."""
    if "gt_cot" in row:
        return row["gt_cot"], answers.plain_answer(row["gt"])
    if kind == "gsm8k":
        reasoning, answer = row["answer"].split("####")
    elif kind in TRUTH_COLUMNS:
        at, of = TRUTH_COLUMNS[kind]
        reasoning = row[at] if at else None
        answer = row[of] if of else answers.final_answer(reasoning)
    else:
        raise NotImplementedError(kind)
    if kind == "asdiv":
        answer = re.sub(r"\(.*?\)", "", answer)
    if kind == "tabmwp" and row["ans_type"] in ("integer_number", "decimal_number"):
        answer = _table_number(answer)
    return str(reasoning).strip(), answers.plain_answer(answer)


def _table_number(text: str) -> float:
    if "/" in text:
        a, b = text.split("/")[:2]
        return int(a) / int(b)
    if "," not in text and "%" in text:
        return float(text.split("%")[0]) / 100
    return float(text.replace(",", ""))


def question(row: dict, kind: str) -> str:
    """The question of a raw row of a known kind of set; an error if it has none.  The sentences are fixed values."""
    if kind == "asdiv":
        out = f"{row['body'].strip()} {row['question'].strip()}"
    elif kind == "svamp":
        body = row["Body"].strip()
        out = f"{body if body.endswith('.') else body + '.'} {row['Question'].strip()}"
    elif kind == "tabmwp":
        title = f'regarding "{row["table_title"]}" ' if row["table_title"] else ""
        options = f" Please select from the following options: {row['choices']}" if row["choices"] else ""
        out = f"Read the following table {title}and answer a question:\n{row['table']}\n{row['question']}{options}"
    else:
        out = next((row[k] for k in ("question", "problem", "Question", "input") if k in row), "")
    if not out:
        raise ValueError("no question")
    return out.strip()
