"""Tokenizers as objects that travel to tasks, and token masks from character spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..plans.ship import ship_package

#: An output block with its closing fence and line end.
OUTPUT_BLOCK = re.compile(r"```output([\s\S]*?)```\n")


class Tokenizer(Protocol):
    """Ids of a text and back, and the places of its tokens; without state that differs from task to task."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...

    def spans(self, text: str) -> list[tuple[int, int]]: ...


class CodePoints:
    """A token a character."""

    def encode(self, text: str) -> list[int]:
        return [*map(ord, text)]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [(k, k + 1) for k in range(len(text))]


class Words:
    """Words, digits and signs, each with the white space before it; ids are those of a given list of texts, then code points."""

    pattern = re.compile(r"\s*(?:[A-Za-z]+|\d|[^\sA-Za-z\d])|\s+")

    def __init__(self, known: list[str] = ()):
        self.texts = [*known]
        self.ids = {t: k for k, t in enumerate(self.texts)}

    def encode(self, text: str) -> list[int]:
        out = []
        for t in self.pattern.findall(text):
            out += [self.ids[t]] if t in self.ids else [len(self.texts) + ord(c) for c in t]
        return out

    def decode(self, ids: list[int]) -> str:
        n = len(self.texts)
        return "".join(self.texts[i] if i < n else chr(i - n) for i in ids)

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in self.pattern.finditer(text):
            out += [m.span()] if m[0] in self.ids else [(k, k + 1) for k in range(*m.span())]
        return out


class Pieces:
    """``Words`` without ids: each match is one token, for counts and masks."""

    pattern = Words.pattern

    def encode(self, text: str) -> list[int]:
        return [0] * len(self.pattern.findall(text))

    def decode(self, ids: list[int]) -> str:
        raise NotImplementedError("these tokens have no ids")

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]


class FromFile:
    """A tokenizer of the ``tokenizers`` library by its file, which every executor must see; loaded once a worker."""

    _loaded: dict = {}

    def __init__(self, path: str):
        self.path = path

    @property
    def library(self):
        if self.path not in self._loaded:
            from tokenizers import Tokenizer as Library

            self._loaded[self.path] = Library.from_file(self.path)
        return self._loaded[self.path]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.library.encode(text, add_special_tokens=False).offsets


def span_tokens(text: str, spans: list[tuple[int, int]], tokenizer: Tokenizer) -> np.ndarray:
    """For each character span, the place of its first token and of the first one after it.

    These are the tokens of the text before the span, and with those of the span itself, as if
    each were encoded alone.  The whole text is encoded once; only a token that a border cuts
    is encoded again, in its two parts.  Bounds and tokens are merged in sorted order, so the
    work grows with the text and not with text times spans.
    """
    places = np.array(tokenizer.spans(text), np.int64).reshape(-1, 2)
    starts, ends = places[:, 0], places[:, 1]
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    whole = np.searchsorted(ends, bounds, side="right")  # tokens that end before the bound
    cut = (whole < len(ends)) & (np.append(starts, len(text))[whole] < bounds)

    def part(a: int, b: int) -> int:
        return len(tokenizer.encode(text[a:b])) if a < b else 0

    out = np.zeros_like(bounds)
    for k, (a, b) in enumerate(bounds.tolist()):
        i, j = whole[k].tolist()
        out[k, 0] = i + (part(int(starts[i]), a) if cut[k, 0] else 0)
        if cut[k, 0] and i == j:  # both in one token
            inside = part(a, b)
        else:
            inside = j - i - bool(cut[k, 0]) + (part(a, int(ends[i])) if cut[k, 0] else 0) + (part(int(starts[j]), b) if cut[k, 1] else 0)
        out[k, 1] = out[k, 0] + inside
    return out


def mask_spans(mask: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The mask with zeros from each first to each last place."""
    change = np.zeros(len(mask) + 1, np.int64)
    np.add.at(change, np.minimum(tokens[:, 0], len(mask)), 1)
    np.add.at(change, np.minimum(tokens[:, 1], len(mask)), -1)
    return np.where(np.cumsum(change[:-1]) > 0, 0, mask)


def with_output_mask(df: DataFrame, text: str, tokenizer: Tokenizer, mask: str | None = None, out: str = "response_mask") -> DataFrame:
    """``df`` with a mask of the text's tokens, 0 on those of tool outputs.

    Starts from the column ``mask`` (an array, padded or cut as it is), or from ones.  A null
    text has an empty mask, or the given one.  Rows stay in place; no shuffle.
    """
    ship_package(df.sparkSession)
    names = df.columns
    at, given = names.index(text), names.index(mask) if mask else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, t in enumerate(b.column(at).to_pylist()):
                own = b.column(given)[k].as_py() if given is not None else None
                spans = [m.span() for m in OUTPUT_BLOCK.finditer(t or "")]
                start = np.array(own, np.int64) if own is not None else np.ones(len(tokenizer.spans(t)) if t else 0, np.int64)
                found.append(mask_spans(start, span_tokens(t, spans, tokenizer)) if spans else start)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))]))
