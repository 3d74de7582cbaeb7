"""Column expressions for words and matches in whole texts, on the JVM side throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null.

    White space becomes single spaces first, so the split is on one plain character.
    """
    plain = F.regexp_replace(text_or_empty(text), r"[\t-\r]", " ")
    return F.array_remove(F.split(plain, " ", -1), "")


#: Elements that a fold builds one by one; longer arrays are built from blocks, so that their length costs no square.
BLOCK = 128
#: Code points of the pieces from which contexts are taken.
PIECE = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` calculated once, also where a lambda of ``body`` uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """All partial results of folding an array of whole numbers, each with its own element."""
    none = F.array().cast("array<int>")

    def prefixes(block: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = add(acc["now"], x)
            return F.struct(now.alias("now"), F.array_append(acc["out"], now).alias("out"))

        return F.aggregate(block, F.struct(first.alias("now"), none.alias("out")), step, lambda acc: acc["out"])

    zero = F.lit(start).cast("int")

    def by_blocks(a: Column) -> Column:
        count = F.ceil(F.size(a) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK)))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, zero, add))
        firsts = lambda bs: F.concat(F.array(zero), prefixes(F.slice(totals(bs), 1, F.greatest(F.size(bs) - 1, F.lit(0))), zero))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, firsts(bs), prefixes)))

    return let(values, lambda a: F.when(F.size(a) <= BLOCK, prefixes(a, zero)).otherwise(by_blocks(a)))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, value>>`` in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so positions are
    running sums of their lengths.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(values: Column) -> Column:
        lengths = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda gap, v: F.length(gap) + F.length(v))
        one = lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))
        return F.zip_with(values, running(lengths, lambda a, x: a + x), one)

    return let(found, lambda values: F.when(F.size(values) > 0, placed(values)).otherwise(none))


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def before(cut: Column, place: Column, length: int) -> Column:
    """The last ``length`` (at most ``PIECE``) code points before a place of the text whose ``pieces`` these are."""
    k, none = F.floor(place / PIECE).cast("int"), F.lit("")
    head = F.when(k > 0, F.get(cut, k - 1)).otherwise(none)
    near = F.concat(head, F.substring(F.coalesce(F.get(cut, k), none), F.lit(1), place % PIECE))
    return F.right(near, F.lit(length))


def after(cut: Column, place: Column, length: int) -> Column:
    """The first ``length`` (at most ``PIECE``) code points from a place on."""
    k, none = F.floor(place / PIECE).cast("int"), F.lit("")
    near = F.concat(F.coalesce(F.get(cut, k), none), F.coalesce(F.get(cut, k + 1), none))
    return F.substring(near, place % PIECE + 1, F.lit(length))


class Growing:
    """An array that a fold grows: full blocks apart, so an element costs a block and not the array."""

    def __init__(self, element: str):
        self.none, self.no_blocks = F.array().cast(f"array<{element}>"), F.array().cast(f"array<array<{element}>>")

    def start(self) -> list[Column]:
        return [self.no_blocks.alias("blocks"), self.none.alias("open")]

    def put(self, acc: Column, x: Column) -> list[Column]:
        """With ``x`` at the end; the last element before it stays open, so that it can be replaced."""
        full = F.size(acc["open"]) >= BLOCK
        blocks = F.when(full, F.array_append(acc["blocks"], F.slice(acc["open"], 1, BLOCK - 1))).otherwise(acc["blocks"])
        kept = F.when(full, F.slice(acc["open"], BLOCK, 1)).otherwise(acc["open"])
        return [blocks.alias("blocks"), F.array_append(kept, x).alias("open")]

    def replace(self, acc: Column, x: Column) -> list[Column]:
        """With ``x`` in place of the last element."""
        return [acc["blocks"].alias("blocks"), F.array_append(F.slice(acc["open"], 1, F.size(acc["open"]) - 1), x).alias("open")]

    def all(self, acc: Column) -> Column:
        return F.concat(F.flatten(acc["blocks"]), acc["open"])
