"""How filters interact: what each removes in every order, by part of the corpus.

Method (sort-based duplicates).  Rows are dealt by ranges of (text fingerprint, doc_id) and
sorted by (fingerprint, full text, doc_id) in each range, so copies are neighbours and a row
is a copy if its predecessor has its text and a smaller id, or is itself a copy.  The ranges'
samples hold no texts, and a group of copies of any size is spread over several ranges by id.
Where a fingerprint goes on over a range's border, rows with the range's smallest id of their
text are left open, under the text's digest; a range also tells the smallest id of each text
of its last fingerprint, and these settle the open rows afterwards.  Both are a few rows a range.

What remains of a row is a mask of the filters that it fails.  Masks are counted by part,
with the labels' counts; counters of disjoint rows are added.  All numbers of all orders
follow from the 32 counters of a part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship_package
from . import words
from .storage import bucket_count, discard, keep

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
RANGE_BYTES = 16 << 20  # of input for each range
_symbol = np.zeros(256, bool)
_symbol[list(b"#$%&*|")] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True


def text_masks(texts: pa.Array, least_words: int = 200) -> np.ndarray:
    """The mask of filters A to D for each text."""
    flat, offsets = words.split(texts)
    n, counts = len(texts), np.diff(offsets)
    codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    base = int(codes.max()) + 1 if len(codes) else 1
    keys = np.unique(np.repeat(np.arange(n), counts) * base + codes)
    distinct = np.bincount(keys // base, minlength=n)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]

    def held(kinds: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kinds[raw]), at))

    capitals, symbols = held(_capital), held(_symbol)
    points = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    fails = [counts < least_words, 100 * distinct < 50 * counts, 100 * capitals > 3 * points, symbols > 0]
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


def _digest(fp: int, text: str) -> str:
    return f"{fp & 0xFFFFFFFFFFFFFFFF:016x}{hashlib.sha256(text.encode()).hexdigest()}"


def _masks_of_range(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one range in order, and the smallest id of each text of its last fingerprint.

        Of the range's first fingerprint, the rows with the smallest id of their text are left
        open (``edge``): a range before may have a smaller one.  All other verdicts are final,
        as ids ascend from range to range.
        """
        first = fp = text = low = None
        mask, lows = 0, {}  # of the last row's run of equal texts; smallest ids of the texts of the last row's fingerprint
        for whole in batches:
            for batch in words.text_batches(iter([whole])):
                n = batch.num_rows
                if not n:
                    continue
                null, own, fps = np.asarray(pc.is_null(batch.column(0))), np.asarray(pc.fill_null(batch.column(0), 0)), np.asarray(batch.column(2))
                texts = batch.column(3).cast(pa.large_string())
                same = np.zeros(n, bool)  # as the predecessor
                near = np.flatnonzero(fps[1:] == fps[:-1])
                same[near + 1] = np.asarray(pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near + 1))))
                same[0] = fp is not None and fps[0] == fp and texts[0].as_py() == text
                heads, of = np.flatnonzero(~same), np.cumsum(~same)
                masks = np.append([mask], text_masks(texts.take(pa.array(heads)), least_words) if len(heads) else [])[of].astype(np.int64)
                # ids ascend in a run, null ones last: its head has the smallest
                run_null, run_low = np.append([low is None], null[heads])[of], np.append([low or 0], own[heads])[of]
                is_low = np.where(run_null, null, ~null & (own == run_low))
                first = int(fps[0]) if first is None else first
                if fp != fps[-1]:
                    lows = {}
                for h in heads[fps[heads] == fps[-1]].tolist():
                    lows.setdefault(_digest(int(fps[h]), texts[h].as_py()), None if run_null[h] else int(run_low[h]))
                fp, text, mask, low = int(fps[-1]), texts[n - 1].as_py(), int(masks[-1]), None if run_null[-1] else int(run_low[-1])
                edge = np.full(n, None, object)
                for i in np.flatnonzero(is_low & (fps == first)).tolist():
                    edge[i] = edge[i - 1] if i and same[i] and edge[i - 1] else _digest(first, texts[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((masks | np.where(is_low, 0, COPY)).astype(np.int32)), pa.array(edge, pa.string())], names=["doc_id", "part", "mask", "edge"])
        if lows:
            yield pa.RecordBatch.from_arrays([pa.array([*lows.values()], pa.int64()), pa.nulls(len(lows), pa.string()), pa.array([-1] * len(lows), pa.int32()), pa.array([*lows], pa.string())], names=["doc_id", "part", "mask", "edge"])

    return words.tidy(run)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 200) -> DataFrame:
    """``doc_id, part, mask, n`` for the rows of ``docs``: bit 0 to 4 says that filter A to E fails; equal answers are one row.

    A: fewer than ``least_words`` words; B: under half of the words are distinct; C: over 3 %
    capitals; D: a character of ``#$%&*|``; E: equal to the text of a smaller id, whatever
    became of that.  Null and empty texts are equal and have no words: they fail A.  A null id is larger than
    all others; rows that share an id are no copies of one another.  A null part is an empty
    one.  Texts of any length are compared whole; other columns are ignored.  An empty table
    gives no rows.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("text"), F.monotonically_increasing_id().alias("nth"))
    order = F.col("doc_id").asc_nulls_last()
    # the number only parts rows that are equal in all else
    dealt = rows.repartitionByRange(bucket_count(docs, RANGE_BYTES), "fp", order, "nth").sortWithinPartitions("fp", "text", order)
    masks = keep(dealt.select("doc_id", "part", "fp", "text").mapInArrow(_masks_of_range(least_words), "doc_id long, part string, mask int, edge string"), "filter-masks")
    lows = masks.where("mask < 0").groupBy("edge").agg(F.min("doc_id").alias("low"))
    counted = masks.where("mask >= 0").groupBy("doc_id", "part", "mask", "edge").agg(F.count("*").alias("n"))
    later = F.when(F.col("doc_id").isNull(), F.col("low").isNotNull()).otherwise(F.col("doc_id") > F.col("low"))
    settled = counted.where("edge IS NOT NULL").join(lows, "edge", "left").withColumn("mask", F.when(later, F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    out = counted.where("edge IS NULL").select("doc_id", "part", "mask", "n").union(settled.select("doc_id", "part", "mask", "n"))
    out.kept_path = masks.kept_path  # for ``discard``
    return out


def _total(column: str, holds) -> Column:
    """The sum of a part's 32 counters whose mask ``holds``."""
    chosen = F.transform(F.col(column), lambda x, k: F.when(holds(k), x).otherwise(F.lit(0).cast("long")))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", least_words: int = 200) -> DataFrame:
    """What each filter removes in each of the 120 orders, by part.

    Returns ``part, filter_order, step`` and long counts within the part: ``kept`` after the
    step, ``removed`` by it, ``redundant`` (failing its filter, removed before), ``unique_fails``
    (failing this filter only), ``good_lost`` and ``toxic_lost`` (removed by it and labelled
    so), ``shapley`` (removed by its filter, summed over all orders).  Filters, nulls and ties
    are those of ``failure_masks``.  A document counts as good or toxic if any of its labels
    says so; labels of other documents, and null ones, say nothing.  An empty ``docs`` gives
    no rows, empty ``labels`` zeros.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    masks = failure_masks(docs, id_col, text_col, part_col, least_words)
    counter = lambda what, k: F.sum(F.when(F.col("mask") == k, F.col("n") * what).otherwise(0))
    kinds = {"n": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
    parts = masks.join(said, "doc_id", "left").groupBy("part").agg(*(F.array(*(counter(what, k) for k in range(32))).alias(name) for name, what in kinds.items()))
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    at = F.explode(F.sequence(F.lit(0), F.lit(5 * len(orders) - 1))).alias("at")
    counters = keep(parts, "filter-counters")
    discard(masks)
    rows = counters.select("*", at).withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.expr("CAST(at DIV 5 AS INT) + 1"))).withColumn("step", F.expr("CAST(at % 5 AS INT) + 1"))
    bit = lambda nth: F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {nth}, 1)) - 1)")
    rows = rows.withColumn("bit", bit("step")).withColumn("before", sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, 5)), F.lit(0)))
    hit = lambda k, m: k.bitwiseAND(F.col(m)) != 0
    here = lambda k: hit(k, "bit") & ~hit(k, "before")
    # of a row that fails m filters, each of these removes it in 120 / m orders
    shares = F.transform("n", lambda x, k: F.when(hit(k, "bit"), x * (F.lit(len(orders)) / F.bit_count(k)).cast("long")).otherwise(F.lit(0).cast("long")))
    share = F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", "filter_order", "step", _total("n", lambda k: ~hit(k, "bit") & ~hit(k, "before")).alias("kept"), _total("n", here).alias("removed"),
        _total("n", lambda k: hit(k, "bit") & hit(k, "before")).alias("redundant"), _total("n", lambda k: k == F.col("bit")).alias("unique_fails"),
        _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"), share.alias("shapley"))
