"""Quality rules: within a text, and by how often its lines occur over the documents of a host.

Method (cross-document line frequency).  Each document's distinct normalised lines are
hashed; documents are counted by host and line, partially before the shuffle.  A line in
more than ``min_docs`` documents of its host is boilerplate, however large the host is, and
is removed wherever it stands.  A document is rejected when it fails the rules within its
text, or when boilerplate was removed and fewer than ``min_words`` words, or less than
``min_left`` of them, are left.

By these rules a text that a host holds in many copies goes with all its copies.  Before a
dedup stage that isn't wanted: ``copies_once`` counts equal texts of a host once, and
``first_keeps`` leaves the lines in the host's document of smallest id, so that one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native
from .storage import keep

WINDOW = 8


KEYS = ("doc_id", "host", "text_hash")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _covered(places: Column) -> Column:
    """How many words the windows at ``places`` (ascending) cover."""
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"), (i + WINDOW).alias("end"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[\t-\r\x20]+", " ")))


def text_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host, text_hash``, the measures within each text, and its lines as (hash, words).

    ``n_repeat_words`` counts the words in windows of eight that the text holds twice or
    more, the first included.  Hashing all windows tells whether any repeats; only for texts
    where one does are the windows sorted, so that equal ones are neighbours.
    """
    text = native.text_or_empty(F.col(text_col))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("t"))
    d = d.select("*", native.words(F.col("t")).alias("words"), F.filter(F.split("t", "\n", -1), lambda x: F.length(F.trim(x, F.lit(native.SPACES))) > 0).alias("own_lines"))
    n = F.size("words")
    at = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("windows", F.transform(at, lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    d = d.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    flagged = F.transform("ordered", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    d = d.withColumn("places", F.sort_array(F.filter(flagged, lambda i: i.isNotNull())))
    d = d.select(
        "doc_id", "host", F.xxhash64("t").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("own_lines", lambda x: F.struct(line_key(x).alias("line"), F.size(native.words(x)).alias("n"))).alias("lines"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, min_words: int = 20, min_left: float = 0.3, copies_once: bool = False, first_keeps: bool = False) -> DataFrame:
    """Verdicts on whole documents: ``doc_id, text_hash, host``, the measures, ``n_left, cut_lines, kept``.

    A row for each row of ``docs``.  ``n_left`` counts the words outside removed lines and
    ``cut_lines`` lists the removed lines' hashes.  A null text is an empty one and fails
    for its length.  A null host is a host of its own.  With ``first_keeps`` a row without
    an id counts as later than all others.  Rows that share an id are separate documents;
    equal rows get equal verdicts.  An empty table gives none.  Other columns are ignored,
    whatever their names.
    """
    base = keep(text_rules(docs, id_col, text_col, host_col), "quality-base")
    lines = base.select(*KEYS, F.explode("lines").alias("x")).select(*KEYS, "x.line", "x.n")
    once = base.select(*KEYS, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    n_docs = F.countDistinct("text_hash") if copies_once else F.count("*")
    often = once.groupBy("host", "line").agg(n_docs.alias("docs"), F.min("doc_id").alias("first_id")).where(F.col("docs") > min_docs)
    often = keep(often.select(F.col("host").alias("h"), F.col("line").alias("l"), "first_id"), "boilerplate")
    # `often` is a written table, so a line that a large part of a host holds can be split as any skewed key
    cut = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    if first_keeps:
        cut = cut.where(F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("doc_id").isNull() & F.col("first_id").isNotNull()))
    cut = cut.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("th"), F.col("host").alias("h")).agg(F.sum("n").alias("n_cut"), F.collect_set("line").alias("cut_lines"))
    # equal rows have each added theirs
    equal = base.groupBy(*KEYS).agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("i2"), F.col("text_hash").alias("th2"), F.col("host").alias("h2"), "rows")
    same = lambda i, th, h: F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(th)) & F.col("host").eqNullSafe(F.col(h))
    out = base.drop("lines").join(cut, same("i", "th", "h"), "left").join(equal, same("i2", "th2", "h2"), "left")
    left = F.col("n_words") - F.coalesce(F.col("n_cut") / F.coalesce("rows", F.lit(1)), F.lit(0)).cast("long")
    depleted = (F.col("n_words") > F.col("n_left")) & ((F.col("n_left") < min_words) | (F.col("n_left") < min_left * F.col("n_words")))
    out = out.withColumn("n_left", left).withColumn("kept", ~(F.col("base_failed") | depleted))
    return out.select(*KEYS, *MEASURES, "n_left", F.coalesce("cut_lines", F.array().cast("array<bigint>")).alias("cut_lines"), "kept")


def without_lines(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` that ``verdicts`` keeps, their removed lines taken out of the text; columns as they are.

    Rows are told apart by id, text and host; equal rows stay as often as they come.  Only
    rejected documents and those with removed lines are looked up.  A text without removed
    lines stays as it is, null included.  An empty table gives none.
    """
    own = (docs[id_col].cast("long"), docs[host_col].cast("string"), F.xxhash64(native.text_or_empty(docs[text_col])))
    v = keep(verdicts.where(~F.col("kept") | (F.size("cut_lines") > 0)).select(*(F.col(k).alias(f"_{k}") for k in KEYS), "kept", "cut_lines").dropDuplicates([f"_{k}" for k in KEYS]), "changed")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(f"_own_{k}") for k, c in zip(KEYS, own)))
    same = F.col("_own_doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_own_text_hash") == F.col("_text_hash")) & F.col("_own_host").eqNullSafe(F.col("_host"))
    found = row.join(v, same, "left").where(F.coalesce("kept", F.lit(True)))
    text = F.col(f"_row.`{text_col}`")
    lines = F.filter(F.split(native.text_or_empty(text), "\n", -1), lambda x: ~F.array_contains("cut_lines", line_key(x)))
    clean = F.when(F.size("cut_lines") > 0, F.array_join(lines, "\n")).otherwise(text)
    return found.select(*(clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
