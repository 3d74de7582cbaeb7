"""Personal data in whole texts: fixed formats, and further spans by boosted trees.

Method (candidate gradient boosting).  Generators of high recall propose spans of other
formats, which overlap each other: national phone numbers, cards cut by dots or slashes or
of 15 digits, spelled-out mail addresses, social security numbers and bank accounts (IBAN).
Boosted trees score each from its format (digits, groups, separators, check digits) and its
context (the words before it); a threshold calibrated on held-out examples for 98 % precision
selects.  The trees are fitted on ``TRAINING`` generated labelled examples a kind (a fixed
bound, a fixed seed) whose features come from the same expressions, and run as SQL CASE
expressions.  Selected spans never touch a span of a fixed format; of two that overlap the
better one stays.  Names and postal addresses are not looked for.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native, trees

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("ssn", "iban")  # only among the added spans, after the others
ALL_KINDS = KINDS + MORE_KINDS
#: The fixed formats.  Each is the plain pattern with possessive loops and, where a failed
#: start inside a run can't succeed later in the run, a look behind: the same matches, in
#: linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The end of every spelled-out address: the at-part, a name, and the first dot-part.
MAIL_TAIL = r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20|\x20@\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,})"
#: No upper bounds on a match's length; possessive loops keep the time linear.
GENERATORS = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{MAIL_TAIL}++",
    "card": r"(?<![0-9./_-])[0-9]{4}(?:[./_\x20-](?:[0-9]{4}|[0-9]{6}(?=[./_\x20-][0-9]{5}(?![0-9])))){1,4}(?:[./_\x20-][0-9]{1,5})?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?)++(?![0-9./-]*[0-9])",
    "ssn": r"(?<![0-9.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,}(?:[\x20-]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
SIGNS = {"email": rf"(?i){MAIL_TAIL}", "card": r"[0-9]{4}[./_\x20-][0-9]{4}", "phone": r"[0-9]\)?[\x20./-]{1,2}\(?[0-9]", "ssn": r"[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]{4}"}
FEATURES = ("digits", "groups", "dots", "dashes", "spaces", "slashes", "parens", "longest", "first", "second", "last", "luhn", "mod97", "zero", "year", "near_phone", "near_card", "near_mail", "near_ssn", "near_bank", "near_other", "word_before", "brackets", "letters")
CONTEXT = 24
NEAR = {
    "near_phone": r"(?i)(phone|\btel|\bcall|mobile|\bcell|\bfax|\bdial|whatsapp|\bring|\btext|\bsms|reach|number|contact|hotline|line\b)",
    "near_card": r"(?i)(card|visa|master|amex|credit|debit|payment|pan\b)",
    "near_mail": r"(?i)(mail|contact|write|reach|reply|address|send|at:?\s*$)",
    "near_ssn": r"(?i)(\bssn|social|security|tax id|taxpayer)",
    "near_bank": r"(?i)(iban|bank|account|konto|transfer|\bpay)",
    "near_other": r"(?i)(version|isbn|issn|page|order|invoice|serial|model|part|section|date|year|score|ratio|build|ticket|batch|\bid\b|no\.)",
}
TRAINING, PRECISION = 1800, 0.98


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        two = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, two).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether the letters and digits are an account number by its check digits."""
    own = F.regexp_replace(value, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(own, F.lit(5), F.length(own)), F.substring(own, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        v = F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.when(value.rlike("^[A-Z]{2}[0-9]{2}"), F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\.", -1), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(part(p).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of a fixed format; texts without its first sign are not searched."""
    found = F.filter(native.spans(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    sign = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}[kind]
    typed = F.transform(found, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1e9).alias("score")))
    return F.when(text.rlike(sign), typed).otherwise(F.array().cast("array<struct<k:int,start:int,end:int,score:double>>"))


def features(value: Column, before: Column) -> dict[str, Column]:
    """The trees' features of a candidate and the text before it."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    count = lambda c: (F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))).cast("double")
    groups = F.split(F.regexp_replace(value, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+", -1)
    out = {
        "digits": F.length(digits), "groups": F.size(groups), "dots": count("."), "dashes": count("-"), "spaces": count(" "), "slashes": count("/"), "parens": count("("),
        "longest": F.array_max(F.transform(groups, lambda g: F.length(g))), "first": F.length(F.get(groups, F.lit(0))),
        "second": F.coalesce(F.length(F.get(groups, F.lit(1))), F.lit(0)), "last": F.length(F.element_at(groups, -1)),
        "mod97": _mod97(value).cast("int"), "zero": value.rlike(r"^\(?0").cast("int"), "year": value.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])").cast("int"), "word_before": before.rlike(r"[A-Za-z]:?\s*$").cast("int"),
        "luhn": F.when(F.length(digits) > 1, _luhn(digits)).otherwise(False).cast("int"),
        "brackets": count("[") + count("("), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
    }
    out |= {k: before.rlike(p).cast("int") for k, p in NEAR.items()}
    return {k: out[k].cast("double") for k in FEATURES}


def examples(kind: str, n: int, seed: int) -> list[tuple[str, str, int]]:
    """Generated ``(before, value, label)`` findings of a kind's generator."""
    r = random.Random(f"{kind}-{seed}")
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    up = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    w = lambda: "".join(r.choice("aeioulnrstmdc") for _ in range(r.randint(2, 8)))
    near = {
        "phone": ["call me at ", "phone: ", "tel. ", "mobile ", "fax ", "text ", "reach us: ", "my number ", "hotline ", "Call "],
        "card": ["card number ", "visa ", "credit card: ", "payment by ", "card: ", "charged to "],
        "email": ["contact ", "mail ", "write to ", "reach me: ", "e-mail: ", "address: "],
        "ssn": ["SSN ", "ssn: ", "social security number ", "his social ", "tax id "],
        "iban": ["IBAN ", "IBAN: ", "bank account ", "transfer to ", "Konto "],
    }
    other = ["version ", "isbn ", "pages ", "order ", "invoice ", "section ", "on the date ", "score ", "build ", "serial no. ", "ticket ", "batch ", "order id "]
    plain = lambda: " ".join(w() for _ in range(3)) + r.choice([" ", " ", ", ", ": ", " ("])

    def luhn(k: int, good: bool) -> str:
        while True:
            s = d(k)
            t = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s))))
            if (t % 10 == 0) == good:
                return s

    def cut(s: str, sizes: tuple[int, ...], by: str) -> str:
        at = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        return by.join(s[i:j] for i, j in zip(at, at[1:]))

    def account(good: bool) -> str:
        country, body = up(2), d(r.randint(11, 26)) if r.random() < 0.7 else up(4) + d(r.randint(8, 16))
        rest = int("".join(str(int(c, 36)) for c in body + country)) * 100
        check = 98 - rest % 97 if good else r.randint(2, 98)
        s = f"{country}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    out = []
    for _ in range(n):
        yes = r.random() < 0.5
        told = r.random() < 0.6  # the words before say what it is
        if kind == "phone":
            s = r.choice("- .")
            us = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}"[2:]]
            if yes:
                value = r.choice([*us, f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(r.randint(2, 4))}{r.choice(' /-')}{d(r.randint(5, 8))}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{d(r.randint(2, 4))}) {d(r.randint(5, 8))}"])
                before = r.choice(near["phone"]) if told else plain()
            else:
                year = f"{r.choice(['19', '20'])}{d(2)}"
                value = r.choice([f"{year}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{year}", f"{d(2)}.{d(2)}.{year}", f"{d(3)}.{d(3)}.{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(2)}", f"{d(4)} {d(4)}", f"{d(3)} {d(2)}", f"978-{d(1)}{d(1)}-{d(2)}-{d(6)}", f"{year}-{year}", *us])
                before = r.choice(other) if value in us or r.random() < 0.5 else plain()
        elif kind == "card":
            k, sizes = r.choice([(16, (4, 4, 4, 4))] * 3 + [(15, (4, 6, 5))])
            before = r.choice(near["card"]) if told else plain() if yes else r.choice([plain(), r.choice(other), r.choice(near["card"])])
            value = cut(luhn(k, yes or (before in other and r.random() < 0.1)), sizes, r.choice("./-_ "))
            if not yes and r.random() < 0.3:
                value = r.choice([f"{d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(2)}"])
        elif kind == "ssn":
            value = f"{d(3)}{r.choice('--- ')}{d(2)}{r.choice('--- ')}{d(4)}"
            value = f"{d(3)}-{d(2)}-{d(4)}" if r.random() < 0.6 else value
            before = (r.choice(near["ssn"]) if told or value.count("-") < 2 else plain()) if yes else r.choice(other) if r.random() < 0.6 or value.count("-") == 2 else plain()
        elif kind == "iban":
            value = account(yes)
            before = (r.choice(near["iban"]) if told else plain()) if yes else r.choice([plain(), r.choice(other), r.choice(near["iban"])])
        else:
            open_ = r.choice("[({")
            shut = {"[": "]", "(": ")", "{": "}"}[open_]
            gap = r.choice(["", " "])
            marked = (f"{gap}{open_}at{shut}{gap}", r.choice([f"{gap}{open_}dot{shut}{gap}", "."]))
            at, dot = r.choice([marked, marked, (" at ", " dot "), (" @ ", ".")])
            name = r.choice([w(), f"{w()}.{w()}", f"{w()}{d(2)}"])
            value = f"{name}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'example', 'de', 'co.uk'])}" if yes else f"{w()} at {w()}{r.choice(['.', ' dot '])}{w()}"
            strong = "at " != at[-3:] or "dot" in dot
            before = (r.choice(near["email"]) if told or not strong else plain()) if yes else r.choice([plain(), plain(), r.choice(other)])
        out.append((before, value, int(yes)))
    return out


_models: dict[str, tuple[list, float]] = {}


def models(spark: SparkSession) -> dict[str, tuple[list, float]]:
    """Trees and threshold of each kind; fitted once an application, from a fixed seed."""
    if not _models:
        rows = [(k, i % 3 == 0, *x) for k in GENERATORS for i, x in enumerate(examples(k, TRAINING, 1))]
        sample = spark.createDataFrame(rows, "kind string, held boolean, before string, value string, label int")
        got = sample.select("kind", "held", "label", *(c.alias(k) for k, c in features(F.col("value"), F.col("before")).items())).collect()
        for kind in GENERATORS:
            own = [r for r in got if r["kind"] == kind]
            x, y = np.array([[r[f] for f in FEATURES] for r in own]), np.array([r["label"] for r in own])
            held = np.array([r["held"] for r in own])
            fitted = trees.fit_boosting(x[~held], y[~held])
            _models[kind] = fitted, trees.threshold(trees.score(fitted, x[held]), y[held], PRECISION)
    return _models


def added_spans(text: Column, kind: str, fitted: list, least: float) -> Column:
    """Candidates of a kind that score at least ``least``."""
    candidates = native.spans(text, GENERATORS[kind])

    def scored(s: Column, cut: Column) -> Column:
        f = F.struct(*(c.alias(k) for k, c in features(s["value"], native.before(cut, s["start"], CONTEXT)).items()))
        return F.struct(F.lit(ALL_KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), f.alias("f"))

    with_context = lambda found: native.let(native.pieces(text), lambda cut: F.transform(found, lambda s: scored(s, cut)))
    none = F.array().cast(f"array<struct<k:int,start:int,end:int,f:struct<{','.join(f'{k}:double' for k in FEATURES)}>>>")
    rows = native.let(candidates, lambda found: F.when(F.size(found) > 0, with_context(found)).otherwise(none))
    rows = F.transform(rows, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), trees.score_column(fitted, s["f"], FEATURES).alias("score")))
    sign = SIGNS[kind]
    return F.when(text.rlike(sign), F.filter(rows, lambda s: s["score"] >= least)).otherwise(F.array().cast("array<struct<k:int,start:int,end:int,score:double>>"))


def _choose(both: Column) -> Column:
    """Spans by start: an added one goes if it meets a base span or a better added one.

    Of added ones with equal scores the first stays.  ``reach`` is the largest end of the base
    spans so far, which may lie in one another.
    """
    out = native.Growing("struct<start:int,end:int,score:double,k:int>")

    def step(acc: Column, s: Column) -> Column:
        base = s["score"] >= 1e8
        last = F.when(F.size(acc["open"]) > 0, F.element_at(acc["open"], -1))
        meets = F.coalesce((last["end"] > s["start"]) & (last["score"] < 1e8), F.lit(False))  # the last added one
        reach = F.when(base, F.greatest(acc["reach"], s["end"])).otherwise(acc["reach"]).alias("reach")
        same = F.struct(acc["blocks"].alias("blocks"), acc["open"].alias("open"), reach)
        more, instead = F.struct(*out.put(acc, s), reach), F.struct(*out.replace(acc, s), reach)
        return F.when(~base & (acc["reach"] > s["start"]), same).when(~meets, more).when(base | (s["score"] > last["score"]), instead).otherwise(same)

    return F.aggregate(both, F.struct(*out.start(), F.lit(0).alias("reach")), step, out.all)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start."""
    named = F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(named, ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data: ``doc_id``, counts by kind, ``base_sha256``, ``spans``, ``n_spans``, ``found``.

    A row for each row of ``docs``.  The counts and the hash are of the fixed formats;
    ``spans`` and ``found`` (kind number, start, end, in code points) also hold what the
    trees added; of overlapping added spans with equal scores the first stays.  A null or empty
    text has none; a text of any length is searched whole, in time that grows with it and with
    its matches.  Null and repeated ids, repeated rows and other columns have no influence.  An
    empty table gives no rows.  No shuffle.
    """
    fitted = models(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), native.text_or_empty(F.col(text_col)).alias("t"))
    d = d.select("doc_id", "t", *(base_spans(F.col("t"), k).alias(k) for k in KINDS), *(added_spans(F.col("t"), k, *fitted[k]).alias(f"more_{k}") for k in GENERATORS))
    more = F.concat(*(F.col(f"more_{k}") for k in GENERATORS))
    base = F.concat(*map(F.col, KINDS))
    by_start = lambda a: F.sort_array(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["k"].alias("k"))))
    d = d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"), F.when(F.size(more) > 0, by_start(F.concat(base, more))).alias("both"))
    d = d.withColumn("_base", _joined(F.col("base"))).withColumn("found", F.when(F.col("both").isNotNull(), _choose(F.col("both"))).otherwise(by_start(F.col("base"))))
    return d.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("_base", 256).alias("base_sha256"), F.when(F.col("both").isNull(), F.col("_base")).otherwise(_joined(F.col("found"))).alias("spans"), F.size("found").cast("long").alias("n_spans"), F.transform("found", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))


def redact(text: Column, found: Column) -> Column:
    """The text with each found span replaced by ``<KIND>``; overlapping spans by the first one's."""
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    mark = lambda s: F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["k"] + 1)), F.lit(">"))
    join = lambda chars, a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")

    def cut(chars: Column, spans: Column, ends: Column) -> Column:
        """``ends`` are the largest ends up to each span; what lies between them and the next start stays."""
        def one(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
            return F.when(s["start"] >= at, F.concat(join(chars, at, s["start"]), mark(s))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(spans, one), ""), join(chars, F.element_at(ends, -1), F.size(chars)))

    largest = lambda spans: native.running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    whole = native.let(F.split(text, "", -1), lambda chars: native.let(ordered, lambda spans: native.let(largest(spans), lambda ends: cut(chars, spans, ends))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in their texts replaced; columns as they are.

    A row for each row, repeated ones included; a null text stays null, an empty one empty.
    An empty table gives none.  Columns of any name are carried along.
    """
    fitted = models(docs.sparkSession)
    t = native.text_or_empty(F.col(text_col))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    spans = F.concat(*(base_spans(F.col("t"), k) for k in KINDS), *(added_spans(F.col("t"), k, *fitted[k]) for k in GENERATORS))
    d = docs.select(row, t.alias("t"), F.col(text_col).isNull().alias("null_text")).withColumn("spans", spans)
    d = d.withColumn("spans", _choose(F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["k"].alias("k"))))))
    clean = F.when(~F.col("null_text"), redact(F.col("t"), F.col("spans")))
    return d.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
