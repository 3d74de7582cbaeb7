"""Secret scans of whole texts: credential-like strings, false positives removed by a random forest.

Method.  Candidates are unbroken runs of 16 or more key characters, of any length, that hold
a digit, or a capital inside, or follow a key word; dotted keys of known prefixes; values of
any length that a key word and "=" or ":" stand before; and passwords within URLs.  "="
belongs to a run as padding at its end only, so that a value starts after its name.  The forest looks at the candidate's length, its
transitions between lower case, capitals, digits and signs, how much of it dictionary
syllables cover, whether it stands in a path or URL, and the words next to it.  It is fitted
on ``TRAINING`` generated labelled findings (a fixed bound, a fixed seed) whose features
come from the same expressions, with a threshold for 95 % precision on held-out findings,
and runs as CASE expressions on the JVM side.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import native, trees

KEY = r"A-Za-z0-9+/_-"
KEY_WORD = r"token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|private|credential|client[_ -]?secret"
#: Dotted keys: SendGrid's, and web tokens of two or three parts.
DOTTED = r"ya29\.[A-Za-z0-9_-]{16,}+|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{13,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?"
MIXED = rf"(?=[A-Za-z+/_-]*+[0-9]|[{KEY}][a-z0-9+/_-]*+[A-Z])"
AFTER_KEY = rf"(?<=(?i:{KEY_WORD})[A-Za-z0-9_\x20\"'=:-]{{0,12}})"
#: Right after a key word and its sign; right after the user of a URL.  A look at one character comes before the long look behind.
ASSIGNED = rf"(?<=[=:]\x20{{0,2}}[\"']?)(?<=(?i:{KEY_WORD})[A-Za-z0-9_-]{{0,12}}[\"']?\x20{{0,2}}[=:]\x20{{0,2}}[\"']?)"
IN_URL = r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s@/]++(?=@)"
CANDIDATE = rf"{IN_URL}|(?<![{KEY}])(?:{DOTTED}|(?=[{KEY}]{{16}})(?:{MIXED}|{AFTER_KEY})[{KEY}]++(?:={{1,2}}+(?![={KEY}]))?|{ASSIGNED}[!@#$%^&*.?~{KEY}]++)"
#: A cheap test of whether a text can hold a candidate: the run, or the sign, that each of them has.
SIGN = rf"(?<![{KEY}])[{KEY}]{{16}}|SG\.|ya29\.|:(?<=://[^\s:/@]{{1,64}}:)|[=:](?<=(?i:{KEY_WORD})[A-Za-z0-9_-]{{0,12}}[\"']?\x20{{0,2}}[=:])"
CONTEXT, TRAINING, PRECISION = 32, 3000, 0.95
FEATURES = ("length", "digits", "capitals", "signs", "transitions", "hex", "covered", "vowels", "distinct", "in_path", "after_key", "after_other", "assigned", "quoted", "prefixed", "dashes", "in_url", "runs", "named")
#: Common syllables and words whose share marks prose and identifiers.
DICTIONARY = r"(?i)(tion|ing|the|and|ent|ment|able|version|config|class|file|image|data|name|user|test|value|index|http|www|page|content|style|script|node|module|build|release|commit|sha|uuid|model|order|part|item)"
NEAR_KEY = rf"(?i)({KEY_WORD})"
NEAR_OTHER = r"(?i)(commit|sha1|sha256|md5|checksum|digest|revision|hash|uuid|guid|build|version|isbn|order|invoice|serial|etag|integrity|card|number)"
PREFIXED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|xapp-|ya29\.|hf_|sk_live_|sk-|rk_live_|AIza|eyJ|SG\.|npm_|pypi-)"


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    without = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    n = F.length(value)
    out = {
        "length": n, "digits": without("[0-9]") / n, "capitals": without("[A-Z]") / n, "signs": without("[+/_=-]") / n,
        "transitions": without(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]") / n,
        "hex": value.rlike("^[0-9a-fA-F]+$").cast("int"), "covered": without(DICTIONARY) / n, "vowels": without("[aeiouAEIOU]") / n,
        "distinct": F.size(F.array_distinct(F.split(value, "", n))) / n,
        "in_path": (before.rlike(r"[/\\.:]$|://\S*$") | after.rlike(r"^[/\\.]\w")).cast("int"),
        "after_key": before.rlike(NEAR_KEY).cast("int"), "after_other": before.rlike(NEAR_OTHER).cast("int"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("int"), "quoted": before.rlike("[\"']$").cast("int"),
        "prefixed": value.rlike(PREFIXED).cast("int"), "dashes": without("-"), "in_url": (before.rlike(r"://[^\s:/@]+:$") & after.startswith("@")).cast("int"),
        "runs": without(r"(?s)(.)\1\1+") / n, "named": before.rlike(rf"(?i)({KEY_WORD})[A-Za-z0-9_-]{{0,12}}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$").cast("int"),
    }
    return {k: out[k].cast("double") for k in FEATURES}


def findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Generated labelled findings ``(before, value, after, label)``."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    word = lambda: "".join(r.choice(["the", "tion", "an", "er", "in", "re", "ou", "at", "le", "que", "ment", "sch"]) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(4)) + " "
    keys = ["token = \"", "api_key: ", "password=", "secret = '", "Authorization: Bearer ", "access_key=\"", "client_secret: \"", "auth token ", "TOKEN = \"", "API_KEY=", "export AUTH_TOKEN="]
    other = ["commit ", "sha1 ", "md5: ", "checksum = ", "uuid ", "build ", "order number ", "serial ", "etag \"", "invoice ", "card number "]
    assigned = ["password: ", "passwd=", "pwd = \"", "db_password: '", "secret=", "API_KEY: ", "token=", "client-secret = "]
    out = []
    for _ in range(n):
        yes = r.random() < 0.5
        if r.random() < 0.25:  # short values, and those in URLs
            mixed = lambda: "".join(r.sample(pick(lower, r.randint(2, 7)) + pick(upper, r.randint(1, 3)) + pick(digits, r.randint(1, 4)) + pick("!@#$%&*", r.randint(2, 3)), k=6) if r.random() < 0.3 else [word()[:7].capitalize() if r.random() < 0.5 else word(), pick(digits, r.randint(1, 4)), r.choice(["", "!", "#", "$", word()[:6]])])
            if r.random() < 0.25:
                value = mixed() if r.random() < 0.8 else word() + word()
                before, after = prose() + r.choice(["postgres", "https", "mysql", "amqp"]) + "://" + word() + ":", "@" + word() + "/"
                if not yes:
                    value, before, after = r.choice([pick(digits, 4), pick(digits, 5), "xxxxxx", "*****"]), prose() + "http://" + word() + ":", "@" + word()
            else:
                value = mixed() if yes else r.choice([word(), word(), "true", "none", "null", "string", "required", "optional", "x" * r.randint(4, 12), "*" * r.randint(4, 12), pick(digits, r.randint(1, 4)), r.choice("A0x") * r.randint(16, 40), word() + ".", "None", "False"])
                before, after = prose() + r.choice(assigned), r.choice([" ", "\n", "'", '"', ","])
            out.append((before[-CONTEXT:], value, after, int(yes)))
            continue
        if yes:
            value = r.choice([pick(digits + "abcdef", 40), pick(digits + "ABCDEF", 40), pick(digits + "abcdef", 32), pick(lower + upper + digits, r.randint(20, 64)), pick(lower + upper + digits + "+/", 40), "AKIA" + pick(upper + digits, 16), "ghp_" + pick(lower + upper + digits, 36), "sk_live_" + pick(lower + upper + digits, 24),
                pick(lower + upper, r.randint(20, 40)), pick(lower, r.randint(20, 40)), pick(lower + upper + digits + "+/", r.randint(200, 2000)), "SG." + pick(lower + upper + digits, 22) + "." + pick(lower + upper + digits, 43), ".".join("eyJ" * (i < 2) + pick(lower + upper + digits + "-_", r.randint(17, 43)) for i in range(3))])
            known = value[:4] in ("AKIA", "ghp_", "sk_l") or value[:3] in ("SG.", "eyJ")
            before = prose() + (r.choice(["", *keys]) if known else r.choice(keys))
            after = r.choice(['" ', "' ", " ", "\n", ","])
        else:
            value = r.choice([pick(digits, r.randint(16, 20)), pick(digits + "abcdef", 40), pick(digits + "abcdef", 32), "-".join(pick(digits + "abcdef", k) for k in (8, 4, 4, 4, 12)), f"{word()}-{word()}-{pick(digits, 4)}-version", f"{word()}_{word()}_{word()}{pick(digits, 2)}", f"{word()}{word()}{pick(digits, 3)}{word()}", pick(lower + upper + digits + "+/", r.randint(60, 120)), pick(lower + upper + digits + "+/", r.randint(200, 2000)),
                "".join(word().capitalize() for _ in range(r.randint(3, 6))), "_".join(word().upper() for _ in range(r.randint(3, 6))), "-".join(word() for _ in range(r.randint(3, 6))), "".join(word() for _ in range(5))])
            before = prose() + r.choice(["", "", *other, "https://example.org/a/", "src/lib/", "<img src=\"data:image/png;base64,"])
            if value.isdigit() or "-" in value[6:10] or "_" in value or value.isalpha():
                before = prose() + r.choice(["", *other, *keys])
            after = r.choice([" ", "/index.html", ".js", ".", "\n"])
        out.append((before[-CONTEXT:], value, after, int(yes)))
    return out


_model: list = []


def model(spark: SparkSession) -> tuple[list, float]:
    """The forest and its threshold; fitted once an application, from a fixed seed."""
    if not _model:
        rows = [(i % 3 == 0, *x) for i, x in enumerate(findings(TRAINING, 11))]
        sample = spark.createDataFrame(rows, "held boolean, before string, value string, after string, label int")
        got = sample.select("held", "label", *(c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("after")).items())).collect()
        x, y = np.array([[r[f] for f in FEATURES] for r in got]), np.array([r["label"] for r in got])
        held = np.array([r["held"] for r in got])
        forest = trees.fit_forest(x[~held], y[~held])
        _model.append((forest, trees.threshold(trees.score(forest, x[held]), y[held], PRECISION)))
    return _model[0]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of whole texts: ``doc_id, n_candidates, n_secrets, spans, found``.

    A row for each row of ``docs``.  ``spans`` lists ``start:end`` of secrets in code points,
    end exclusive, comma-joined; ``found`` holds them with their scores.  Candidates never
    overlap.  A null or empty text has none; a text of any length is searched whole, in time
    that grows with it and with its candidates.  Null and repeated ids, repeated rows and other
    columns have no influence.  An empty table gives no rows.  No shuffle.
    """
    forest, least = model(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), native.text_or_empty(F.col(text_col)).alias("t"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    d = d.withColumn("c", F.when(F.col("t").rlike(SIGN), native.spans(F.col("t"), CANDIDATE)).otherwise(none))

    def with_features(s: Column, cut: Column) -> Column:
        f = features(s["value"], native.before(cut, s["start"], CONTEXT), native.after(cut, s["end"], 12))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.struct(*(c.alias(k) for k, c in f.items())).alias("f"))

    cut = F.when(F.size("c") > 0, native.pieces(F.col("t")))
    d = d.withColumn("c", native.let(cut, lambda cut: F.transform("c", lambda s: with_features(s, cut))))
    d = d.select("doc_id", F.size("c").cast("long").alias("n_candidates"), F.transform("c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), trees.score_column(forest, s["f"], FEATURES).alias("score"))).alias("c"))
    d = d.withColumn("found", F.filter("c", lambda s: s["score"] >= least))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select("doc_id", "n_candidates", F.size("found").cast("long").alias("n_secrets"), spans.alias("spans"), "found")
