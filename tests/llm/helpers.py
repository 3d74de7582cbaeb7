"""Plain re-statements of the operators, and rows with every awkward case."""

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("id", "t", "words", "h", "text_hash", "found", "node", "_i", "value", "bucket", "n", "src", "keys", "shard", "_row", "_key", "label", "sig", "a", "b", "q", "at", "host", "line", "often", "places", "kept")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def corpus(seed: int = 1):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, one long text, nulls, ties, repeats."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(600)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(prose(r.randint(1, 160))) for _ in range(40)]
    base, passage = prose(120), prose(70)
    texts += [" ".join(base)] * 6
    for _ in range(12):
        w = list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [" ".join(prose(r.randint(0, 60)) + passage + prose(r.randint(0, 60))) for _ in range(8)]
    texts += ["", "   ", "one", "a b c", "A B C", "a b c d", "A b\tc\x0bD", None, None, "\n\nx\n\nx\n", "same line\nsame line\n" * 30, " ".join(prose(9) * 12)]
    texts += [" ".join(prose(6000)), "é" * 3000, "Ünï cödé\xa0tok\x1cen 🙂 " * 20, "mail a.b@c.org from 10.0.0.255 card 4111 1111 1111 1111 tel +49 30 1234567 "]
    rows = [(i, t, r.choice(["en", None]), r.choice(["s1", "s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None, clashing=False):
    df = spark.createDataFrame(corpus() if rows is None else rows, FIELDS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    return df


def words(text):
    return WORD.findall(text or "")


def windows_removed(rows, window=50):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, b in zip(w, gone) if not b))))
    return out


def shingles(text, n=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(rows, percent=75):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(at)
    seen = set()
    for own in by.values():
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    c = len(sets[a][1] & sets[b][1])
                    if 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c):
                        parent[root(b)] = root(a)
    least = defaultdict(list)
    for at, (i, _) in enumerate(sets):
        if i is not None:
            least[root(at)].append(i)
    return [(i, len(s), None if i is None else min(least[root(at)])) for at, (i, s) in enumerate(sets)]
