"""Grading of distinct pairs, and answers grouped by canonical form, against pairwise comparison."""

import random

from tracelake.functions import answers, symbolic
from tracelake.operators import evaluation, grading


def spelled(r: random.Random) -> str | None:
    v = r.choice([0, 1, 2, 3, 7])
    return r.choice([f"{v}", f"{2 * v}/2", f"{v}.0", f"sqrt({v * v})", f"x-x+{v}", f"{v}*sqrt(x)^2/x", f"{v}*sqrt(2)*sqrt(2)/2", f"x+{v}", f"{v}+x", f"({v}*x^2+x^3)/x^2", f"sqrt(x)*sqrt(x)+{v}", f"x+y+{v}-y", f"what {v}", f"x+y+z+{v}", None, "1/0", "sqrt(0-2)", f"sqrt({v}+2)", f"({v}+2)/sqrt({v}+2)"])


def clusters(rows):
    """(order, answer) to the first of its class, one by one in order."""
    groups, out = [], {}
    for at, a in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        found = next((g for g in groups if g[1] == a or None not in (g[1], a) and symbolic.equal_expressions(g[1], a)), None)
        if not found:
            found = (at, a)
            groups.append(found)
        out[at] = found
    return out


def test_classes_equal_pairwise_clusters(spark):
    r = random.Random(8)
    rows = [(p, spelled(r), k) for k, p in enumerate(r.choice([1, 2, 3, None]) for _ in range(500))]
    want = set()
    for p in {x[0] for x in rows}:
        named = clusters([(k, a) for q, a, k in rows if q == p])
        want |= {(p, a, *named[k]) for q, a, k in rows if q == p}
    df = spark.createDataFrame(rows, "p long, a string, at long").repartition(3)
    got = grading.classes_by_form(df, "p", "a", "at").collect()
    assert {(x.p, x.answer, x.class_first, x.class_answer) for x in got} == want
    assert sum(x.votes for x in got) == len(rows)
    old = evaluation.majority_by_equality(df, "p", "a", "at", symbolic.equal_expressions)
    assert sorted(map(str, grading.majority_by_form(df, "p", "a", "at").collect())) == sorted(map(str, old.collect()))
    assert grading.majority_by_form(df.limit(0), "p", "a", "at").count() == 0


def test_many_answers_of_one_problem(spark):
    """No task holds a problem: its answers meet by key and by grid cell."""
    n = 20_000
    rows = [(1, f"{k}", k) for k in range(n)] + [(1, f"{2 * k}/2", n + k) for k in range(n)] + [(1, f"{k}*sqrt(x)^2/x", 2 * n + k) for k in range(0, n, 40)] + [(1, "sqrt(x)*sqrt(x)/x*77", 5 * n)]
    df = spark.createDataFrame(rows, "p long, a string, at long")
    got = grading.majority_by_form(df, "p", "a", "at")
    assert [tuple(x) for x in got.collect()] == [(1, "0", 3)]
    assert "77" in {x.class_answer for x in grading.classes_by_form(df, "p", "a", "at").where("answer like '%*77'").collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "FlatMapGroups" not in plan and "Window" not in plan


def test_graded_pairs(spark):
    r = random.Random(9)
    texts = [spelled(r) for _ in range(12)] + [r"\frac{1}{2}", "(1,2)", "[1,2]", "", None]
    rows = [(k, r.choice(texts), r.choice(texts)) for k in range(400)]
    got = grading.graded(spark.createDataFrame(rows, "k long, given string, truth string"), "given", "truth").collect()
    assert sorted((x.k, x.same) for x in got) == [(k, answers.same_expression(a, b)) for k, a, b in rows]
    assert grading.graded(spark.createDataFrame([], "k long, given string, truth string"), "given", "truth").count() == 0
