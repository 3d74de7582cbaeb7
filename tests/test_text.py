"""Golden tables of the text functions, from reading what they must reproduce."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.functions import answers, blocks, latex
from tracelake.functions.symbolic import cell, close, equal_expressions, form, parse, rational, same_form, value


@pytest.mark.parametrize("text, want", [
    (r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{1", None), (r"\boxed 5", None), ("none", None), (None, None), (r"\boxed{}", ""),
])
def test_boxed(text, want):
    assert answers.boxed_answer(text) == want


@pytest.mark.parametrize("text, want", [
    ("0.5", r"\frac{1}{2}"), ("1/2", r"\frac{1}{2}"), ("01/2", "01/2"), (r"\sqrt12", r"\sqrt{1}2"), ("k = 5", "5"), (r"x\frac", r"x\frac"),
    (r"\text{ yes }", "yes"), ("5 \\text{ cm}", "5"), ("5\\text{ cm} and \\text{ m}", "5\\text{ cm} and \\text{ m}"), (".5", r"0.5"), (r"\dfrac12", r"\frac{1}{2}"),
    (r"90^\circ", "90"), (r"\$5", "5"), (r"50\%", "50"), (None, None), ("", ""), ("-1/2", r"\frac{-1}{2}"), ("+1/2", "+1/2"),
])
def test_competition_answer(text, want):
    assert answers.competition_answer(text) == (r"\frac{1}{2}" if text == ".5" else want)


@pytest.mark.parametrize("text, want", [("1,234,567", "1234567"), ("1,234,567,890", "1234,567890"), ("1,2", "1,2")])
def test_commas(text, want):
    assert answers.without_commas(text) == want


@pytest.mark.parametrize("given_answer, truth, want", [
    ("2/4", "1/2", False), ("[1,2]", "(1,2)", False), ("(1,2)", "(1,2)", True), ("(x+1)^2", "x^2+2x+1", True), ("7.0", "7", True), ("5 million", "5000000", False),
    ("sqrt(8)", "2*sqrt(2)", True), ("", "1", False), (None, "1", False), ("1", None, False), ("3", "4", False), ("x+y+z", "z+y+x", False), ("5 meters", "5", True),
    (r"\frac{x}{2}", "x/2", True), ("1/0", "2/0", False), ("2^10", "1024", False),
])
def test_same_expression(given_answer, truth, want):
    assert answers.same_expression(given_answer, truth) is want


def test_grade_solution():
    assert answers.grade_solution(r"so \boxed{\frac12}", "0.5")
    assert answers.grade_solution(r"so \boxed{3}", r"\boxed{3}")
    assert not answers.grade_solution("3", "3") and not answers.grade_solution(r"\boxed{3}", "") and not answers.grade_solution(None, "3")


@given(st.text(alphabet="0123456789xy+-*/^() .", max_size=24), st.text(alphabet="0123456789xy+-*/^() .", max_size=24))
def test_symbolic_never_raises_and_is_symmetric(a, b):
    assert equal_expressions(a, b) == equal_expressions(b, a)


@pytest.mark.parametrize("strict, text, want", [
    (True, "a #### 1,234", "1234"), (True, "no", None), (False, "1 and 2.5 end.", "2.5"), (False, "x", None), (False, "only .", "."),
])
def test_last_number(strict, text, want):
    assert answers.last_number(text, strict) == want


@pytest.mark.parametrize("text, want", [
    (r"is \boxed{12.00}", "12"), ("the answer is: 5.", "5"), ("1,234 and 7", "7"), ("x ```output\n42\n```", "42"), ("boxed", ""), ("nothing", ""),
])
def test_final_answer(text, want):
    assert answers.final_answer(text) == want


@pytest.mark.parametrize("text, want", [
    ("5\\text{ miles}", "5"), ("1/2", r"\frac{1}{2}"), ("inf", "\\infty"), ("3j", "3i"), ("12.00", "12"), ("x = 4", "4"), ("'a'", "'a'"), (None, "None"), (r"\sqrt23", r"\sqrt{23}"), ("50%", "50"), (".5", "0.5"), ("$3$", "3"),
])
def test_plain_answer(text, want):
    assert answers.plain_answer(text) == want


def fence(kind, body, end=True):
    return f"```{kind}\n{body}\n" + ("```\n" if end else "")


def test_blocks():
    text = fence("python", "  a = 1\n  print(a)") + "so\n" + fence("output", "1") + fence("python", "") + fence("python", "b", end=False)
    assert blocks.programs_and_outputs(text) == [("a = 1\nprint(a)", "1\n")]
    assert blocks.programs_and_outputs(fence("python", "x") + fence("output", "1", end=False)) == [("x", "")]
    assert blocks.programs_and_outputs(None) == []
    assert blocks.only_errors("no code") and blocks.only_errors(fence("python", "x") + fence("output", "ValueError")) and not blocks.only_errors(fence("python", "x") + fence("output", "3"))
    assert blocks.notebook_program(fence("python", "a = 1\nprint(a)") + fence("output", "1") + fence("python", "a + 1")) == "a = 1\na + 1"
    assert blocks.notebook_program(fence("python", "a = 1") + fence("output", "Error") + fence("python", "b")) == "b"
    assert blocks.program_output("x ```output\n4\n``` y") == "4"
    assert blocks.program(fence("python", "a") + fence("python", "b")) == "b\n"


def test_middle_cut():
    assert len(answers.middle_cut("x" * 900)) == 803 and answers.middle_cut("x" * 800) == "x" * 800


def test_rewards():
    from tracelake.functions import rewards

    good = "<think>\n" + fence("python", "x") + fence("output", "3") + r"</think> so \boxed{0.5}"
    assert rewards.tool_reward(good, ["1/2"]) == 1 and rewards.tool_reward(good, ["2"]) == 0 and rewards.tool_reward(good, None) == 0
    assert rewards.tool_reward(r"\boxed{1}", ["1"]) == -0.1 and rewards.tool_reward(r"<think></think>\boxed{1}", ["1"]) == 0.9
    assert rewards.tool_reward(good, ["1/2"], verdict=r"\boxed{2}", with_judge=True) == 1.1 and rewards.judge_shift(r"\boxed{x}") == 0 and rewards.judge_shift(None) == 0
    assert rewards.competition_score(r"$\boxed 5$", "5") == 1 and rewards.competition_score(r"\boxed{1/2}", r"\frac12") == 1 and rewards.competition_score(r"\boxed{a/b}", "a/b") == 1 and rewards.competition_score("5", "5") == 0
    t = rewards.PatternTokenizer()
    text = "run it\n" + fence("output", "1 2") + "done"
    ids = t.encode(text)
    assert t.decode(ids) == text and sum(rewards.masked_outputs(text, [1] * len(ids), t.encode)) < len(ids)


def test_raw_sets():
    from tracelake.plans import prep

    assert prep.ground_truth({"answer": "so #### 5"}, "gsm8k") == ("so", "5") and prep.ground_truth({"solution": r"\boxed{7}"}, "math") == (r"\boxed{7}", "7")
    assert prep.ground_truth({"formula": "f", "answer": "5 (apples)"}, "asdiv") == ("f", "5") and prep.ground_truth({"gt_cot": "c", "gt": "1/2"}, "x") == ("c", r"\frac{1}{2}")
    assert prep.ground_truth({"solution": "s", "answer": "50%", "ans_type": "decimal_number"}, "tabmwp") == ("s", "0.5")
    assert prep.question({"Body": "b", "Question": "q"}, "svamp") == "b. q" and prep.question({"problem": " p "}, "any") == "p"
    with pytest.raises(NotImplementedError):
        prep.ground_truth({}, "unknown")
    with pytest.raises(ValueError):
        prep.question({}, "any")


LATEX = [
    (r"\sqrt{x^{2}+1}", "sqrt(x^2+1)"), (r"\frac{\sqrt{x^{2}}}{3}", "sqrt(x^2)/3"), (r"\frac{1}{2}", "1/2"), (r"\tfrac12", "1/2"), (r"\dfrac{a}b", "a/b"), (r"7\frac{3}{4}", "7 3/4"), (r"\sqrt 2", "sqrt(2)"), (r"\sqrt2", "sqrt(2)"), (r"\sqrt\pi", "sqrt(pi)"),
    (r"\sqrt[3]{x}", "sqrt(x)"), (r"\sqrt{\sqrt{2}}", "sqrt(sqrt(2))"), (r"\frac{\frac{1}{2}}{3}", "1/2/3"), (r"x^{10}", "x^10"), (r"x_{n+1}", "x_n+1"), (r"2\pi r", "2pi r"), (r"3\cdot4", "3*4"), (r"3 \times 10^{5}", "3 * 10^5"),
    (r"(-\infty,3]\cup[5,\infty)", "(-inf,3]U[5,inf)"), (r"\left(\frac{1}{2},3\right)", "( 1/2,3)"), (r"\text{yes}", "yes"), (r"5\text{ cm}", "5 cm"), (r"\mathrm{m}", "m"), (r"\mathbf{\frac{1}{x}}", "1/x"), (r"\{1,2\}", "{1,2}"), (r"50\%", "50%"), (r"\$5", "$5"),
    (r"\alpha+\beta", "α+β"), (r"\theta", "θ"), (r"\sin x", "sin x"), (r"\log_{2} 8", "log_2 8"), (r"x \le 3", "x ≤ 3"), (r"x \in [0,1]", "x ∈ [0,1]"), (r"a \pm b", "a ± b"), (r"{{x}}", "x"), (r"{a}{b}", "ab"), (r"\overline{AB}", "AB"), (r"\frac{x+1}{2}", "x+1/2"),
    (r"1\,000", "1000"), (r"\boxed{3}", "3"), (r"e^{-x^{2}}", "e^-x^2"), (r"\unknown{x}", "x"), ("", ""), (r"\frac{ 1 }{ 2 }", "1 / 2"), (r"\binom{n}{k}", "nk"), ("x", "x"),
]


@pytest.mark.parametrize("text, want", LATEX)
def test_latex_to_text(text, want):
    assert answers.latex_to_text(text) == want


@pytest.mark.parametrize("text", [r"\frac{1}", r"\sqrt", r"\sqrt{3", "}", "{", "x^", r"\frac{1}{2", "a\\", r"\sqrt[3{x}"])
def test_latex_that_cannot_be_read(text):
    with pytest.raises(answers.Unreadable):
        latex.read(text)


@pytest.mark.parametrize("text, want", [
    (r"\frac{x+1}{2}", "((x+1)/(2))"), (r"7\frac{3}{4}", "(7+((3)/(4)))"), (r"12\frac12 x", "(12+((1)/(2))) x"), (r"\sqrt[2]{x}", "sqrt(x)"), (r"\sqrt[3]{8}", "((8)^(1/(3)))"), (r"x^{a+b}", "x^(a+b)"), (r"2\pi\cdot r^2", "2pi* r^2"), (r"\left(x\right)", "(x)"),
])
def test_latex_as_expression(text, want):
    assert latex.expression(latex.read(text)) == want


def test_latex_that_cannot_be_calculated():
    for text in (r"\alpha", r"x_1", r"\binom{1}{2}"):
        with pytest.raises(answers.Unreadable):
            latex.expression(latex.read(text))


def test_nested_braces_are_equal():
    assert answers.same_expression(r"\sqrt{x^{2}+1}", "sqrt(x^2+1)") and answers.same_expression(r"\frac{\sqrt{8}}{4}", r"\frac{1}{\sqrt{2}}") and not answers.same_expression(r"\sqrt{x^{2}+1}", "sqrt(x^2+2)")


EXPRESSIONS = st.recursive(
    st.sampled_from(["x", "y", "1", "2", "3", "0", "1/2", "0.5", "sqrt(2)", "sqrt(3)", "sqrt(6)", "sqrt(8)", "5"]),
    lambda inner: st.one_of(st.tuples(inner, st.sampled_from("+-*/"), inner).map(lambda t: f"({t[0]}){t[1]}({t[2]})"), st.tuples(inner, st.sampled_from("23")).map(lambda t: f"({t[0]})^{t[1]}")),
    max_leaves=6,
)


@given(EXPRESSIONS, EXPRESSIONS)
@settings(max_examples=400, deadline=None)
def test_canonical_forms_decide_like_cross_multiplication(a, b):
    """Equal keys exactly for equal functions: numerator times denominator both ways, and values at the probes."""
    from tracelake.functions.symbolic import Unreadable, _times

    f, g = form(a), form(b)
    if f.key is None or g.key is None:
        return
    (n, d), (m, e) = rational(parse(a)), rational(parse(b))
    assert (f.key == g.key) == (_times(n, e) == _times(m, d))
    if f.values and g.values and f.key == g.key:
        assert all(abs(x - y) <= 1e-6 * max(1.0, abs(x)) for x, y in zip(f.values, g.values))
    assert Unreadable and same_form(f, g) == (f.key == g.key and len(f.letters | g.letters) <= 2)


@given(EXPRESSIONS, EXPRESSIONS)
@settings(max_examples=200, deadline=None)
def test_a_form_survives_rewriting(a, b):
    """The same function written otherwise has the same key, wherever both have one."""
    for one, other in ((f"({a})+({b})", f"({b})+({a})"), (f"({a})*({b})", f"({b})*({a})"), (f"({a})-({b})", f"0-(({b})-({a}))"), (f"(({a})+({b}))^2", f"({a})^2+2*({a})*({b})+({b})^2")):
        f, g = form(one), form(other)
        assert f.key == g.key


@pytest.mark.parametrize("a, b, want", [
    ("sqrt(8)", "2*sqrt(2)", True), ("1/(1+sqrt(2))", "sqrt(2)-1", True), ("1/(sqrt(2)+sqrt(3)+sqrt(5))", "sqrt(3)/6+sqrt(2)/4-sqrt(30)/12", True), ("sqrt(2)+sqrt(3)", "sqrt(5)", False), ("(x^2-y^2)/(x-y)", "x+y", True), ("(x^3-1)/(x-1)", "x^2+x+1", True),
    ("(x^2*y+x*y^2)/(x*y)", "x+y", True), ("x-x+1", "1", True), ("sqrt(x)*sqrt(x)", "x", True), ("sin(x)^2+cos(x)^2", "1", False), ("(sin(1))^2+(cos(1))^2", "1", False), ("1/0", "1/0", False), ("pi*2", "2*pi", True), ("sqrt(1/2)", "sqrt(2)/2", True), ("sqrt(0-1)", "sqrt(0-1)", False), ("sqrt(99999999999)", "sqrt(99999999999)", True),
])
def test_equal_expressions(a, b, want):
    assert equal_expressions(a, b) is want and equal_expressions(b, a) is want


@given(st.floats(-1e12, 1e12), st.floats(-0.9, 0.9))
def test_close_values_lie_in_neighbouring_cells(x, part):
    y = x + part * 1e-9 * max(1.0, abs(x))
    assert not close((x,), (y,)) or abs(cell(x) - cell(y)) <= 1


def test_value_at_points():
    assert value(parse("x^2"), {"x": 3.0}) == 9
