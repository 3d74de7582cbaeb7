r"""A reader of LaTeX answers: tokens, a recursive-descent parser to a tree, and two renderings.

A node is a text, a group (a list of nodes), a command with its optional and braced arguments,
or a script (``^`` or ``_`` with its node).  ``plain`` writes what graders compare, as
text converters do: a fraction is its two parts with a slash, groups lose their braces.
``expression`` keeps the structure with parentheses, for calculation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Unreadable(ValueError):
    """Braces that don't match, or a command that lacks an argument."""


@dataclass
class Command:
    name: str
    arguments: list = field(default_factory=list)
    optional: list | None = None


@dataclass
class Script:
    sign: str
    node: object


#: How many arguments a command has; those not named here have none.
ARGUMENTS = {"frac": 2, "tfrac": 2, "dfrac": 2, "cfrac": 2, "binom": 2, "sqrt": 1} | dict.fromkeys(
    ("text", "textbf", "textit", "textrm", "mbox", "mathrm", "mathbf", "mathbb", "mathit", "mathcal", "mathsf", "operatorname", "boxed", "fbox", "overline", "underline", "bar", "hat", "vec"), 1)
FRACTIONS = {"frac", "tfrac", "dfrac", "cfrac"}
#: What single commands are as plain text; of those not named here nothing is left.
PLAIN = {
    "pi": "pi", "infty": "inf", "cup": "U", "cdot": "*", "times": "*", "cap": "∩", "pm": "±", "mp": "∓", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "in": "∈", "div": "÷", "circ": "∘",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "theta": "θ", "lambda": "λ", "mu": "μ", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "ϕ", "omega": "ω", "Delta": "Δ", "Omega": "Ω",
    "sin": "sin", "cos": "cos", "tan": "tan", "log": "log", "ln": "ln", "exp": "exp", "max": "max", "min": "min", "%": "%", "$": "$", "{": "{", "}": "}", "&": "&", "#": "#", "_": "_", "ldots": "…", "dots": "…",
}
CALCULATED = {"pi": "pi", "cdot": "*", "times": "*", "div": "/", "infty": "inf", "left": "", "right": ""} | {n: n for n in ("sin", "cos", "tan", "log", "ln", "exp")}
TOKEN = re.compile(r"\\(?:[A-Za-z]+|.)|\s+|[^\\\s]", re.S)
FUNCTION_NAMES = ("sin", "cos", "tan", "log", "ln", "exp")


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, TOKEN.findall(text), 0
        if sum(map(len, self.tokens)) != len(text):  # a lone backslash at the end
            raise Unreadable(text)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def skip_space(self) -> None:
        while self.peek()[:1].isspace():
            self.at += 1

    def nodes(self, end: str = "") -> list:
        out = []
        while (t := self.peek()) != end:
            if not t or t == "}":
                raise Unreadable(self.text)
            out.append(self.node())
        return out

    def group(self, end: str) -> list:
        self.at += 1
        out = self.nodes(end)
        self.at += 1
        return out

    def node(self):
        t = self.peek()
        if t == "{":
            return self.group("}")
        if t in "^_":
            self.at += 1
            self.skip_space()
            return Script(t, self.argument())
        if t[0] == "\\" and len(t) > 1:
            return self.command()
        return self.take()

    def argument(self):
        """A braced group, a command or a single character."""
        self.skip_space()
        if not self.peek() or self.peek() == "}":
            raise Unreadable(self.text)
        return self.node()

    def command(self) -> Command:
        out = Command(self.take()[1:])
        count = ARGUMENTS.get(out.name, 0)
        if out.name == "sqrt":
            self.skip_space()
            if self.peek() == "[":
                out.optional = self.group("]")
        out.arguments = [self.argument() for _ in range(count)]
        return out


def read(text: str) -> list:
    """The tree of a text; Unreadable if braces don't match or an argument is missing."""
    return _Reader(text).nodes()


def plain(node) -> str:
    """Plain text: roots keep parentheses, fractions a space before and a slash, other groups nothing."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(map(plain, node))
    if isinstance(node, Script):
        return node.sign + plain(node.node)
    parts = [plain(a) for a in node.arguments]
    if node.name in FRACTIONS:
        return " " + "/".join(parts)
    if node.name == "sqrt":
        return f"sqrt({parts[0]})"
    return "".join(parts) if parts else PLAIN.get(node.name, "")


def expression(node) -> str:
    """An expression with the tree's structure; Unreadable for what can't be calculated."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        out, before = [], None
        for x in node:
            if isinstance(x, Command) and x.name in FRACTIONS and isinstance(before, str) and before.isdigit():  # a mixed number
                out.append("+" + expression(x))
                start = len(out) - 1
                while start and isinstance(out[start - 1], str) and re.fullmatch(r"[\d.]", out[start - 1]):
                    start -= 1
                out[start:] = ["(" + "".join(out[start:]) + ")"]
            else:
                out.append(expression(x))
            if not (isinstance(x, str) and x.isspace()):
                before = x
        return "".join(out)
    if isinstance(node, Script):
        if node.sign == "_":
            raise Unreadable("subscript")
        inner = expression(node.node)
        return "^" + (inner if len(inner) == 1 else f"({inner})")
    parts = [expression(a) for a in node.arguments]
    if node.name in FRACTIONS:
        return f"(({parts[0]})/({parts[1]}))"
    if node.name == "sqrt":
        if node.optional is None or expression(node.optional).strip() == "2":
            return f"sqrt({parts[0]})"
        return f"(({parts[0]})^(1/({expression(node.optional)})))"
    if parts and node.name != "binom":
        return parts[0]
    if node.name not in CALCULATED:
        raise Unreadable(node.name)
    return CALCULATED[node.name]
