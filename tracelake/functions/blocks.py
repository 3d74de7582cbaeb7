"""Fenced programs and their outputs in generated text."""

from __future__ import annotations

import re
import textwrap
from dataclasses import dataclass

FENCE = "```"
PROGRAM, OUTPUT = FENCE + "python", FENCE + "output"


@dataclass
class Block:
    """Lines between an opening fence and the next bare fence; ``closed`` is False if the text ends first."""

    lines: list[str]
    closed: bool
    after: int

    @property
    def text(self) -> str:
        return "".join(line + "\n" for line in self.lines)


def _block(lines: list[str], start: int) -> Block:
    for i in range(start, len(lines)):
        if lines[i].strip() == FENCE:
            return Block(lines[start:i], True, i + 1)
    return Block(lines[start:], False, len(lines))


def _dedented(code: str) -> str:
    """Common leading white space off; blank lines as they are, no final newline."""
    lines = code.splitlines()
    margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[margin:] if x.strip() else x for x in lines)


def programs_and_outputs(text: str | None) -> list[tuple[str, str]]:
    """Closed, non-empty programs with the output block that follows before the next program, or ``""``."""
    lines, out, at = (text or "").split("\n"), [], 0
    while at < len(lines):
        if lines[at].strip() != PROGRAM:
            at += 1
            continue
        program = _block(lines, at + 1)
        at = program.after
        if not program.closed or not program.text.strip():
            continue
        output = ""
        for i in range(at, len(lines)):
            mark = lines[i].strip()
            if mark == PROGRAM:
                break
            if mark == OUTPUT:
                found = _block(lines, i + 1)
                if found.closed:
                    output, at = found.text, found.after
                break
        out.append((_dedented(program.text), output))
    return out


def program(text: str, last_only: bool = True) -> str:
    """Lines of program fences, the last one's or all joined by a ruler."""
    parts, inside = [], False
    for line in text.split("\n"):
        if line.startswith(PROGRAM):
            parts, inside = ([""] if last_only else [*parts, "\n# ========\n"]), True
        elif line.startswith(FENCE):
            inside = False
        elif inside:
            parts[-1] += line + "\n"
    return "".join(parts)


def program_output(text: str) -> str:
    """Contents of the last output fence."""
    return text.split(OUTPUT)[-1].split(FENCE)[0].strip() if OUTPUT in text else ""


#: Line starts that only show results.
SHOWING = ("print", "sp.pprint", "sympy.pprint", "pprint", "rprint")


def notebook_program(text: str | None) -> str:
    """The last program after the state of earlier ones: those without errors, less their showing lines."""
    found = programs_and_outputs(text)
    if not found:
        return ""
    state = ""
    for code, output in found[:-1]:
        if PROGRAM in code or not code.strip() or re.search("error|exception|traceback", output.lower()):
            continue
        kept = "".join(line + "\n" for line in code.split("\n") if line.strip() and not line.startswith(SHOWING))
        state += "" if "print" in kept else kept
    return state + found[-1][0].split(PROGRAM)[-1]


def only_errors(text: str | None) -> bool:
    """Whether no program ran well: each output is empty, an error, or says nothing; true without programs."""
    quiet = ("", "Done", "[]")
    return all(o.strip() in quiet or re.search("error|exception|traceback", o.lower()) is not None for _, o in programs_and_outputs(text))


def output_spans(text: str | None) -> list[tuple[int, int]]:
    """Character spans of output blocks, fences included."""
    return [m.span() for m in re.finditer(r"```output.*?```", text or "", re.DOTALL)]


def collapse_repeats(text: str, token: str, most: int = 4) -> str:
    """Per line, more than ``most`` repeats of a token become ``most``; blank lines go."""
    run = re.compile(f"(?:{re.escape(token)}){{{most + 1},}}")
    return "\n".join(run.sub(token * most, line) for line in text.split("\n") if line.strip())
