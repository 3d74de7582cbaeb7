"""Programs in solutions: a bounded evaluator with four ways to give an answer, and grading with a time limit.

Model text never runs.  The evaluator knows assignments, ``print`` and plain arithmetic; work
and the size of numbers are bounded, so a program ends at the same place on every machine.
"""

from __future__ import annotations

import ast
import multiprocessing
import operator
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship_package

OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg}
MOST_STEPS, MOST_BITS = 100_000, 10_000
OUTCOME = "result string, report string"


class OverLimit(Exception):
    """A program that asks for more work, or larger numbers, than it may have."""


class Arithmetic:
    """One program's names and output; every program starts with the given names only."""

    def __init__(self, names: dict[str, float] | None = None):
        self.names = dict(names or {})
        self.printed: list[str] = []
        self.steps = 0

    def value(self, node: ast.AST):
        self.steps += 1
        if self.steps > MOST_STEPS:
            raise OverLimit
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return node.value
        if isinstance(node, ast.Name):
            return self.names[node.id]
        if isinstance(node, ast.UnaryOp) and type(node.op) in OPERATIONS:
            return OPERATIONS[type(node.op)](self.value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATIONS:
            return self._joined(node.op, self.value(node.left), self.value(node.right))
        raise ValueError(ast.dump(node))

    def _joined(self, sign: ast.operator, a, b):
        if isinstance(a, int) and isinstance(b, int):
            bits = a.bit_length() * b if isinstance(sign, ast.Pow) else a.bit_length() + b.bit_length()
            if bits > MOST_BITS:
                raise OverLimit
        out = OPERATIONS[type(sign)](a, b)
        if isinstance(out, complex):
            raise ValueError("not a real number")
        return out

    def run(self, lines: list[ast.stmt]) -> None:
        for line in lines:
            if isinstance(line, ast.Assign) and len(line.targets) == 1 and isinstance(line.targets[0], ast.Name):
                self.names[line.targets[0].id] = self.value(line.value)
            elif isinstance(line, ast.Expr) and isinstance(line.value, ast.Call) and getattr(line.value.func, "id", "") == "print":
                self.printed.append(" ".join(str(self.value(a)) for a in line.value.args))
            else:
                raise ValueError(ast.dump(line))

    def expression(self, text: str) -> str:
        return str(self.value(ast.parse(text.strip(), mode="eval").body))


def outcome(code: str | None, answer: str = "printed", of: str = "", names: dict[str, float] | None = None) -> tuple[str, str]:
    """``(result, report)`` of a program.

    ``answer`` says what counts: what it ``printed``, the variable ``of`` (``symbol``), the
    value of the expression ``of`` after it (``expression``), or of its own last line
    (``last_line``).  The report is ``Done``, ``Timeout Error`` beyond the limits,
    ``empty code`` for null or blank programs, else the error's kind.
    """
    if not code or not code.strip():
        return "", "empty code"
    program = Arithmetic(names)
    try:
        lines = ast.parse(code).body
        if answer == "last_line":
            program.run(lines[:-1])
            return program.expression(ast.unparse(lines[-1])), "Done"
        program.run(lines)
        if answer == "printed":
            return "\n".join(program.printed), "Done"
        return program.expression(of), "Done"
    except OverLimit:
        return "", "Timeout Error"
    except Exception as e:  # noqa: BLE001  whatever the program does wrong is its output
        return "", f"Error: {type(e).__name__}"


def arithmetic(code: str) -> tuple[str, str]:
    """What a program prints, and its report."""
    return outcome(code)


class Child:
    """A function in a process of its own, so that a call that doesn't end can be killed, C code included.

    The process is forked with the function in it and answers call after call; after a
    killed or crashed call the next one gets a new process.  ``call`` gives (value, None), or
    (None, why): the exception's name, ``TimeoutError`` or ``Crashed``.
    """

    def __init__(self, fn: Callable, seconds: float):
        self.fn, self.seconds, self.process = fn, seconds, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                arguments = pipe.recv()
            except EOFError:
                os._exit(0)
            try:
                answer = (self.fn(*arguments), None)
            except BaseException as e:  # noqa: BLE001  whatever ends a call is its answer
                answer = (None, type(e).__name__)
            try:
                pipe.send(answer)
            except Exception as e:  # noqa: BLE001  a value that can't be sent
                pipe.send((None, type(e).__name__))

    def _start(self) -> None:
        self.pipe, other = _fork.Pipe()
        self.process = _fork.Process(target=self._run, args=(other, self.pipe), daemon=True)
        self.process.start()
        other.close()

    def _run(self, pipe, parents) -> None:
        parents.close()  # so that the end of the parent ends the child
        self._serve(pipe)

    def call(self, *arguments) -> tuple[object, str | None]:
        if self.process is None:
            self._start()
        try:
            self.pipe.send(arguments)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            why = "TimeoutError"
        except (EOFError, OSError):
            why = "Crashed"
        self.close()
        return None, why

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process.close()
            self.pipe.close()
            self.process = None


_fork = multiprocessing.get_context("fork")


def executed(programs: DataFrame, code: str = "code", answer: str = "printed", of: str = "", execute: Callable[[str], tuple[str, str]] | None = None, out: str = "outcome", seconds: float = 30.0) -> DataFrame:
    """Each row with ``out``: its program's ``(result, report)``, by ``execute`` or the evaluator.

    Rows stay in place, in Arrow batches.  The evaluator is bounded in itself; ``execute`` runs
    in a process beside the task and is killed after ``seconds``.  A failing, crashed or killed
    one is its row's report (``Error: ...``, ``Timeout Error``), and the other rows are unharmed.
    """
    if answer not in ("printed", "symbol", "expression", "last_line"):
        raise ValueError(f"no way to answer: {answer}")
    ship_package(programs.sparkSession)

    @F.pandas_udf(OUTCOME)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        child = Child(execute, seconds) if execute else None

        def one(text: str | None) -> tuple[str, str]:
            if child is None:
                return outcome(text, answer, of)
            got, why = child.call(text)
            return got if why is None else ("", "Timeout Error" if why == "TimeoutError" else f"Error: {why}")

        try:
            for texts in batches:
                yield pd.DataFrame([one(t) for t in texts], columns=["result", "report"])
        finally:
            if child:
                child.close()

    return programs.withColumn(out, run(F.col(code)))


def verified(attempts: DataFrame, grade: Callable[[str | None, str | None], bool], solution: str = "solution", truth: str = "truth", seconds: float = 30.0) -> DataFrame:
    """Each row with ``correct`` and ``verify_error``: a grader's verdict, or null and why it gave none in time.

    A grader is a Python function of two texts.  It runs in a process beside the task and is
    killed after ``seconds`` (``TimeoutError``); the row's verdict is lost, no other one.
    """
    ship_package(attempts.sparkSession)

    @F.pandas_udf("correct boolean, verify_error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        child = Child(lambda given, wanted: bool(grade(given, wanted)), seconds)
        try:
            for given, wanted in batches:
                yield pd.DataFrame([child.call(a, b) for a, b in zip(given, wanted)], columns=["correct", "verify_error"], dtype=object)
        finally:
            child.close()

    graded = attempts.withColumn("_v", run(F.col(solution), F.col(truth)))
    return graded.withColumns({"correct": F.col("_v.correct"), "verify_error": F.col("_v.verify_error")}).drop("_v")


def verified_report(graded: DataFrame, source: str = "source") -> DataFrame:
    """By source: rows with a verdict, their share of right ones, and the rows without a verdict in all sources."""
    by = F.coalesce(F.col(source), F.lit("NA")).alias("source")
    count = F.sum(F.col("verify_error").isNotNull().cast("long"))
    one = graded.groupBy(by).agg(F.count("correct").alias("sample_size"), F.avg(F.col("correct").cast("double")).alias("accuracy"), count.alias("_errors"))
    everywhere = one.agg(F.coalesce(F.sum("_errors"), F.lit(0)).alias("num_verify_error"))  # one row
    return one.drop("_errors").crossJoin(F.broadcast(everywhere))
