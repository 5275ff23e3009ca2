"""Scorers as batch functions, with an offline one that needs no service.

A scorer takes a pandas frame of prompts and returns scores; failures become an error column, never an exception of
the job. Results should be written before they are aggregated, so that a lost executor never scores twice.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SCORED = "item_id long, correctness string, total double, error string"
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def offline_scorer(frame: pd.DataFrame) -> pd.DataFrame:
    """Scores an answer by its share of distinct words and its length against the question's; depends on nothing else."""
    total = [min(5.0, 1.0 + 4.0 * len(set(a.split())) / max(1, len(a.split()))) if a else 0.0 for a in frame["answer"].fillna("")]
    label = ["right" if t >= 4 else "partial" if t >= 2.5 else "wrong" for t in total]
    return pd.DataFrame({"item_id": frame["item_id"], "correctness": label, "total": total, "error": None})


def score(prompts: DataFrame, scorer: Scorer = offline_scorer, per_minute: float | None = None) -> DataFrame:
    """Scores each row. The columns handed over must not hold a reference. per_minute spaces the batches of a partition,
    so concurrency is the number of partitions."""
    if "reference" in prompts.columns:
        raise ValueError("scorers must not see references")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            began = time.monotonic()
            try:
                yield scorer(frame)
            except Exception as error:  # noqa: BLE001 - a failed call is a result
                yield pd.DataFrame({"item_id": frame["item_id"], "correctness": None, "total": None, "error": f"{type(error).__name__}: {error}"})
            if per_minute:
                time.sleep(max(0.0, 60.0 * len(frame) / per_minute - (time.monotonic() - began)))

    return prompts.mapInPandas(run, SCORED)


_PIECE = re.compile(r"\s*(\d+\.\d*|\.\d+|\d+|\*\*|//|[-+*/%()])")


def arithmetic(text: str, most_digits: int = 300) -> float:
    """The value of numbers with + - * / // % ** and brackets, powers binding from the right; ValueError for anything else, for a
    division by zero and for powers of more than `most_digits` digits."""
    pieces, at = [], 0
    while at < len(text.rstrip()):
        found = _PIECE.match(text, at)
        if not found:
            raise ValueError(f"not arithmetic at {at}")
        pieces.append(found[1])
        at = found.end()
    pieces.append("")
    values: list[float] = []
    pending: list[str] = []
    rank = {"(": 0, "+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "neg": 3, "**": 4}

    def apply() -> None:
        name = pending.pop()
        if name == "(":
            raise ValueError("bracket left open")
        if name == "neg":
            values[-1] = -values[-1]
            return
        b, a = values.pop(), values.pop()
        if name == "**" and abs(a) > 1 and abs(b) * math.log10(abs(a)) > most_digits:
            raise ValueError("power too large")
        try:
            values.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "//": lambda: a // b, "%": lambda: a % b, "**": lambda: a**b}[name]())
        except ArithmeticError as error:
            raise ValueError(str(error)) from error

    operand = True  # whether a number or a bracket is due
    for piece in pieces:
        if operand:
            if piece == "-":
                pending.append("neg")
            elif piece == "(":
                pending.append("(")
            elif piece[:1].isdigit() or piece[:1] == ".":
                values.append(float(piece) if "." in piece else int(piece))
                operand = False
            elif piece != "+":
                raise ValueError("number missing")
        elif piece == ")" or not piece:
            while pending and pending[-1] != "(":
                apply()
            if bool(pending) != (piece == ")"):
                raise ValueError("brackets do not match")
            if piece:
                pending.pop()
        elif piece in rank and piece != "(":
            while pending and (rank[pending[-1]] > rank[piece] or (rank[pending[-1]] == rank[piece] and piece != "**")):
                apply()
            pending.append(piece)
            operand = True
        else:
            raise ValueError("operator missing")
    if isinstance(values[0], complex):
        raise ValueError("not a real number")
    return float(values[0])


@F.pandas_udf(DoubleType())
def evaluated(text: pd.Series) -> pd.Series:
    """The value of each text's arithmetic; null where it has none."""

    def one(expression: str | None) -> float | None:
        try:
            value = arithmetic(expression or "")
            return value if math.isfinite(value) else None
        except (ValueError, OverflowError):
            return None

    return pd.Series([one(x) for x in text], dtype="float64")
