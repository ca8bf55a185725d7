"""What two lists of a row have in common, and exact tests on two counts, by Arrow UDFs: linear in the row, without an exchange."""

from __future__ import annotations

import difflib
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_matches(a: list[str], b: list[str], orders: int) -> list[int]:
    """For each n-gram order up to *orders* how many of the n-grams of *a* are found in *b*, each as often as there."""
    out = []
    for n in range(orders):
        x, y = (Counter(zip(*[t[k:] for k in range(n + 1)], strict=False)) for t in (a, b))
        out.append(sum((x & y).values()))
    return out


def clipped(a: str, b: str, orders: int) -> Column:
    """clipped_matches of two columns of arrays; null arrays are empty."""

    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([clipped_matches(x or [], y or [], orders) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(F.col(a), F.col(b))


def token_f1(a: str, b: str) -> Column:
    """The F1 of two columns of tokens as multisets; 0 without a common one."""
    k = clipped(a, b, 1)[0]
    return F.when(k > 0, 2.0 * k / (F.size(a) + F.size(b))).otherwise(0.0)


def sign_probability(wins: int, losses: int) -> float:
    """Two-sided probability of a split at least as uneven, by equal chances."""
    n, low = wins + losses, min(wins, losses)
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(low + 1))
    return min(1.0, 2 * tail)


def sign_p(wins: str, losses: str) -> Column:
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([sign_probability(x, y) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(F.col(wins), F.col(losses))


def code_similarity(answer: str, truth: str) -> float:
    """The ratio of matching characters of the first line of *answer* that is neither comment nor fence with the true line."""
    line = next((x for x in answer.lstrip("\n").split("\n") if not any(m in x for m in ("`", "#", "//"))), "")
    return round(100 * difflib.SequenceMatcher(None, line, truth, autojunk=False).ratio()) / 100


def code_sim(answer: str, truth: str) -> Column:
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([code_similarity(x or "", y or "") for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(F.col(answer), F.col(truth))
