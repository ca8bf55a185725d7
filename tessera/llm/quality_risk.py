"""Quality rules with risk-controlled thresholds.

Each rule compares a feature of the text with a cutoff; a level gives the cutoffs of
all rules, and levels go from lax to strict. The level is selected by stratum (the
document's lang) on labelled good documents that the base rules pass: where k of n good documents
would be rejected by any rule, the exact binomial test P(Bin(n, alpha) <= k) must be at most
`delta` / number of strata. Levels are tested in their fixed order up to the first that fails, which
needs no further correction among them, as what a level rejects the next one rejects as well. So, with probability 1 - `delta` at
once for all strata, the rules reject at most `alpha` of a stratum's good documents. Of the
levels that pass the strictest is taken; where none passes the rules reject nothing: in a stratum with
fewer than log(delta / strata) / log(1 - alpha) labelled good documents, 86 at 5 %, 5 % and four strata.

Features are computed in one pass over whole texts; counts are summed before
the exchange; only a row for each stratum leaves it.

Defined results: an empty table gives an empty result; a null doc_id has no label; texts of any length are taken whole, and rows that tie are judged alike; a null or empty text has no words and fails the base rules; a
null lang is a stratum of its own; a document with several labels is good if
all known ones say so; repeated rows count each; other columns are handed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, discard, materialize, released

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Rule: its feature's expression and its cutoff at each level; a document is rejected if it lies above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.8, 0.7, 0.6, 0.5, 0.5, 0.4)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.3, 0.25)),
    "word_length": ("word_chars / n_words", (20.0, 14.0, 10.0, 9.0, 8.0, 7.0)),
    "capitals": ("n_capitals / word_chars", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
}
LEVELS = 6


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 1 << 20:
        codes = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        codes = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1] * k + ids[2:]
    ordered = np.argsort(codes, kind="stable")
    same = codes[ordered[1:]] == codes[ordered[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[ordered[1:][same]] = True
    twice[ordered[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def features(text: str | None) -> tuple[int, ...]:
    """The numbers of FEATURES."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at 0x20 and 0x09 to 0x0D only
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), len(data) - len(data.translate(None, CAPITALS)),
    )


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return released(map(_of_batch, batches))


def _of_batch(texts: pa.Array) -> pa.Array:
    table = np.fromiter(chain.from_iterable(features(t.as_py()) for t in texts), np.int64, len(texts) * len(FEATURES)).reshape(-1, len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(FEATURES))], list(FEATURES))


def with_features(docs: DataFrame) -> DataFrame:
    """*docs* with `_f`, a struct of FEATURES, added."""
    return bounded(docs).withColumn("_f", F.arrow_udf(_features, "struct<" + ", ".join(f"{x}: long" for x in FEATURES) + ">")(F.col("text")))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) for k below the mean: terms from k downwards, until they no longer count."""
    log_p, log_q = math.log(p), math.log1p(-p)
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, total)


def above(level: int) -> str:
    """Whether any rule rejects at *level*."""
    return " OR ".join(f"coalesce({e} > {cs[level]}D, false)" for e, cs in RULES.values())


def levels(rows: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, level: the strictest that passes, or null) of the strata with good documents.

    *rows* has doc_id, stratum and FEATURES, *labels* doc_id and quality (1: good).
    """
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q")).filter("q = 1")
    held = rows.filter(~base_failed()).join(good, F.col("doc_id") == F.col("_id"))
    counts = [F.count_if(F.expr(above(j))).alias(f"k_{j}") for j in range(LEVELS)]
    by = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "counts")
    bar = delta / max(1, by.count())

    def passed(k: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([x < alpha * m and binomial_cdf(x, m, alpha) <= bar for x, m in zip(k.to_pylist(), n.to_pylist(), strict=True)], pa.bool_())

    ok = F.arrow_udf(passed, "boolean")
    # rejections grow with the level, so all levels before one that passes pass as well
    best = F.greatest(*[F.when(ok(F.col(f"k_{j}"), F.col("n")), F.lit(j)) for j in range(LEVELS)])
    return materialize(by.select("stratum", best.alias("level")), "levels")


def stratum() -> Column:
    """Null is a stratum of its own, told apart from every text by its prefix."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def _judged(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    over = F.lit(False)
    for j in range(LEVELS):
        over = F.when(F.col("level") == j, F.expr(above(j))).otherwise(over)
    joined = rows.join(chosen, "stratum", "left").withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("level")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(doc_id, FEATURES, base_failed, kept) of every row of *docs* (doc_id, text, lang)."""
    rows = materialize(with_features(docs.select("doc_id", "lang", "text")).select("doc_id", stratum().alias("stratum"), "_f.*"), "features")
    return _judged(rows, levels(rows, labels, alpha, delta)).select("doc_id", *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """*docs* without what the rules reject; the columns stay as they are.

    Features are computed once to select levels and once to apply them, so the texts don't leave their tasks.
    """
    narrow = with_features(docs.select("doc_id", "lang", "text")).select("doc_id", stratum().alias("stratum"), "_f.*")
    held = materialize(narrow, "features")
    chosen = levels(held, labels, alpha, delta)
    discard(held)
    wide = with_features(docs.withColumn("_row", F.struct(*[F.col(c) for c in docs.columns])).select("_row", "lang", "text"))
    return _judged(wide.select("_row", stratum().alias("stratum"), "_f.*"), chosen).filter("kept").select("_row.*")
