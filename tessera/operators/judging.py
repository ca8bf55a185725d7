"""Judgements of answers and evidence, search modes, and coercions of judged fields."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as x
from tessera.operators import chunkers, overlaps

#: Fixed value: the answer that stands for "can't be told".
UNDETERMINED = "无法推断"
#: Spellings of false.
FALSE = ("0", "false", "no", "否", "不可回答")
#: Fixed value: scores below it call for a change.
LOW_SCORE = 75
#: The module that answers for each score.
MODULES = {"context_utilization": "C_t", "answer_completeness": "I_t", "noise_misuse_rate": "I_t_denoise", "uncertainty_expression": "U_t"}


def evidence_hit(df: DataFrame, gold: str, found: str, least: int = 8, overlap: float = 0.60) -> DataFrame:
    """*df* with `hit`: the found text holds the gold text or is held by it, or their tokens' F1 reaches *overlap*.

    Both are compared without white space and in lower case. Gold texts shorter than *least* and empty or null texts never hit;
    a found text shorter than *least* isn't searched for in the gold.
    """
    both = df.withColumns({"_g": F.lower(x.compact(F.col(gold))), "_f": F.lower(x.compact(F.col(found)))})
    both = both.withColumns({"_tg": x.tokens(F.col("_g")), "_tf": x.tokens(F.col("_f"))})
    inside = F.contains("_f", F.col("_g")) | ((F.length("_f") >= least) & F.contains("_g", F.col("_f")))
    hit = (F.length("_g") >= least) & (F.length("_f") > 0) & (inside | (overlaps.token_f1("_tf", "_tg") >= overlap))
    return both.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_g", "_f", "_tg", "_tf")


def quest_eval(df: DataFrame, group: str, truth: str, given: str) -> DataFrame:
    """(group, n, recall, f1) over answers to the same questions: of those that the true text answers, the share that the
    given text answers too, and of these the mean F1 of tokens; 0 where there is none."""
    key = F.col(group).alias("_group")
    asked = df.filter(F.col(truth) != UNDETERMINED).select(key, F.col(given).alias("_given"), x.tokens(F.col(truth)).alias("_tt"), x.tokens(F.col(given)).alias("_tg"))
    told = F.coalesce(F.col("_given") != UNDETERMINED, F.lit(False))
    by = asked.withColumn("_f", F.when(told, overlaps.token_f1("_tg", "_tt"))).groupBy("_group")
    sums = by.agg(F.count("*").alias("n"), F.count("_f").alias("told"), F.coalesce(F.avg("_f"), F.lit(0.0)).alias("f1"))
    every = df.select(key).distinct().join(sums, "_group", "left")
    share = F.coalesce(F.col("told") / F.col("n"), F.lit(0.0)).alias("recall")
    return every.select(F.col("_group").alias(group), F.coalesce("n", F.lit(0)).alias("n"), share, F.coalesce("f1", F.lit(0.0)).alias("f1"))


def low_scores(scores: dict[str, Column], threshold: float = LOW_SCORE) -> Column:
    """The names of the scores below *threshold*, in the order given; null scores aren't low."""
    return F.filter(F.array(*[F.when(s < threshold, F.lit(n)) for n, s in scores.items()]), lambda n: n.isNotNull())


def modules(low: Column) -> Column:
    """The modules that answer for the scores of these names."""
    known = F.create_map(*[F.lit(v) for pair in MODULES.items() for v in pair])
    return F.transform(low, lambda n: F.try_element_at(known, n))


def as_bool(value: Column, default: bool = True) -> Column:
    """False for the known spellings of it, else true; null is *default*."""
    return F.coalesce(~F.lower(F.btrim(value)).isin(*FALSE), F.lit(default))


def first_keywords(text: Column, keywords: dict[str, list[str]]) -> Column:
    """(dim, match) structs: for each dim its first keyword that the text holds, whatever the case; dims without one are left out."""
    low = F.lower(text)
    first = [F.struct(F.lit(d).alias("dim"), F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in ks or [d]]).alias("match")) for d, ks in keywords.items()]
    return F.filter(F.array(*first), lambda s: s["match"].isNotNull())


def information_gain(a: str, b: str) -> Column:
    """1 / (1 + distance) of two columns of texts by their characters' cosine; null or empty texts have cosine 0."""

    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        pairs = zip(xs.to_pylist(), ys.to_pylist(), strict=True)
        return pa.array([1 / (2 - max(-1.0, min(1.0, chunkers.char_cosine(p or "", q or "")))) for p, q in pairs], pa.float64())

    return F.arrow_udf(run, "double")(F.col(a), F.col(b))


def search(mode: str, sem: DataFrame, dim: DataFrame, fused: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank, mode) by *mode*: `sem`, `dim` or `fusion`. A query without a fused row falls back to `sem`."""
    cut = lambda df, name: df.filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", F.lit(name).alias("mode"))
    if mode in ("sem", "dim"):
        return cut(sem if mode == "sem" else dim, mode)
    if mode != "fusion":
        raise ValueError(f"unknown mode: {mode}")
    kept = cut(fused, "fusion")
    return kept.unionByName(cut(sem, "fallback").join(kept.select("query_id").distinct(), "query_id", "left_anti"))
