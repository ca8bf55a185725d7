"""Scores of generation tasks (summary, continuation, edit): each text against its reference, and by task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as x
from tessera.operators import chunkers, overlaps

METRICS = ("bleu_avg", "bleu_1", "bleu_2", "bleu_3", "bleu_4", "rouge_l", "length")


def scores(rows: DataFrame) -> DataFrame:
    """*rows* (task, id, reference, generated) with METRICS and `valid` in place of the texts: a blank or null text is not valid, and scores 0."""
    words = rows.select("task", "id", x.tokens(F.coalesce("reference", F.lit(""))).alias("ref"), x.tokens(F.coalesce("generated", F.lit(""))).alias("hyp"), F.coalesce("generated", F.lit("")).alias("t"))
    h, r = F.size("hyp"), F.size("ref")
    held = chunkers.rouge_l(words, "ref", "hyp").withColumn("k", overlaps.clipped("hyp", "ref", 4))
    penalty = F.when(h == 0, 0.0).when(h < r, F.exp(1 - r / h)).otherwise(1.0)
    bleu = [penalty * F.col("k")[n] / F.greatest(h - n, F.lit(1)) for n in range(4)]
    return held.select(
        "task", "id", F.round(sum(bleu, F.lit(0.0)) / 4, 6).alias("bleu_avg"), *[F.round(b, 6).alias(f"bleu_{n}") for n, b in enumerate(bleu, 1)],
        F.col("rouge_f").alias("rouge_l"), F.length("t").cast("double").alias("length"), (F.btrim("t") != "").alias("valid"),
    )


def overall(scored: DataFrame) -> DataFrame:
    """(task, num, valid, the mean of each of METRICS): over all rows, those that aren't valid among them."""
    return scored.groupBy("task").agg(F.count("*").alias("num"), F.count_if("valid").alias("valid"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])
