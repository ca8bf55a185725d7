"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, segmentation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of `documents`, whatever further ones and names there are.
An empty table gives empty stages; ties go to the least doc_id; repeated rows share their fate, but that
of rows equal in doc_id and text all stay where one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, piece_dropout, quality_risk, simhash_anchor
from tessera.llm.common import discard, materialize, table
from tessera.llm.queries import MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them.

    Repeated rows are judged alike; in a language (null is one) without enough labels the base rules alone hold.
    """
    return quality_risk.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, with its remaining text.

    A null text becomes an empty one; rows without doc_id keep all lines; `n_chars`, if there is one, counts the new text.
    """
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the least id.

    Null and empty texts are copies of one another; a row without doc_id goes where its group has one with it.
    """
    return simhash_anchor.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items and texts of fewer than five words match nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, lossless) of every document that is left; a null or empty text has no ids."""
    # the workers of the stages before are still there, so a smaller memory of units
    done = piece_dropout.encode(docs.select("doc_id", "text"), MODEL, remembered=80_000)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: SQL can't express SimHash near-duplicates or merge-dropout; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, each written and read again as the next one's input; a stage's input is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            discard(before)
    return docs
