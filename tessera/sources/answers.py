"""Question records with nested marks (token places of answers) to flat records with texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as x

#: Candidates of the top level that are kept.
CANDIDATES = 10


def _span(start: Column, end: Column) -> Column:
    """The words of `tokens` from *start* up to *end*."""
    return F.array_join(F.slice("tokens", start + 1, end - start), " ")


def _inside(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (end > start) & (start < F.size("tokens")), F.lit(False))


def candidates(field: str = "long_answer_candidates") -> Column:
    """The first candidates of the top level whose place is in the text, each with its index, place and text."""
    zipped = F.transform(F.arrays_zip(f"{field}.top_level", f"{field}.start_token", f"{field}.end_token"), lambda c, i: F.struct(i.alias("index"), c["top_level"].alias("top"), c["start_token"].alias("s"), c["end_token"].alias("e")))
    kept = F.slice(F.filter(zipped, lambda c: F.coalesce(c.top, F.lit(False)) & _inside(c.s, c.e)), 1, CANDIDATES)
    return F.transform(kept, lambda c: F.struct(c["index"].alias("index"), c.s.alias("start_token"), c.e.alias("end_token"), _span(c.s, c.e).alias("text")))


def short_answers(field: str = "annotations") -> Column:
    """By annotation its texts, then the texts of its places that aren't there yet."""

    def one(held: Column, a: Column) -> Column:
        held = F.concat(held, F.coalesce(a.text, F.array().cast("array<string>")))
        places = F.filter(F.arrays_zip(a.start_token, a.end_token), lambda p: _inside(p["start_token"], p["end_token"]))
        texts = F.transform(places, lambda p: _span(p["start_token"], p["end_token"]))
        return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), held, lambda acc, t: F.when(F.array_contains(acc, t), acc).otherwise(F.concat(acc, F.array(t))))

    return F.aggregate(F.col(f"{field}.short_answers"), F.array().cast("array<string>"), one)


def long_answers(field: str = "annotations") -> Column:
    zipped = F.transform(F.arrays_zip(f"{field}.id", f"{field}.long_answer"), lambda a: F.struct(a["id"].alias("id"), a["long_answer"].alias("p")))
    kept = F.filter(zipped, lambda a: _inside(a.p.start_token, a.p.end_token))
    return F.transform(kept, lambda a: F.struct(a.id.alias("annotator_id"), a.p.start_token.alias("start_token"), a.p.end_token.alias("end_token"), _span(a.p.start_token, a.p.end_token).alias("text")))


def yes_no(field: str = "annotations") -> Column:
    """The first clear answer."""
    said = F.filter(F.col(f"{field}.yes_no_answer"), lambda v: v.isin(0, 1))
    return F.when(F.get(said, F.lit(0)) == 1, "YES").when(F.get(said, F.lit(0)) == 0, "NO")


def records(df: DataFrame) -> DataFrame:
    """(id, question, document, long_answer_candidates, annotations) of rows whose question, document, candidates and annotations are structs.

    Documents become text without marks; places count its words. All of it is column functions, so it scales as a projection. Missing marks give empty lists.
    """
    text = F.coalesce(x.html_text(F.col("document.html")), F.lit(""))
    held = df.withColumn("_text", text).withColumn("tokens", F.filter(F.split("_text", " "), lambda t: t != ""))
    none = lambda c: F.coalesce(c, F.array())
    marks = F.struct(none(short_answers()).alias("short_answers"), none(long_answers()).alias("long_answers"), yes_no().alias("yes_no_answer"))
    return held.select(F.col("id").cast("string").alias("id"), F.col("question.text").alias("question"), F.col("_text").alias("document"), none(candidates()).alias("long_answer_candidates"), marks.alias("annotations"))
