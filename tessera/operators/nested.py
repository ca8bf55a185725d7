"""Numbers in nested values, and lists of ranks that were cut off."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as x
from tessera.scratch import materialize


def _is(kind: str) -> Column:
    return F.startswith(F.schema_of_variant("v"), F.lit(kind))


def leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, v): every value of the JSON texts that is no container, however deep: `a.b[2].c`.

    Level by level: containers are exploded by Spark's own function until none is left; each level is a pass over what is left. Texts that
    don't parse have no values; empty containers neither.
    """
    level = materialize(df.select(key, F.lit("").alias("path"), x.safe_json(F.col(text)).alias("v")).filter("v IS NOT NULL"), "level")
    done = level.limit(0)
    while not level.isEmpty():
        held = _is("OBJECT") | _is("ARRAY")
        done = done.unionByName(level.filter(~held))
        inner = level.filter(held).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat(F.lit("."), "name"))
        level = materialize(inner.select(key, F.concat("path", step).alias("path"), F.col("inner").alias("v")), "level")
    return done


def numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): the numbers among leaves()."""
    kind = F.schema_of_variant("v")
    number = F.startswith(kind, F.lit("DECIMAL")) | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    return leaves(df, key, text).filter(number).select(key, "path", F.try_variant_get("v", "$", "double").alias("value"))


def metrics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, n, mean): numbers by path, those of a list taken together, whatever their places in it."""
    path = F.regexp_replace("path", r"\[\d+\]", "[]")
    return numbers(df, key, text).groupBy(key, path.alias("path")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.IGNORECASE)


def closed(text: str) -> str | None:
    """*text*, JSON that was cut off, up to the last whole entry of its outermost list, with what is open closed; None without one.

    One pass with a stack of what is open, in and out of strings.
    """
    stack, quoted, escaped, whole = [], False, False, None
    for i, c in enumerate(text):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack.pop() != c:
                return None
            if stack[-1:] == ["]"] and stack.count("]") == 1:
                whole = (i + 1, stack.copy())
    return text[: whole[0]] + "".join(reversed(whole[1])) if whole else None


def _entries(value: object) -> list[dict] | None:
    """The entries of a ranking: each has a rank and a method."""
    ranking = value.get("ranking") if isinstance(value, dict) else None
    return ranking if isinstance(ranking, list) and all(isinstance(e, dict) and "rank" in e and "method" in e for e in ranking) else None


def _strict(text: str) -> object:
    def no(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=no)


def repair(text: str | None, expected: int) -> dict | None:
    """The ranking that a model's answer holds: ranks and methods, the summary, and whether entries are missing or were cut off.

    A whole answer needs a ranking and a summary; of one that was cut off the whole entries stay. Either way half of the *expected*
    entries must be there.
    """
    plain, cut = FENCE.sub("", (text or "").strip()).strip(), False
    try:
        value = _strict(plain)
    except (ValueError, RecursionError):
        cut, fixed = True, closed(plain)
        try:
            value = _strict(fixed) if fixed else None
        except (ValueError, RecursionError):
            return None
    entries = _entries(value)
    if entries is None or len(entries) < 0.5 * expected or not cut and "summary" not in value:
        return None
    ranks = [{"rank": int(e["rank"]) if str(e["rank"]).lstrip("-").isdecimal() else None, "method": None if e["method"] is None else str(e["method"])} for e in entries]
    return {"ranking": ranks, "summary": str(value.get("summary") or ""), "partial": len(entries) < expected, "truncated": cut}


_REPAIRED = pa.struct([("ranking", pa.list_(pa.struct([("rank", pa.int64()), ("method", pa.string())]))), ("summary", pa.string()), ("partial", pa.bool_()), ("truncated", pa.bool_())])


def repaired(text: Column, expected: Column) -> Column:
    """repair() of a column of answers, each with the number of entries that it should have."""

    def run(texts: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([repair(t, n or 0) for t, n in zip(texts.to_pylist(), counts.to_pylist(), strict=True)], _REPAIRED)

    return F.arrow_udf(run, "struct<ranking: array<struct<rank: long, method: string>>, summary: string, partial: boolean, truncated: boolean>")(text, expected)
