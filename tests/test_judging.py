"""Judgements against plain Python, on rows that are empty, null, short or tied."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import judging

TEXTS = [None, "", " ", "abc", "The cat sat on the mat", "the CAT sat\non the mat today", "猫 在 垫子 上 睡觉 了 吗 呢", "猫在垫子上睡觉了", "a1 " * 5000]


def plain_hit(gold, found):
    import re

    def squeeze(t):
        return re.sub(r"[\s 　]+", "", t or "").lower()

    g, h = squeeze(gold), squeeze(found)
    if len(g) < 8 or not h:
        return False
    words = [Counter(re.findall("[一-鿿]|[A-Za-z0-9]+", t)) for t in (g, h)]
    same, all_ = sum((words[0] & words[1]).values()), sum(words[0].values()) + sum(words[1].values())
    return g in h or (len(h) >= 8 and h in g) or (same > 0 and 2 * same / all_ >= 0.6)


def test_evidence_hit(spark):
    pairs = [(i, j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    df = spark.createDataFrame(pairs, "i int, j int, gold string, found string")
    got = {(r.i, r.j): r.hit for r in judging.evidence_hit(df, "gold", "found").collect()}
    assert got == {(i, j): plain_hit(a, b) for i, j, a, b in pairs}
    assert {True, False} == set(got.values())


def test_quest_eval(spark):
    none = judging.UNDETERMINED
    rows = [(1, "red cat", "red dog"), (1, "blue", none), (1, none, "blue"), (2, none, none), (3, "x", none), (3, "y", None)]
    got = {r.g: (r.n, round(r.recall, 6), round(r.f1, 6)) for r in judging.quest_eval(spark.createDataFrame(rows, "g int, t string, a string"), "g", "t", "a").collect()}
    assert got == {1: (2, 0.5, 0.5), 2: (0, 0, 0), 3: (2, 0, 0)}
    assert judging.quest_eval(spark.createDataFrame([], "g int, t string, a string"), "g", "t", "a").count() == 0


def test_information_gain(spark):
    def gain(a, b):
        x, y = Counter(a or ""), Counter(b or "")
        size = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())) or 1
        return 1 / (2 - min(1, sum(n * y[c] for c, n in x.items()) / size))

    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    got = {r.i: r.g for r in df.select("i", judging.information_gain("a", "b").alias("g")).collect()}
    assert got == pytest.approx({i: gain(a, b) for i, a, b in pairs})


def test_scores_flags_and_keywords(spark):
    df = spark.createDataFrame([(1, 74.9, 75.0, " No "), (2, None, 0.0, None), (3, 80.0, 90.0, "yes")], "i int, a double, b double, v string")
    low = judging.low_scores({"context_utilization": F.col("a"), "answer_completeness": F.col("b")})
    rows = df.select("i", judging.modules(low).alias("m"), judging.as_bool(F.col("v")).alias("f")).orderBy("i").collect()
    assert [(r.m, r.f) for r in rows] == [(["C_t"], False), (["I_t"], True), ([], True)]
    said = spark.createDataFrame([("A Licence or LICENSE",), ("",), (None,)], "t string")
    keys = judging.first_keywords(F.col("t"), {"law": ["license", "licence"], "or": []})
    assert [[(s.dim, s.match) for s in r.k] for r in said.select(keys.alias("k")).collect()] == [[("law", "license"), ("or", "or")], [], []]


def test_search_falls_back_by_query(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int")
    sem, dim, fused = make([(1, 5, 0.9, 1), (2, 6, 0.8, 1), (2, 7, 0.7, 2)]), make([(1, 8, 0.5, 1)]), make([(1, 5, 0.1, 1)])
    got = {(r.query_id, r.chunk_id, r["mode"]) for r in judging.search("fusion", sem, dim, fused, 1).collect()}
    assert got == {(1, 5, "fusion"), (2, 6, "fallback")}
    assert judging.search("sem", sem, dim, fused, 2).count() == 3 and judging.search("dim", sem, dim, fused, 2).count() == 1
    with pytest.raises(ValueError):
        judging.search("other", sem, dim, fused, 1)
