"""What a query holds or sends doesn't follow its input."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import chunkers, lexical, recall
from tessera.plans import frames, texts


def test_ids_are_not_sent_to_all_tasks(spark, sf_dir):
    plan = entry.queries()["suffix_id_recover"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chunks_are_given_back_by_characters(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([(k, f"{k}. " * 50) for k in range(40)] + [(99, None)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, chunkers.chunk(df, "model_pack", size=20).collect()))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    monkeypatch.setattr(chunkers, "CHARS", 300)
    assert sorted(map(tuple, chunkers.chunk(df, "model_pack", size=20).collect())) == whole
    assert {r[0] for r in whole} == set(range(40))


def test_terms_of_a_document_are_counted_without_an_exchange(spark, sf_dir):
    terms = texts._terms(spark, sf_dir)
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b"])], "id int, w array<string>")
    got = {r.id: sorted((x.t, x.n) for x in r.c) for r in df.select("id", lexical.counted(F.col("w")).alias("c")).collect()}
    assert got == {1: [("a", 2), ("b", 1)], 2: [], 3: [], 4: [("b", 1)]}


def test_sources_of_pairs_as_bits_and_counted_are_the_same(spark):
    rows = spark.createDataFrame([("x", ["a", "b", "a", "b"]), ("y", ["a", "b"]), (None, ["b", "a"]), ("x", ["c"]), ("z", None), ("x", [])], "source string, words array<string>")
    want = [("a b", 2, "x", False), ("b a", 2, "x", False)]
    for most in (60, 2):
        assert sorted(map(tuple, texts.gram_sources(rows, most).collect())) == want
    assert texts.gram_sources(rows)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_vectors_are_not_sent_to_all_tasks(spark, sf_dir):
    plan = recall.tag_vectors(frames.tags(spark, sf_dir), frames.emb(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tasks_of_an_expansion_are_cut_by_rows(spark):
    tags = spark.createDataFrame([(k, "d", f"t{k % 3}") for k in range(300)], "chunk_id long, dim string, tag string")
    found = spark.createDataFrame([(q, "d", f"t{t}", 1.0 - t / 10) for q in range(1000, 1700) for t in range(2)], "query_id long, dim string, tag string, score double")
    got = recall.expand(found, tags, 40).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    want = {(q, 3 * k, k + 1) for q in range(1000, 1700) for k in range(40)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == want and len(got) == len(want)
