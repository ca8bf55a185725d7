import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import scratch
from tessera.operators import chunkers, coref, fusion, graphs, models, overlaps, recall, vector
from tessera.sources import files
from tessera.streaming import incremental

SIDE = "query_id long, chunk_id long, score double, rank int"


def side(spark, rows):
    return spark.createDataFrame(rows, SIDE)


def ranks(df):
    return [(r.chunk_id, r["rank"]) for r in df.orderBy("query_id", "rank").collect()]


def test_fusion_edges(spark):
    dim, sem, none = side(spark, [(1, 10, 0.9, 1), (1, 11, 0.5, 2)]), side(spark, [(1, 11, 0.8, 1), (1, 12, 0.8, 2)]), side(spark, [])
    assert ranks(fusion.interleave(dim, sem)) == [(10, 1), (11, 2), (12, 3)]
    assert ranks(fusion.rrf(dim, none)) == [(10, 1), (11, 2)] and ranks(fusion.rrf(none, none)) == []
    assert ranks(fusion.rrf(dim, sem, alpha=1.0))[0] == (10, 1) and ranks(fusion.rrf(dim, sem, alpha=0.0))[0] == (11, 1)
    assert {r.score for r in fusion.min_max(sem).collect()} == {1.0}
    assert [r.score for r in fusion.rank_scores(side(spark, [(1, 5, 0.1, 1)])).collect()] == [1.0]


def test_topk_ties_zero_vectors_and_blocks(spark):
    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(30)] + [(30, [0.0, 0.0], 0), (31, None, 0)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp long")
    some = vector.topk(df, df.filter("id < 5"), 4)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in some.collect()} == {(r.query_id, r.chunk_id, r["rank"]) for r in vector.topk(df, df.filter("id < 5"), 4, block=2).collect()}
    first = [r.chunk_id for r in some.filter("query_id = 0").orderBy("rank").collect()]
    assert first == [3, 6, 9, 12]
    assert all((r.query_id - r.chunk_id) % 2 == 0 for r in vector.topk(df.filter("id < 30"), df.filter("id < 5"), 4, same_group=True).collect())
    assert vector.topk(df, df.limit(0), 4).count() == 0


def test_chunkers_keep_all_words():
    text = "First one. Second is longer, and on it goes!\n\n# Head\nThird? " + "word " * 400 + "\nlast"
    for how in ("paragraph_pack", "boundary_window", "word_halves"):
        parts = chunkers.CHUNKERS[how](text)
        assert set(" ".join(parts).split()) == set(text.split()), how
    assert max(map(len, chunkers.stepped_pack("x" * 1200 + "\nshort", 500, 80))) == 500
    assert chunkers.boundary_window("a" * 1200, 500, 50)[-1] == "a" * 300
    assert chunkers.sentence_window("One two. Three four. Five six.", 12, 10)[1] == "One two. Three four."
    assert chunkers.pack(["a" * 9, "b"], 5) == ["a" * 9, "b"]
    assert chunkers.three_rounds("") == []


def test_chunk_of_null_and_blank(spark):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "a. b.")], "doc_id long, text string")
    assert {r.doc_id for r in chunkers.chunk(df, "dynamic_combination").collect()} == {3}


def test_lcs_and_perplexity():
    assert chunkers.lcs("a b c d".split(), "b x d".split()) == 2 and chunkers.lcs([], ["a"]) == 0
    assert all(math.isfinite(p) and p >= 1 for p in chunkers.bigram_perplexities(["abab", "zzzz", "q", ""]))
    rnd = random.Random(2)
    for _ in range(20):
        sentences = ["".join(rnd.choice("abcé🎉 ") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(1, 7))]
        pairs = Counter(s[i : i + 2] for s in sentences for i in range(len(s) - 1))
        firsts = Counter(s[i] for s in sentences for i in range(len(s) - 1))
        kinds = len(set("".join(sentences))) or 1
        want = [math.prod((firsts[s[i]] + kinds) / (pairs[s[i : i + 2]] + 1) for i in range(len(s) - 1)) ** (1 / (len(s) - 1)) if len(s) > 1 else 1.0 for s in sentences]
        assert chunkers.bigram_perplexities(sentences) == pytest.approx(want)


def test_path_entropy_of_small_graphs():
    # a line 0 -> 1 -> 2 with cheap steps: the direct edge 0 -> 2 isn't used
    line = {0: {1: 1.0, 2: 9.0}, 1: {2: 1.0}, 2: {}}
    assert graphs.mean_paths(line, 0) == {1: 0, 2: 1}
    assert graphs.path_entropy(line) == pytest.approx(1.5)  # degrees 1, 2, 1
    assert graphs.path_entropy({0: {1: 1.0, 2: 1.0}, 1: {}, 2: {}}) == pytest.approx(1.5) and graphs.path_entropy({0: {}}) == 0.0


def test_overlaps_and_sign_test():
    assert overlaps.clipped_matches("a b a c".split(), "a a a b".split(), 2) == [3, 1] and overlaps.clipped_matches([], ["x"], 3) == [0, 0, 0]
    for w, n in ((0, 0), (3, 1), (10, 30), (700, 640)):
        exact = min(1, 2 * sum(math.comb(w + n, k) for k in range(min(w, n) + 1)) / 2 ** (w + n))
        assert overlaps.sign_probability(w, n) == pytest.approx(exact)
    assert overlaps.code_similarity("\n# no\n```py\nx = 1\ny", "x = 1") == 1.0 and overlaps.code_similarity("", "x") == 0.0


def test_exact_quantiles_and_running_sums(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([5.0] * 3 + [rnd.random() * 9, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in scratch.quantiles(df, "v", {"q": 0.3, "m": 0.5, "top": 1.0}, ["k"]).collect()}
    for k in ("a", "b", None):
        own = [v for x, v in rows if x == k and v is not None]
        assert (got[k].q, got[k].m, got[k].top) == pytest.approx((np.quantile(own, 0.3), np.quantile(own, 0.5), max(own)))
    own = sorted(v for _, v in rows if v is not None)
    assert scratch.quantiles(df, "v", {"q": 0.3}, interpolate=False).first().q == own[int(len(own) * 0.3)]
    assert scratch.quantiles(df.limit(0), "v", {"q": 0.5}, ["k"]).count() == 0
    sums = scratch.running(spark.range(500).selectExpr("id % 3 AS k", "id", "id % 5 AS n"), ["k", "id"], "n").orderBy("k", "id").collect()
    total = 0
    for r in sums:
        assert r.before == total
        total += r.n


def test_searches_in_blocks(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=4).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp long")
    q = df.filter("id % 4 = 0")
    order = lambda d: sorted(map(tuple, d.collect()))
    for options in ({}, {"metric": "euclid"}, {"same_group": True}, {"least": 0.3}):
        assert order(vector.topk(df, q, 5, block=7, row_block=20, **options)) == order(vector.topk(df, q, 5, **options))
    tags = df.select(F.concat(F.lit("t"), "id").alias("tag"), "grp", "vec")
    assert order(vector.scores(tags, q, "tag", "grp", block=7, row_block=20)) == order(vector.scores(tags, q, "tag", "grp")) and vector.scores(tags.limit(0), q, "tag").count() == 0


def test_coreference(spark):
    df = spark.createDataFrame([(1, 0, "We met Anna there."), (1, 1, "Then she left."), (2, 0, "It rains."), (3, 0, None), (3, 1, "They said so.")], "doc_id long, place long, text string")
    got = {(r.doc_id, r.place): r.resolved for r in coref.resolve(df, coref.LATIN).collect()}
    assert got[(1, 1)] == "Then Anna left." and got[(2, 0)] == "It rains." and got[(3, 0)] == "" and got[(3, 1)] == "They said so."


def test_coreference_by_ordered_rules(spark):
    texts = {
        1: ["王小明教授到了。", "然后 他 走了。", "新的李四说好。", "那时 他 也在。"],  # the nearest chunk that names one
        2: ["名叫张三是李四。", "于是 他 来了"],  # the earlier rule wins within a text
        3: ["深度学习技术很好。", "但 它 很慢， 这 不好。", "她 不在这里"],
        4: ["该方案 不变，他们也是。"],  # letters touch the pronoun
    }
    df = spark.createDataFrame([(d, i, t) for d, v in texts.items() for i, t in enumerate(v)], "doc_id long, place long, text string").repartition(3)
    rows = {(r.doc_id, r.place): r for r in coref.resolve(df).collect()}
    assert rows[(1, 1)].resolved == "然后 王小明 走了。" and [tuple(x) for x in rows[(1, 3)].resolutions] == [("他", "新的李四")]
    assert rows[(2, 1)].resolved == "于是 张三是李 来了" or rows[(2, 1)].resolved == "于是 张三是李四 来了"
    assert rows[(3, 1)].resolved == "但 深度学习 很慢， 深度学习 不好。" and rows[(3, 1)].n_resolved == 2 and rows[(3, 2)].n_resolved == 0
    assert rows[(4, 0)].n_resolved == 0 and not rows[(4, 0)].rolled_back
    bad = {(r.doc_id, r.pronoun): (r.n, r.antecedents) for r in coref.inconsistent(coref.resolve(df)).collect()}
    assert bad == {(1, "他"): (2, ["新的李四", "王小明"])}
    assert coref.circular([("他", "它"), ("它", "水")]) and not coref.circular([("他", "水")])
    assert coref.resolve(df.limit(0)).count() == 0


def test_models(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    rows = models.with_embedding(df, "t").collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5 and not any(rows[1].embedding)

    def broken(prompts):
        raise OSError

    assert [(r.completion, r.completion_error) for r in models.with_completion(df, "t", broken).collect()] == [(None, "OSError: ")] * 3

    def picky(prompts):
        if None in prompts:
            raise ValueError("no prompt")
        return [p.upper() for p in prompts]

    assert [(r.completion, r.completion_error) for r in models.with_completion(df.coalesce(1), "t", picky).collect()] == [("A B", None), (None, "ValueError: no prompt"), ("", None)]
    trace = models.iterate(lambda p: 10.0, lambda p, s: p + "x", "p")
    assert [t["score"] for t in trace] == [10.0] * 3


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "c.json").write_text('{"chunks": [{"id": 1, "content": "x"}, {"docid": "2", "chunk_text": "y"}]}')
    (tmp_path / "q.jsonl").write_text('{"query": "q1", "answer": "a"}\n\n{"question": " ", "output": "b"}\n')
    assert {(r.doc_id, r.text) for r in files.lines(spark, str(tmp_path)).collect()} == {("a_line_00000", "one"), ("a_line_00002", "two")}
    assert {(r.doc_id, r.text) for r in files.chunk_json(spark, str(tmp_path / "c.json")).collect()} == {("1", "x"), ("2", "y")}
    assert [tuple(r) for r in files.questions(spark, str(tmp_path / "q.jsonl")).collect()] == [("q1", "a")]


def test_streams(spark, tmp_path, sf_dir):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(10).selectExpr("id", "id * 2 AS v")
    for extra in (0, 5):
        rows.selectExpr(f"id + {extra} AS id", f"v + {extra} AS v").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        incremental.process_new(stream, "id", lambda df: df, target, str(tmp_path / "cp")).awaitTermination()
        incremental.upsert_stream(stream, "id", target + "2", str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(target).count() == 15
    assert {r.id: r.v for r in incremental.newest(spark, target + "2", "id").collect()}[7] == 2 * 2 + 5
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    live = incremental.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), late="3650 days")
    live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = {(r.event_type, r.start): r.n for r in incremental.tumbling(events).collect()}
    assert {(r.event_type, r.start): r.n for r in spark.table("live").collect()} == batch


def test_embeddings_are_of_whole_texts(spark):
    from tessera.operators import models

    df = spark.createDataFrame([(0, "same " * 1000 + "one"), (1, "same " * 1000 + "other"), (2, None)], "doc_id long, text string")
    by = {r.doc_id: r.embedding for r in models.with_embedding(df, "text").collect()}
    assert by[0] != by[1] and len(by[2]) == len(by[0])
    clipped = {r.doc_id: r.embedding for r in models.with_embedding(df, "text", clip=2000).collect()}
    assert clipped[0] == clipped[1]


def test_rows_are_sent_once_for_many_blocks_of_queries(spark):
    df = spark.range(400).select("id", F.array(*[F.sin(F.col("id") * k) for k in (1.0, 2.0, 3.0)]).alias("vec"), F.lit(0).alias("grp"))
    plan = vector.topk(df, df, 3, block=20, row_block=100)
    parts = vector._blocks(df, 400, df, 400, vector.DEALT * 20, 100)[1]
    assert parts.count() == 400 and plan.count() == 1200
    want = {(r.query_id, r.chunk_id) for r in vector.topk(df, df, 3).collect()}
    assert {(r.query_id, r.chunk_id) for r in plan.collect()} == want


def test_tags_behind_a_full_one_are_not_joined(spark):
    tags = spark.createDataFrame([(i, "d", f"t{i % 7}") for i in range(300)] * 2 + [(i, "e", f"u{i % 90}") for i in range(300)], "chunk_id long, dim string, tag string")
    rng = np.random.default_rng(2)
    found = [(q, d, f"{t}{k}", float(rng.integers(0, 6)) / 10) for q in range(12) for d, t, n in (("d", "t", 7), ("e", "u", 90)) for k in rng.choice(n, 6, False)]
    held = {}
    for c, d, t in {tuple(r) for r in tags.collect()}:
        held.setdefault((d, t), set()).add(c)
    want = set()
    for q in range(12):
        best = {}
        for a, d, t, s in found:
            for c in held[d, t] - {q} if a == q else ():
                best[c] = max(best.get(c, 0.0), s)
        want |= {(q, c, k) for k, (c, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20], 1)}
    got = recall.expand(spark.createDataFrame(found, "query_id long, dim string, tag string, score double"), tags, 20)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == want


def test_few_pairs_are_compared_in_full_precision(monkeypatch):
    """The search of many queries reads most pairs in single precision only, with the same rows, ties and copies as in full."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    vec = rng.normal(size=(4096, 24))
    vec[500:600] = vec[:100]
    vec[900] = -vec[3]
    rows = pa.table({"id": pa.array(range(4096)), "vec": pa.array(list(vec), pa.list_(pa.float64())), "grp": pa.array([0] * 4096)})
    asked = rows.take(pa.array(range(0, 4096, 20)))
    full, plain = [], vector.similarities
    monkeypatch.setattr(vector, "similarities", lambda m, q, r: full.append(len(q) * len(r)) or plain(m, q, r))
    got = vector._partial(5, "cosine", 6, True, False, None)(asked, rows.to_batches(1000)).to_pylist()
    assert sum(full) < 0.5 * asked.num_rows * rows.num_rows
    scores = np.round(plain("cosine", vec[::20], vec), 6)
    want = {(q * 20, c) for q in range(len(scores)) for c in sorted((c for c in range(4096) if c != q * 20), key=lambda c: (-scores[q, c], c))[:5]}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want
