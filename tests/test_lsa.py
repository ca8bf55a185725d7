import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import lsa


def plain(texts, most_terms, least_docs=2):
    """The weighted table by loops: rows with a text that isn't blank."""
    counts = []
    for t in texts:
        t = " ".join(t.lower().split())
        counts.append(Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)))
    df, total = Counter(g for c in counts for g in c), Counter()
    for c in counts:
        total.update(c)
    terms = sorted(sorted((g for g in df if df[g] >= least_docs), key=lambda g: (-total[g], g))[:most_terms])
    x = np.array([[(1 + np.log(c[g])) * (np.log((1 + len(texts)) / (1 + df[g])) + 1) if c[g] else 0.0 for g in terms] for c in counts])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return terms, x / np.where(norm > 0, norm, 1)


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(2, 7))) for _ in range(60)]
    return [" ".join(rnd.choice(words[k % 6 * 10 : k % 6 * 10 + 25]) for _ in range(rnd.randrange(4, 40))) + rnd.choice(["", "  É 日本"]) for k in range(n)]


def test_singular_values_and_cosines_against_numpy(spark):
    texts = corpus(90)
    df = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "  \n ")], "doc_id long, text string").repartition(4)
    model, rows = lsa.fit(df, components=32, most_terms=400)
    terms, x = plain(texts, 400)
    assert [r.term for r in model.vocabulary.orderBy("place").collect()] == terms
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s[:32], atol=1e-6) and model.residual < 1e-10
    got = np.array([r.vec for r in lsa.project(rows, model).orderBy("doc_id").collect()])
    want = x @ vt[:32].T
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert np.allclose(unit(got) @ unit(got).T, unit(want) @ unit(want).T, atol=1e-6)


def test_few_terms_and_no_rows(spark):
    schema = "doc_id long, text string"
    model, rows = lsa.fit(spark.createDataFrame([], schema))
    assert not len(model.values) and rows.count() == 0
    model, rows = lsa.fit(spark.createDataFrame([(1, "ab"), (2, "ab ab"), (3, "zz")], schema))
    terms, x = plain(["ab", "ab ab", "zz"], 9)
    assert terms == ["ab"] and np.allclose(model.values, np.linalg.svd(x)[1][:1]) and rows.count() == 2  # a text without known terms has no row


def test_pairs_of_a_matrix_with_equal_values():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    values = np.array([5.0] * 7 + [3.0] * 40 + [0.0] * 33)
    a = (q * values) @ q.T
    got, vectors, passes, residual = lsa.leading_pairs(lambda b: a @ b, 80, 12, 4)
    assert np.allclose(got, values[:12]) and np.allclose(a @ vectors, vectors * got) and residual < 1e-10 and passes <= 5
    assert np.allclose(vectors.T @ vectors, np.eye(12))


def test_terms_are_counted_over_all_rows(spark):
    df = spark.createDataFrame([(1, "aba"), (1, "aba"), (2, "ab")], "doc_id long, text string")
    counts = lsa.term_counts(df, "doc_id", "text").groupBy("term").agg(F.sum("n").alias("n"))
    assert {r.term: r.n for r in counts.collect()} == {"ab": 3, "ba": 2, "aba": 2}


def test_grams_as_numbers_are_those_of_the_texts():
    texts = [*corpus(20, 5), None, "", "a", "𠀀𠀀 𠀀", "Ab  aB"]
    code, of = lsa._codes(texts)
    got = [Counter() for _ in texts]
    for c, k in zip(code.tolist(), of.tolist(), strict=True):
        got[k][lsa._term(c)] += 1
    assert got == [lsa.grams(t or "") for t in texts]
    terms = [lsa._term(c) for c in sorted(set(code.tolist()))]
    assert terms == sorted(terms)


def test_a_pass_exchanges_blocks_of_terms_not_entries(spark):
    df = spark.createDataFrame([*enumerate(corpus(60))], "doc_id long, text string").repartition(5)
    _, rows = lsa.fit(df, components=4, most_terms=300)
    assert rows.columns == ["doc_id", "places", "counts"] and rows.count() == 60  # a row for each document from the start
    one, other = (lsa.gram_times(rows, np.ones(300), np.eye(300)[:, :3], block) for block in (256, 7))
    assert np.allclose(one, other)
