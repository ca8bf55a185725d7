import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import nb_svm, token_alignment, whitening
from tessera.llm.queries import ALIGNED

A = Tokenizer.from_file(ALIGNED[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=ALIGNED[1])
TEXTS = [
    None, "", " ", "  ", "\n", "a", "plain words and more words", "plain words and more words", "it's  two  spaces \n and\tlines ", "<|endoftext|> <s> </s> <unk> <0x41>",
    "is▁lost", "naïve café straße 日本語 🙂 é", "　wide space", "x" * 3000, "ab " * 3000, "tail \r\n" * 40, "a\x00b", "12345 67.8 1,000,000", "don't you'll WE'VE",
]


def plain_tokens(text):
    """Bytes of the tokens and ids of both sides, or nothing."""
    if not text:
        return None
    alphabet = token_alignment.byte_alphabet()
    e = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in A.id_to_token(i))) for i in e.ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def plain_alignment(texts):
    """Rows of the query, by loops over bytes."""
    links, rows = Counter(), []
    for text in texts:
        both = plain_tokens(text)
        if not both:
            rows.append(None)
            continue
        owners = []
        for side in both:
            owners.append([k for k, (_, x) in enumerate(side) for _ in x])
        mine = sorted(set(zip(*owners, strict=True)))
        links.update((both[0][i][0], both[1][j][0]) for i, j in mine)
        groups, at = [[[], []]], 0
        for at, (i, j) in enumerate(zip(*owners, strict=True)):
            for side, k in ((0, i), (1, j)):
                if at + 1 == len(owners[0]) or owners[side][at + 1] != k:
                    groups[-1][side].append(both[side][k][0])
            if at + 1 < len(owners[0]) and all(owners[s][at + 1] != owners[s][at] for s in (0, 1)):
                groups.append([[], []])
        rows.append((both, mine, groups))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for x in rows:
        if not x:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), mine, groups = x
        counts = [(links[a[i][0], b[j][0]], most[b[j][0]]) for i, j in mine]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(mine), sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(text.encode()).hexdigest()))
    return out


def aligned(spark, texts, **more):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, row_id int").repartition(3)
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r) for r in token_alignment.cross_align(df, *ALIGNED, **more).orderBy("doc_id").select(*cols).collect()]


def test_alignment_against_loops(spark):
    assert aligned(spark, TEXTS) == plain_alignment(TEXTS)


def test_alignment_in_blocks_and_pieces(spark, monkeypatch):
    want = plain_alignment(TEXTS)
    assert aligned(spark, TEXTS, block_pairs=20) == want  # many passes
    text = TEXTS[8] + " and words " * 50
    assert "".join(token_alignment.pieces_of(text, 7)) == " " + text
    e = token_alignment.encoders(*(open(p, "rb").read() for p in ALIGNED))
    assert e.can_cut
    for t in [t for t in TEXTS if t]:
        parts = token_alignment.pieces_of(t, 5)
        assert [i for x in e.a(parts) for i in x] == A.encode(" " + t, add_special_tokens=False).ids
        assert [i for x in e.b([p[1:] for p in parts]) for i in x] == B.encode(t)


def test_fast_ids_are_those_of_the_file(spark):
    rnd = random.Random(2)
    e = token_alignment.encoders(*(open(p, "rb").read() for p in ALIGNED))
    letters = "aeinrst   \n\t'!?.-ÀéßжΩ日語🙂0123ABthe"
    texts = [" " + "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 200))) for _ in range(400)] + [" " * 100_000 + "x", "x" * 200_000]
    assert e.a(texts) == [A.encode(t, add_special_tokens=False).ids for t in texts]


def test_alignment_of_no_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert token_alignment.cross_align(spark.createDataFrame([], schema), *ALIGNED).count() == 0
    rows = token_alignment.cross_align(spark.createDataFrame([(None, "same text"), (None, "same text"), (3, None)], schema), *ALIGNED).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in rows) == [(0, 2, 4), (0, 2, 4), (3, 0, 0)]


def test_best_matches(spark):
    rows = token_alignment.aligned(spark.createDataFrame([(1, "the the a")], "doc_id long, text string"), *ALIGNED)
    best = {r.b_id: (r.a_ids, r.n) for r in token_alignment.best_matches(token_alignment.pair_counts(rows)).collect()}
    assert best == {B.encode("the")[0]: (A.encode(" the").ids, 2), B.encode("a")[0]: (A.encode(" a").ids, 1)}


def plain_whitening(rows, k):
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(np.float64)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [int(v) for v in np.square(n * x - s).sum(axis=1)], values, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("spread", [0.0, 0.25])
def test_whitening_against_numpy(spark, spread):
    rng = np.random.default_rng(5)
    d = 48
    vectors = (rng.standard_normal((300, d)) * np.exp(-spread * np.arange(d))).astype(np.float32)
    bad = [(900, None), (901, [None] * d), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] * d), (904, []), (905, [1.0] * (d + 1)), (906, [3e38] * d)]
    data = [(i, v.tolist(), 1.0, 1) for i, v in enumerate(vectors)] + [(i, v, 1.0, 1) for i, v in bad]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, whitened double, n int").repartition(4)
    f = whitening.fit(whitening.whole(df), 8)
    assert f.columns == (16 if spread else d) or spread  # a flat spectrum takes all dimensions
    rows = whitening.whiten(df, 8).orderBy("vec_id", "component").collect()
    deviation, values, white, explained = plain_whitening(vectors, 8)
    assert len(rows) == 300 * 8 and [r.deviation for r in rows[::8]] == deviation and {r.n for r in rows} == {300}
    got = np.array([r.whitened for r in rows]).reshape(300, 8)
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got * sign, white, atol=1e-8)
    assert np.allclose([r.explained for r in rows[:8]], explained, rtol=1e-10) and rows[0].identity_error < 1e-9


def test_whitening_needs_few_passes_where_residuals_allow(spark):
    rng = np.random.default_rng(6)
    low = (rng.integers(-3, 4, (200, 4)) @ rng.integers(-3, 4, (4, 60))) / 64  # whole numbers of rank 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(low)], "vec_id long, embedding array<double>")
    f = whitening.fit(whitening.whole(df), 4, oversampling=6)
    assert f.columns == 10 and f.passes <= 2
    rows = whitening.whiten(df, 8, oversampling=6).collect()
    assert len(rows) == 200 * 4  # components without variance are none


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, [1.0, 2.0])] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    rows = whitening.whiten(spark.createDataFrame([(None, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert sorted(round(abs(r.whitened), 6) for r in rows) == [0.707107, 0.707107, 1.414214] and {r.component for r in rows} == {1}
    assert whitening.deviations(np.array([[1 << 39], [0]]), 1 << 30, [0]) == [None, 0]


def plain_features(text, bits=nb_svm.BITS):
    """The n-grams themselves, one number for each."""
    data = text.encode()
    words = [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in data.split()]
    flags = [a == b for a, b in zip(words, words[1:], strict=False)]
    grams = {(0, data[i : i + 3]) for i in range(len(data) - 2)} | {(1, w) for w in words} | {(2, *p) for p in zip(words, words[1:], strict=False)}
    return grams | {(3, *flags[i : i + n]) for n in (1, 2, 3) for i in range(len(flags) - n + 1)}


def test_features_are_the_n_grams(monkeypatch):
    rnd = random.Random(3)
    texts = ["", "a", "ab", "A a", "one one one two", "x" * 50, "".join(rnd.choice("ab \n\té") for _ in range(5000))]
    for t in texts[1:]:
        assert len(nb_svm.features(t.encode(), 40 - 9)) == len(plain_features(t))
    whole = [nb_svm.features(t.encode()) for t in texts]
    monkeypatch.setattr(nb_svm, "PIECE", 7)
    assert all((a == nb_svm.features(t.encode())).all() for a, t in zip(whole, texts, strict=True))  # pieces change nothing


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    y = np.where([0 in r or 1 in r for r in rows], 1.0, -1.0)
    ratios = rng.standard_normal(30)
    w, bias = nb_svm.descend(rows, y, ratios, 1.0, 5000, 1e-9)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 30] = 1
    c = np.where(y > 0, 40 / (y > 0).sum(), 40 / (y < 0).sum())

    def loss(v):
        return v @ v / 2 + (c * np.maximum(0, 1 - y * (x @ v))).sum()

    found = np.append(w, bias)
    least = loss(found)
    assert all(loss(found + rng.standard_normal(31) * s) >= least - 1e-9 for s in (1e-1, 1e-2, 1e-3, 1e-4) for _ in range(200))


def corpus(spark, n=400):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(20, 60))]
        bad = i % 4 == 0
        docs.append((i, " ".join(w + "***" if bad else w for w in words), "en", "s", 0.5))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    extra = [(None, "no id", None, None, 0.0), (500, None, None, None, 0.0), (501, "", None, None, 0.0), (3, docs[3][1], "en", "s", 0.5)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, score double").repartition(3)
    schema = "doc_id long, quality int, toxic int"
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (4, 1, 0)], schema)
    rows = nb_svm.classify(d, lab, fit_rows=150).collect()
    assert len(rows) == len(docs) + 4
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held) > 50
    assert len({r.score for r in rows if r.doc_id == 3}) == 1 and len({r.score for r in rows if r.doc_id in (500, 501)}) == 1
    # labels of held out rows change nothing
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], schema)
    assert sorted(nb_svm.classify(d, turned, fit_rows=150).collect(), key=str) == sorted(nb_svm.classify(d, spark.createDataFrame(labels, schema), fit_rows=150).collect(), key=str)
    kept = nb_svm.keep_good(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400} <= {i for i in range(400) if i % 4} | {0}


def test_classifier_without_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    assert {r.score for r in nb_svm.classify(docs, spark.createDataFrame([], schema)).collect()} == {0.5}
    assert {r.score for r in nb_svm.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(1, 5)], schema)).collect()} == {1.0}
    assert nb_svm.classify(docs.limit(0), spark.createDataFrame([], schema)).count() == 0


def test_counts_by_class_cover_all_labels(spark):
    docs, labels = corpus(spark, 60)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").repartition(4)
    y = nb_svm.learnt(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    counts = nb_svm.class_counts(d.join(y, F.col("doc_id") == F.col("_id")), 16)
    want = np.zeros_like(counts)
    for i, q, _ in labels:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            want[q, nb_svm.features(docs[i][1].encode(), 16)] += 1
            want[q, -1] += 1
    assert (counts == want).all()
