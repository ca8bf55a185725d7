"""What the fourth round found: long texts, models that are joined, orders full of copies."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import alignment, lsa, novelty, rounds
from tessera.plans import catalog
from test_alignment import frames, small  # noqa: F401
from test_alignment import plain as plain_lines
from test_lsa import plain as plain_table
from test_rounds import plain


@pytest.fixture
def documents(spark, tmp_path):
    """Writes documents, and gives their folder."""

    def write(rows, columns="doc_id long, text string"):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def by_sql(name, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    r = con.sql(catalog.oracle_sql()[name])
    return r.columns, r.fetchall()


def test_ids_of_more_than_a_thousand_lines(spark, documents):
    d = documents([(7, "\n".join(f"line {k}" for k in range(1205))), (8, ""), (9, None), (None, "a\nb")])
    columns, want = by_sql("flatten_chunks", d)
    got = entry.queries()["flatten_chunks"](spark, d).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("most_sent", [0, 10**6])
def test_pairs_that_meet_once_noise_is_gone_are_counted_ones(spark, most_sent):
    """The line `q` is noise; the pair `xy`, which comes together without it, stands in other texts only."""
    text = "bcbx\nq\nybcbc\ncb\nbcb\nbcb\nbcbc\nbcb\nbcbc\nbcbc\nbcbc\ncbc\nbcbc\n"
    docs = [(0, text), *((k, ("bc" if k % 2 else "xy") * 40) for k in range(1, 121))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.section, r.place, r.chunk_text) for r in rounds.integrated(df, 1, 60, most_sent=most_sent).collect())
    assert got == plain(docs, 1, 60)
    assert [c for d, _, _, c in got if d == 0] == ["bcbxybcbccbbcb", "bcbbcbcbcbbcbcbcbcbcbccbcbcbc"]


def copies(n, n_lines=37, jump=None):
    """Lines as *n* copies of each other, and chunks that are windows over all of them; after *jump* lines one that only a line of the next copy holds."""
    rnd = random.Random(5)
    own = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(40)) for _ in range(n_lines)]
    lines = own * n
    chunks = [x[3:] for x in lines]
    if jump is not None:
        chunks.insert(jump, own[jump // 2])
    return lines, chunks


@pytest.mark.parametrize("hints", [True, False])
@pytest.mark.parametrize("jump", [None, 20])
def test_copies_of_all_lines_take_few_rounds(spark, small, monkeypatch, hints, jump):  # noqa: F811
    written = []
    write = alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda df, name="stage": written.append(name) or write(df, name))
    lines, chunks = copies(12, jump=jump)
    assert len(chunks) > 25 * alignment.RANGE
    c, t = frames(spark, {"a": (lines, chunks)})
    near = c.select("source", "place", F.col("place").alias("line")) if hints else None
    got = {(r.source, r.place): r.line for r in alignment.assign(c, t, near).collect()}
    assert got == plain_lines({"a": chunks}, {"a": lines})
    assert len(written) <= (4 if jump is None else 24)


def test_wrong_hints_change_no_row(spark, small):  # noqa: F811
    lines, chunks = copies(3)
    c, t = frames(spark, {"a": (lines, chunks), "b": (lines[:30], chunks)})
    for line in (F.lit(0), F.lit(100), F.lit(None).cast("long"), F.lit(110) - F.col("place")):
        got = {(r.source, r.place): r.line for r in alignment.assign(c, t, c.select("source", "place", line.alias("line"))).collect()}
        assert got == plain_lines({"a": chunks, "b": chunks}, {"a": lines, "b": lines[:30]})


def lsa_corpus(n):
    rnd = random.Random(2)
    return ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(2, 60))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [1, 50, 10**6])
def test_frequent_and_rare_terms_and_copies_give_the_products_of_the_whole_table(spark, monkeypatch, frequent):
    monkeypatch.setattr(lsa, "FREQUENT", frequent)
    texts = lsa_corpus(40)
    for times in (1, 3):
        df = spark.createDataFrame([*enumerate(texts * times), (1000, None), (1001, "x")], "doc_id long, text string").repartition(3)
        model, rows = lsa.fit(df, components=4, most_terms=300)
        differ = lsa.distinct(rows)
        assert (differ.count(), "n" in differ.columns) == (40, times == 3)
        terms, x = plain_table(texts * times + ["x"], 300)
        q = np.random.default_rng(1).standard_normal((len(terms), 3))
        for t in (rows, differ):
            assert np.allclose(lsa.gram_times(t, model.idf, q), x.T @ (x @ q))
        assert np.allclose(model.values, np.linalg.svd(x)[1][:4])
        got = {r.doc_id: r.vec for r in lsa.project(rows, model).collect()}
        assert np.allclose([got[k] for k in range(len(texts) * times)], x[:-1] @ model.vectors)


def test_a_table_of_copies_is_read_once_for_all(spark):
    df = spark.createDataFrame([*enumerate(lsa_corpus(20) * 5)], "doc_id long, text string")
    _, rows = lsa.fit(df, components=3, most_terms=200)
    assert (rows.count(), lsa.distinct(rows).count()) == (100, 20)


def test_counts_of_texts_are_those_of_their_grams():
    texts = [*lsa_corpus(20), None, "", "a", "𠀀𠀀 𠀀", "Ab  aB", "é日本" * 400]
    got = [{} for _ in texts]
    for k, g, n in zip(*(x.tolist() for x in lsa._counts(texts)), strict=True):
        got[k][lsa._term(g)] = n
    assert got == [dict(lsa.grams(t or "")) for t in texts]


@pytest.mark.parametrize("sent", [0, 3, 1 << 20])
def test_neighbours_by_terms_that_are_sent_and_joined_are_those_of_the_sql(spark, documents, monkeypatch, sent):
    monkeypatch.setattr(novelty, "SENT", sent or 1)
    monkeypatch.setattr(novelty, "BLOCK", 4)
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(12)] + ["日", "é"]
    rows = [(k * 3, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))) + rnd.choice(["", f" only{k}"])) for k in range(50)]
    d = documents([*rows, (200, ""), (201, None), (202, "w1 w1 w2"), (203, "w1 w2"), (204, "...")])
    columns, want = by_sql("info_difference", d)
    got = entry.queries()["info_difference"](spark, d).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
