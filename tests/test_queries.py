"""Every query with SQL returns what DuckDB returns; the others hold what plain loops say."""

import statistics

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tessera.operators import chunkers, fuzzy, models, rounds
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, duck, sf_dir, name):
    r = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(r.columns)
    mine = entry.queries()[name](spark, sf_dir)
    assert sorted(mine.columns) == columns
    places = [r.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(x[p]) for p in places)) for x in r.fetchall())
    assert sorted(repr(tuple(plain(v) for v in x)) for x in mine.select(columns).collect()) == want


def texts(tables):
    return {r["doc_id"]: r["text"] for r in tables("documents")}


def chunker(name):
    def check(rows, tables):
        got = {}
        for r in sorted(rows, key=lambda r: r.place):
            got.setdefault(r.doc_id, []).append(r.chunk)
        assert got == {d: c for d, t in texts(tables).items() if t and t.strip() and (c := chunkers.CHUNKERS[name](t))}

    return check


def fuzzy_lines(rows, tables):
    want = set()
    for d, t in texts(tables).items():
        kept = []
        for k, line in enumerate((t or "").split("\n")):
            if not any(fuzzy.is_near(line, x) for x in kept):
                kept.append(line)
                want.add((d, k, len(line)))
    assert {tuple(r) for r in rows} == want


def source_alignment(rows, tables):
    docs, lines, chunks = sorted(tables("documents"), key=lambda r: (r["lang"], r["doc_id"])), [], {}
    for r in docs:
        for k in range(0, len(r["text"]) + 1, 400):
            chunks[len(chunks)] = (r["lang"], r["text"][k : k + 400])
        lines += [(r["lang"], x) for x in r["text"].split("\n")]
    at = {}
    for r in sorted(rows, key=lambda r: r.place):
        lang, text = chunks[r.place]
        if r.line is None:
            continue
        assert lines[r.line][0] == lang == r.source and r.line >= at.get(lang, 0)  # never backwards, and never into another source
        held, bare = lines[r.line][1], lambda t: "".join(t.split())
        starts = {0, 5, 10, 20, 40, 80, len(text) // 2, max(0, len(text) - 80)}
        assert text and text in held or any(len(a := text[s : s + 10]) >= 8 and a in held or len(b := bare(text[s : s + 80])) >= 8 and b in bare(held) for s in starts)
        at[lang] = r.line
    assert len(rows) == len(chunks) and sum(r.line is not None for r in rows) > 0.9 * len(rows)


def spread_rows(rows, tables):
    """Sections and places without gaps; the chunks of a section hold its sentences, noise left out or not."""
    seen = {}
    for r in rows:
        seen.setdefault((r.doc_id, r.section), []).append((r.place, r.chunk_len))
    for (d, k), v in seen.items():
        assert sorted(p for p, _ in v) == list(range(len(v)))
        assert 0 < sum(n for _, n in v) <= sum(map(len, rounds.sentences(rounds.sections(texts(tables)[d])[k])))


def enhanced_chunk(rows, tables):
    spread_rows(rows, tables)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.chunk_len
    assert total == {d: n for d, t in texts(tables).items() if (n := sum(len(x) for s in rounds.sections(t or "") for x in rounds.sentences(s)))}


def paired_bootstrap(rows, tables):
    x = [r["l_discount"] - r["l_tax"] for r in tables("lineitem")]
    mean, sd = statistics.mean(x), statistics.stdev(x)
    (r,) = rows
    assert r.replicates == 200 and r.low < mean < r.high and abs((r.high - r.low) / (2 * 1.96 * sd / len(x) ** 0.5) - 1) < 0.3


def seeded_shuffle(rows, tables):
    assert [r.place for r in rows] == sorted(r.place for r in rows) and sorted(r.item_id for r in rows) == sorted(r["item_id"] for r in tables("benchmark"))
    assert [r.item_id for r in rows] != sorted(r.item_id for r in rows)


def cluster_cases(rows, tables):
    assert sum(r.n for r in rows) == len(tables("embeddings")) and [r.cluster for r in sorted(rows, key=lambda r: -r.n)] and 2 <= len(rows) <= 8


def embed_documents(rows, tables):
    by = {r.doc_id: r.embedding for r in rows}
    t = texts(tables)
    want = models.hashing_embedder()([t[d] or "" for d in by])
    assert all(abs(a - b) < 1e-6 for v, w in zip(by.values(), want, strict=True) for a, b in zip(v, w, strict=True))


def lsa_values(rows, tables):
    values = [r.value for r in sorted(rows, key=lambda r: r.component)]
    assert len(values) == 32 and values == sorted(values, reverse=True) and values[-1] > 0
    assert sum(v * v for v in values) < len(tables("documents"))  # unit rows: all squares sum up to their number


def iterate_prompt(rows, tables):
    assert {r.item_id for r in rows} == {r["item_id"] for r in tables("benchmark")}
    for r in rows:
        assert r.score == min(90.0, r.n_chars / 4)


CHECKS = {
    **{name: chunker(name) for name in chunkers.CHUNKERS}, "fuzzy_lines": fuzzy_lines, "source_alignment": source_alignment, "integrated_chunk": spread_rows,
    "enhanced_chunk": enhanced_chunk, "paired_bootstrap": paired_bootstrap, "seeded_shuffle": seeded_shuffle, "cluster_cases": cluster_cases,
    "embed_documents": embed_documents, "lsa_values": lsa_values, "iterate_prompt": iterate_prompt,
}
#: Nothing is found in the small tables.
MAY_BE_EMPTY = {"coref_consistency"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_against_what_they_must_hold(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir).collect()
    assert rows or name in MAY_BE_EMPTY
    if check := CHECKS.get(name):
        check(rows, lambda t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
