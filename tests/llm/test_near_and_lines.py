import random

import numpy as np
import pytest
import xxhash

from tessera.llm import line_dedup, simhash_anchor
from tessera.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, fp long"  # fp: a column that clashes with the operator's own


def slow_fingerprint(text, width=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    ids = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = ids[i], ids[j]
                ids = [b if x == a else x for x in ids]
    return ids


@pytest.mark.parametrize("text", ["", "a", "A b c", "the THE the the the", "é\u00a0É x\ty\nz w  v", "one two three four five six"])
def test_fingerprint_of_short_texts(text):
    assert simhash_anchor.fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_of_a_long_text():
    rnd = random.Random(5)
    text = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(70_000))
    assert simhash_anchor.fingerprint(text.encode()) == slow_fingerprint(text)


def test_every_pair_within_two_bits_meets_at_a_home():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 31, 200)
    patterns = simhash_anchor.error_patterns()
    assert patterns.shape == (32, simhash_anchor.REPLICAS)
    for x in words.tolist():
        y = x ^ (1 << int(rnd.integers(31))) ^ (1 << int(rnd.integers(31)))
        home = simhash_anchor.homes(np.array([x]))[0]
        sent = np.array([y])[:, None] ^ patterns[simhash_anchor.syndrome(np.array([y]))]
        assert home in sent[0]
        assert int(home ^ x).bit_count() <= 1


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghijklmnop") * 3 for _ in range(n)) for n in (3, 8, 60, 200, 400)]
    rows = []
    for text in base:
        for _ in range(8):
            words = text.split()
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = "changed"
            rows.append(" ".join(words))
    rows += ["", None, " \t\n", base[0], base[0].upper()]
    ids = list(range(100, 100 + len(rows)))
    rnd.shuffle(ids)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, rows, strict=True)], DOCS)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_anchor.near_duplicates(df).collect()}
    fps = [slow_fingerprint(t) for t in rows]
    assert {i: v[0] & (2**64 - 1) for i, v in got.items()} == dict(zip(ids, fps, strict=True))
    groups = brute_components(fps)
    least = {g: min(i for i, h in zip(ids, groups, strict=True) if h == g) for g in groups}
    assert {i: v[1] for i, v in got.items()} == {i: least[g] for i, g in zip(ids, groups, strict=True)}


@pytest.mark.parametrize("hot", [False, True])
def test_random_fingerprints_lose_no_link(spark, hot, monkeypatch):
    rnd = random.Random(9)
    fps = []
    if hot:  # one half in common, so an anchor has most homes: dealt to parts, compared in small chunks
        monkeypatch.setattr(simhash_anchor, "HOT_HOMES", 20)
        monkeypatch.setattr(simhash_anchor, "HOT_ANCHORS", 100)
        fps = [rnd.getrandbits(32) << 32 | 0x12345678 for _ in range(150)] + [0x12345678 ^ (rnd.getrandbits(10) << 34) ^ (1 << rnd.randrange(32)) for _ in range(150)]
    for _ in range(150):
        x = rnd.getrandbits(64)
        fps.append(x)
        for _ in range(2):
            y = x
            for j in rnd.sample(range(64), rnd.randrange(1, 7)):
                y ^= 1 << j
            fps.append(y)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash_anchor.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_components(fps)
    mine = [roots.get(s, s) for s in signed]
    parts = simhash_anchor.hot_anchors(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps))
    assert bool(parts) == hot and all(n > 1 for n in parts.values())
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))


def test_chunks_and_parts_find_the_same_links(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(10)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = np.array(sorted({b ^ sum(1 << j for j in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(60)}), np.uint64).view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(fps)], ["fp"])
    home = np.concatenate([simhash_anchor.homes(simhash_anchor._half(fps, h)) | h << simhash_anchor.BITS for h in (0, 1)])

    def components(hot, step):
        monkeypatch.setattr(simhash_anchor, "ROWS_AT_ONCE", step)
        sent = list(simhash_anchor._replicate(hot)([batch]))
        slot, fp = (np.concatenate([b.column(c).to_numpy() for b in sent]) for c in (0, 1))
        order = np.argsort(slot, kind="stable")
        pieces = [pa.RecordBatch.from_arrays([pa.array(slot[p]), pa.array(fp[p])], ["slot", "fp"]) for p in np.array_split(order, max(1, len(order) // min(step, 5000)))]
        label = {x: x for x in fps.tolist()}
        for b in simhash_anchor._compare(4)(iter(pieces)):
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = label[x], label[y]
                label = {k: min(a, c) if v in (a, c) else v for k, v in label.items()}
        return label

    groups = brute_components(fps.view(np.uint64).tolist())
    for hot, step in (({}, 10**6), ({}, 37), ({int(a): 3 for a in home}, 10**6), ({int(a): 2 for a in home}, 11)):
        found = components(hot, step)
        assert len({(found[x], g) for x, g in zip(fps.tolist(), groups, strict=True)}) == len(set(groups)) == len(set(found.values())), step


def test_keep_one_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c d e", "x", 1), (1, "A b c d e", "x", 1), (2, "other words are here now", "x", 1), (None, "a b c d e", "x", 1), (4, None, "x", 1), (5, "", "x", 1)], DOCS)
    kept = simhash_anchor.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert simhash_anchor.near_duplicates(df.limit(0)).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert set(roots[i] for i in range(41)) == {0} and roots[101] == roots[100] == 100


def brute_lines(rows, min_docs=2, min_chars=10):
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and d is not None and d != min(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_match_brute_force(spark, min_docs):
    shared = ["A common line here", "a COMMON line here\r", "\x0b a common line here \t", "short", "ééééééééé", "éééééééééé", "\u00a0not stripped\u00a0"]
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice([*shared, f"line number {rnd.randrange(9)} of text"]) for _ in range(rnd.randrange(1, 9)))) for i in range(40)]
    rows += [(41, None), (42, ""), (43, "\n\n"), (None, shared[0]), (0, shared[0]), (44, "x" * 300_000 + "\n" + shared[0])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = line_dedup.dedup_lines(df, min_docs).select("doc_id", "n_lines", "n_dropped", "kept", "lang", "fp").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(brute_lines(rows, min_docs), key=order)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    named = df.withColumnsRenamed({"fp": "_doc"}).selectExpr("*", "1 AS _lost", "2 AS _kept", "3 AS kept", "4 AS row", "5 AS key", "6 AS n_lines")
    done = line_dedup.dedup_lines(named, min_docs)
    assert done.columns == [*named.columns, "n_dropped"] and sorted(r.kept for r in done.collect()) == sorted(r.kept for r in got)
    rest = line_dedup.without_repeats(named, min_docs)
    assert rest.columns == named.columns and rest.select("_lost", "_kept", "kept", "n_lines").distinct().collect() == [(1, 2, 3, 6)]
    assert sorted(r.text for r in rest.collect()) == sorted(r.kept for r in got)
