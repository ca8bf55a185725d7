import json
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import lexical, nested

RANKING = {"ranking": [{"rank": k, "method": f"m{k} \"q\" }}],{{ \\", "why": {"a": [1, [2]]}} for k in range(1, 9)], "summary": "all \"fine\" ]}"}


def test_lists_cut_at_every_place():
    for dump in (json.dumps(RANKING), json.dumps(RANKING, indent=2, ensure_ascii=False)):
        ends, at = [], 0
        for k in range(8):
            at = dump.index(f'"rank": {k + 1},', at)
            depth = 0
            for i in range(dump.rindex("{", 0, at), len(dump)):
                try:
                    json.loads(dump[dump.rindex("{", 0, at) : i + 1])
                except ValueError:
                    continue
                depth = i + 1
                break
            ends.append(depth)
        for cut in range(len(dump) + 1):
            got = nested.repair(dump[:cut], 8)
            whole = sum(e <= cut for e in ends)
            if cut == len(dump):
                assert not got["truncated"] and not got["partial"] and got["summary"] == RANKING["summary"]
            if whole < 4:
                assert got is None, cut
            else:
                assert [r["rank"] for r in got["ranking"]] == list(range(1, whole + 1)) and got["partial"] == (whole < 8)
                assert got["ranking"][0]["method"] == RANKING["ranking"][0]["method"]


def test_answers_that_hold_no_ranking():
    for text in (None, "", "no", "[1, 2]", '{"ranking": []', '{"ranking": [{"rank": 1}], "summary": ""}', '{"ranking": [{"rank": 1, "method": "a"}]}', "]]", '{"a": [{}]', "[" * 100_000):
        assert nested.repair(text, 1) is None
    fenced = "```json\n" + json.dumps(RANKING) + "\n```"
    assert nested.repair(fenced, 8)["truncated"] is False and nested.repair(fenced, 17) is None


def walk(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield path, float(value)


def made(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 6 else 5)
    if kind >= 5:
        inner = [made(rnd, depth + 1) for _ in range(rnd.randrange(4))]
        return inner if kind == 5 else {f"k{i}": v for i, v in enumerate(inner)}
    return rnd.choice([rnd.randrange(-9, 10**12), rnd.random() * 10 ** rnd.randrange(-8, 12), "7", True, None])


def test_numbers_against_a_walk(spark):
    rnd = random.Random(3)
    values = [{"a": made(rnd)} for _ in range(60)] + [5, [1, [2, {"x": 3}]], "text", {}]
    rows = [(i, json.dumps(v), "clash") for i, v in enumerate(values)] + [(100, None, ""), (101, "{broken", "")]
    df = spark.createDataFrame(rows, "id long, js string, v string").repartition(3)
    got = sorted((r.id, r.path, r.value) for r in nested.numbers(df, "id", "js").collect())
    want = sorted((i, p, x) for i, v in enumerate(values) for p, x in walk(v))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(math.isclose(g[2], w[2], rel_tol=1e-12) for g, w in zip(got, want, strict=True))
    one = nested.metrics(spark.createDataFrame([(1, '{"m": [1, 2, 6], "n": {"x": 2.5}}')], "id long, js string"), "id", "js").collect()
    assert sorted((r.path, r.n, r["mean"]) for r in one) == [("m[]", 3, 3.0), ("n.x", 1, 2.5)]
    assert nested.numbers(df.limit(0), "id", "js").count() == 0


def plain_bm25(docs, queries, k):
    words = {d: re.findall("[一-鿿]|[a-z0-9]+", (t or "").lower()) for d, t in docs}
    df, mean = Counter(w for v in words.values() for w in set(v)), sum(map(len, words.values())) / sum(map(bool, words.values()))
    out = []
    for q, t in queries:
        found = []
        for d, v in words.items():
            n = Counter(v)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(v) / mean)) for w in set(re.findall("[一-鿿]|[a-z0-9]+", (t or "").lower())) if n[w])
            if s:
                found.append((-round(s, 6), d))
        out += [(q, d, -s, i) for i, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_bm25_against_loops(spark):
    rnd = random.Random(4)
    words = ["red", "blue", "Green", "the", "日", "本", "x1", "rare"]
    docs = [(i, " ".join(rnd.choice(words[:7]) for _ in range(rnd.randrange(0, 30)))) for i in range(80)] + [(80, None), (81, "rare"), (82, "rare")]
    queries = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 5)))) for i in range(20)] + [(20, "nothing"), (21, None), (22, "rare")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(queries, "query_id long, text string")
    for block in (256, 7):
        got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in lexical.bm25(d, q, 5, block=block).collect())
        want = plain_bm25(docs, queries, 5)
        assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
        assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert [r.chunk_id for r in lexical.bm25(d, q.filter("query_id = 22"), 1).collect()] == [81]
    assert lexical.bm25(d, q.filter(F.lit(False)), 5).count() == 0 and lexical.bm25(d.limit(0), q, 5).count() == 0
