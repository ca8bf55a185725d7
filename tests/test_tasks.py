import math
import random
import re
from collections import Counter

from tessera.operators import tasks


def plain(reference, generated):
    r, h = (re.findall("[一-鿿]|[a-z0-9]+", (t or "").lower()) for t in (reference, generated))
    penalty = 0.0 if not h else math.exp(1 - len(r) / len(h)) if len(h) < len(r) else 1.0
    out = []
    for n in range(1, 5):
        a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (h, r))
        out.append(penalty * sum((a & b).values()) / max(1, len(h) - n + 1))
    table = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
    for i, x in enumerate(r):
        for j, y in enumerate(h):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    n = table[-1][-1]
    f = 2 * (n / len(h)) * (n / len(r)) / (n / len(h) + n / len(r)) if n else 0.0
    return [sum(out) / 4, *out, f, float(len(generated or ""))]


def test_scores_against_loops(spark):
    rnd = random.Random(1)
    words = ["the", "lake", "is", "deep", "湖", "水", "x1"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 15)))
    rows = [(rnd.choice(["summary", "continuation", "edit"]), i, text(), text()) for i in range(60)] + [("edit", 60, None, "a b"), ("edit", 61, "a b", None), ("edit", 62, "a b c d e", "a b c d e"), ("edit", 63, "a", " ")]
    df = spark.createDataFrame(rows, "task string, id long, reference string, generated string").repartition(3)
    got = {r.id: r for r in tasks.scores(df).collect()}
    for _, i, ref, gen in rows:
        want = plain(ref, gen)
        assert all(abs(got[i][m] - w) < 1e-4 for m, w in zip(tasks.METRICS, want, strict=True)), (ref, gen)
        assert got[i].valid == bool((gen or "").strip())
    by = {r.task: r for r in tasks.overall(tasks.scores(df)).collect()}
    for task in ("summary", "continuation", "edit"):
        own = [got[i] for t, i, *_ in rows if t == task]
        assert by[task].num == len(own) and by[task].valid == sum(r.valid for r in own)
        assert all(abs(by[task][m] - sum(r[m] for r in own) / len(own)) < 1e-5 for m in tasks.METRICS)
