import math
import random
from collections import Counter

from tessera.operators import dims
from tessera.operators.dims import Decision


def plain_measures(tags, n):
    out = {}
    for dim in {d for _, d, _ in tags}:
        own = [(c, t) for c, d, t in tags if d == dim]
        counts = Counter(t for _, t in own)
        h = -sum(k / len(own) * math.log(k / len(own)) for k in counts.values())
        out[dim] = len({c for c, _ in own}) / n, h / math.log(len(counts)) if len(counts) > 1 else 0.0
    return out


def made(spark):
    rnd = random.Random(1)
    tags = []
    for c in range(100):
        tags += [(c, "colour", rnd.choice("rgb")), (c, "size", rnd.choice(["s", "m", "l"])), (c, "constant", "x")]
        if c % 2:
            tags.append((c, "colours", rnd.choice("rgb")))
        if c < 5:
            tags += [(c, "sizes", rnd.choice(["s", "m"])), (c, "rare", "r")]
    return tags, spark.createDataFrame(tags, "chunk_id long, dim string, tag string").repartition(3)


def test_default_decisions_reach_a_fixed_point(spark):
    tags, df = made(spark)
    got = dims.optimize(df, 100)
    assert got.converged
    # colours is alike in name and values; sizes is rare and alike in name; rare and constant say nothing
    name = {"colours": "colour", "sizes": "size"}
    want = {(c, name.get(d, d), t) for c, d, t in tags if d not in ("rare", "constant")}
    assert {tuple(r) for r in got.tags.collect()} == want
    assert {(d.dim, d.action, d.target) for d in got.rounds[0]} == {("colours", "MERGE", "colour"), ("sizes", "MERGE", "size"), ("rare", "DELETE", None), ("constant", "DELETE", None)}
    measured = plain_measures(want, 100)
    assert all(c >= dims.COVERAGE and h >= dims.ENTROPY for c, h in measured.values())
    assert dims.optimize(got.tags, 100).rounds == [[]]  # nothing more to do


def test_every_kind_of_decision(spark):
    df = spark.createDataFrame([(c, d, f"{d}{c % 4}") for c in range(40) for d in "abcdefg"] + [(c, "low", "v") for c in range(2)], "chunk_id long, dim string, tag string")
    asked = []

    def decide(issues):
        asked.append({i.dim: (i.kind, i.targets) for i in issues})
        if len(asked) > 1:
            return [Decision(i.dim, "KEEP") for i in issues]
        return [Decision("low", "DELETE"), Decision("a", "MERGE", "b"), Decision("b", "MERGE", "c"), Decision("d", "RENAME", "delta"), Decision("e", "SPLIT", parts={"e0": "even", "e2": "even", "e1": "d"}), Decision("f", "RENAME", "thin"), Decision("g", "KEEP")]

    got = dims.optimize(df, 40, decide)
    by = {}
    for r in got.tags.collect():
        by.setdefault(r.dim, set()).add(r.tag)
    assert by == {"c": {f"{d}{k}" for d in "abc" for k in range(4)}, "delta": {"d0", "d1", "d2", "d3", "e1"}, "even": {"e0", "e2"}, "thin": {f"f{k}" for k in range(4)}, "g": {f"g{k}" for k in range(4)}}
    assert asked[0] == {"low": ("coverage", tuple("abcdefg"))} and got.converged


def test_chains_and_circles():
    end = lambda *ds: dims.resolved([Decision(*d) for d in ds])
    assert end(("a", "MERGE", "b"), ("b", "RENAME", "c"), ("c", "MERGE", "d")) == {"a": "d", "b": "d", "c": "d"}
    assert end(("a", "MERGE", "b"), ("b", "DELETE")) == {"a": None, "b": None}
    assert end(("b", "MERGE", "a"), ("a", "MERGE", "b"), ("z", "MERGE", "b")) == {"b": "a", "z": "a"}
    assert end(("a", "KEEP"), ("b", "MERGE", "b")) == {}


def test_new_names_must_pass_and_empty_tags(spark):
    df = spark.createDataFrame([(c, "one", "x") for c in range(10)], "chunk_id long, dim string, tag string")
    got = dims.optimize(df, 10, lambda issues: [Decision(i.dim, "RENAME", i.dim + "2") for i in issues])
    assert got.tags.count() == 0  # the new name says as little as the old one
    assert dims.optimize(df.limit(0), 10).converged
