import random

import numpy as np
import pytest

from tessera.operators import fuzzy


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_near(a, b):
    short, long = (b, a) if len(a) > len(b) else (a, b)
    m = len(short)
    return min((plain_distance(long[i : i + m], short) for i in range(len(long) - m + 1)), default=m) < m / 4


def plain_distinct(texts):
    kept = []
    for k, t in enumerate(texts):
        if t is not None and not any(plain_near(t, texts[j]) for j in kept):
            kept.append(k)
    return kept


def varied(rnd, n, letters="abcd", longest=24):
    texts = []
    for _ in range(n):
        t = rnd.choice([*texts, ""]) if texts and rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randrange(longest)))
        chars = list(t)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(chars) + 1)
            chars[at : at + rnd.randrange(2)] = rnd.choice([[], ["é"], [rnd.choice(letters)]])
        texts.append(rnd.choice(["", "xyz"]) + "".join(chars))
    return texts


def test_distances():
    rnd = random.Random(1)
    for a, b in zip(varied(rnd, 400), varied(rnd, 400), strict=True):
        if a:
            assert fuzzy.Pattern(a).distance(b) == plain_distance(a, b)
        assert fuzzy.is_near(a, b) == plain_near(a, b) == fuzzy.is_near(b, a)


def test_near_copies_hold_enough_pieces():
    rnd = random.Random(2)
    texts = varied(rnd, 160)
    for a in texts:
        own, n, need = fuzzy.pieces(a)
        assert need >= 1
        for b in texts:
            if len(a) <= len(b) and plain_near(a, b):
                held = np.isin(own, fuzzy.codes(b, fuzzy.piece_size(len(a))))
                assert n[held].sum() >= need


@pytest.mark.parametrize("seed", [3, 4])
def test_lists_against_the_plain_scan(spark, seed):
    rnd = random.Random(seed)
    lists = {k: [*varied(rnd, 40), None, "", "", "a", "b a", "long " * 40, "long " * 39 + "lang "] for k in range(3)}
    lists[None] = ["one text of a list without a name", "one text of a list without a nam", "other"]
    rows = [(k, i, t, 7) for k, texts in lists.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "list long, place int, text string, a int").repartition(4)
    kept = fuzzy.fuzzy_distinct(df, ["list"], ["place"])
    assert kept.columns == df.columns
    assert {(r.list, r.place) for r in kept.collect()} == {(k, i) for k, texts in lists.items() for i in plain_distinct(texts)}


def test_one_list_and_no_rows(spark):
    schema = "place int, text string"
    texts = varied(random.Random(5), 60)
    df = spark.createDataFrame(list(enumerate(texts)), schema).repartition(3)
    assert sorted(r.place for r in fuzzy.fuzzy_distinct(df, [], ["place"]).collect()) == plain_distinct(texts)
    for rows in ([], [(1, None)]):
        assert fuzzy.fuzzy_distinct(spark.createDataFrame(rows, schema), [], ["place"]).count() == 0


def test_chains_are_settled_in_order(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    assert sorted(r.b for r in fuzzy.dropped(pairs).collect()) == [1, 3, 5, 7, 9]


def sentences(rnd, n, letters="eeettaaoinshrdlucmfgypw   ", longest=200):
    texts = []
    for _ in range(n):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest)))
        chars = list(rnd.choice([*texts, t])) if rnd.random() < 0.4 else list(t)
        for _ in range(rnd.randrange(2 + len(chars) // 6)):
            at = rnd.randrange(len(chars) + 1)
            chars[at : at + rnd.randrange(2)] = rnd.choice([[], ["é"], ["x"]])
        texts.append("".join(chars) + ("日本" * rnd.randrange(1, 600) if rnd.random() < 0.05 else ""))
    return [t for t in texts if t]


def test_the_bound_misses_no_near_copy_and_leaves_few_others():
    rnd = random.Random(6)
    texts = sorted(varied(rnd, 40) + sentences(rnd, 60), key=len)
    texts = [t for t in texts if t]
    s, l = np.triu_indices(len(texts), 1)  # noqa: E741
    near = {k for k in range(len(s)) if fuzzy.is_near(texts[s[k]], texts[l[k]])}
    left = set(fuzzy.possible(texts, np.zeros(len(texts), np.int64), s, l).tolist())
    assert near and near <= left
    long = {k for k in range(len(s)) if len(texts[s[k]]) > 60}
    assert len((left - near) & long) < 0.1 * len(long)


def test_blocks_of_a_list_and_no_rows_by_grams(spark, monkeypatch):
    rnd = random.Random(7)
    texts = list(dict.fromkeys(sentences(rnd, 40)))
    rows = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "_i long, _by long, _t string")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (b - a) % 2 == 0 and fuzzy.is_near(texts[a], texts[b])}
    written = []
    plain = fuzzy.materialize

    def counted(df, name="stage"):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "materialize", counted)
    assert sorted(map(tuple, fuzzy.near_pairs(rows).collect())) == sorted(want)
    assert len(want) > 5 and max(written[:-1]) <= 2  # a row for each list: no table of grams
    monkeypatch.setattr(fuzzy, "CHARS", 1000)
    monkeypatch.setattr(fuzzy, "PAIRS", 5)
    assert sorted(map(tuple, fuzzy.near_pairs(rows).collect())) == sorted(want)


def test_a_short_list_of_long_texts_is_dealt_in_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("eeettaaoinshrdlu  ") for _ in range(1500)) for _ in range(6)]
    texts[4] = texts[1][:700] + "x" + texts[1][700:]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "_i long, _by long, _t string")
    groups = []
    plain = fuzzy.materialize

    def seen(df, name="stage"):
        out = plain(df, name)
        if name == "sizes":
            groups.extend(r._n for r in out.collect())
        return out

    monkeypatch.setattr(fuzzy, "materialize", seen)
    monkeypatch.setattr(fuzzy, "CHARS", 3000)
    assert [tuple(r) for r in fuzzy.near_pairs(rows).collect()] == [(1, 4)] and groups == [4]
