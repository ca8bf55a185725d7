import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import pairs, rounds


def plain(docs, least, most, denoise=True):
    """All three rounds by loops; docs by id."""
    held = {(d, k): rounds.sentences(s) for d, t in docs for k, s in enumerate(rounds.sections(t or ""))}
    pairs, firsts = Counter(), Counter()
    for s in held.values():
        joined = "".join(s)
        pairs.update(joined[i : i + 2] for i in range(len(joined) - 1))
    for g, n in pairs.items():
        firsts[g[0]] += n

    def ppl(s):
        out = []
        for i in range(len(s)):
            t = "".join(s[max(0, i - 3) : i + 1])
            loss = sum(math.log((firsts[t[j]] + 65536) / (pairs[t[j : j + 2]] + 1)) for j in range(len(t) - 1))
            out.append(round(min(1e6, math.exp(loss / (len(t) - 1))), 9) if len(t) > 1 else 100.0)
        return out

    found = []
    for (d, k), s in held.items():
        if not s:
            continue
        if denoise and len(s) > 1:
            p = ppl(s)
            mid = statistics.median(p)
            mad = statistics.median([abs(v - mid) for v in p])
            bar = mid + (3.5e-3 if mad < 1e-9 else 3.5 * 1.4826 * mad)
            s = [x for x, v in zip(s, p, strict=True) if v <= bar]
        p = ppl(s)
        bar = statistics.mean(p) + (statistics.stdev(p) if len(p) > 1 else 0)
        chunks = []
        for i, (x, v) in enumerate(zip(s, p, strict=True)):
            if i and v <= bar:
                chunks[-1] += x
            else:
                chunks.append(x)
        found += [(d, k, i, c) for i, c in enumerate(rounds.merge_rest(chunks, least, most))]
    return sorted(found)


def corpus(n):
    rnd = random.Random(n)
    words = ["西湖", "断桥", "景色", "the", "lake ", "bridge ", "很美", "门票", "一百", "zqxj"]
    sentence = lambda: "".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12))) + rnd.choice("。！？;\n")
    title = lambda: rnd.choice(["\n# 标题\n", "\n===== 章 =====\n", "\n---\n", "\n", ""])
    return [(i, "".join(title() + "".join(sentence() for _ in range(rnd.randrange(0, 9))) for _ in range(rnd.randrange(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("denoise", [True, False])
def test_rounds_against_loops(spark, denoise):
    docs = [*corpus(40), (100, None), (101, " \n "), (102, "只有一句"), (103, "a"), (104, "同" * 50 + "。" + "同" * 50)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, head string").repartition(3)
    got = sorted((r.doc_id, r.section, r.place, r.chunk_text) for r in rounds.integrated(df, 30, 60, denoise).collect())
    assert got == plain(docs, 30, 60, denoise)


def test_bounds_by_section_and_no_rows(spark):
    df = spark.createDataFrame([(1, "# A\n" + "一二三四五六。" * 20 + "\n# B\n" + "一二三四五六。" * 20)], "doc_id long, text string")
    most = F.when(F.col("head").startswith("# A"), 20).otherwise(50)
    sizes = {}
    for r in rounds.integrated(df, 5, most).collect():
        sizes[r.section] = max(sizes.get(r.section, 0), r.chunk_len)
    assert sizes[0] <= 22 < sizes[1] <= 55
    assert rounds.integrated(df.limit(0)).count() == 0


def test_heap_keeps_all_characters_and_cuts_what_is_too_long():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join("".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randrange(1, 40))) + "。" for _ in range(rnd.randrange(1, 12)))
        out = rounds.merge_by_gain(text, 25)
        assert Counter("".join(out)) == Counter(text)
    assert rounds.merge_by_gain("，" * 3, 2) == ["，，", "，"]
    assert rounds.merge_by_gain("甲甲。乙乙。甲甲。乙乙。", 6) == ["甲甲。乙乙。", "甲甲。乙乙。"]


def test_a_waiting_pair_is_merged_even_if_it_has_grown():
    # the best pair is the last two; the first two wait with a gain that no longer is theirs, and are merged beyond the limit, which cuts them
    out = rounds.merge_by_gain("甲乙。丙甲。丙甲。", 6)
    assert out == ["甲乙。丙甲。", "丙甲。"] and sum(map(len, out)) == 9


@pytest.mark.parametrize("most_sent", [0, 10**6])
def test_models_that_are_sent_and_joined_give_the_same(spark, most_sent):
    docs = [*corpus(40), (100, None), (102, "只有一句"), (103, "a"), (104, "𠀀" * 50 + "。" + "同" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.section, r.place, r.chunk_text) for r in rounds.integrated(df, 30, 60, most_sent=most_sent).collect())
    assert got == plain(docs, 30, 60)
    count, firsts = Counter(t[i : i + 2] for _, t in docs if t for i in range(len(t) - 1)), Counter()
    for g, n in count.items():
        firsts[g[0]] += n
    want = {d: (len(t) - 1, sum(math.log((firsts[t[i]] + 65536) / (count[t[i : i + 2]] + 1)) for i in range(len(t) - 1))) for d, t in docs if t and len(t) > 1}
    rows = {r.doc_id: r for r in pairs.sums(df, ["doc_id"], most_sent=most_sent).collect()}
    assert {d: r.n for d, r in rows.items()} == {d: n for d, (n, _) in want.items()}
    assert all(rows[d].loss == pytest.approx(loss) for d, (_, loss) in want.items())


def test_sections_do_not_go_through_an_exchange(spark):
    df = spark.createDataFrame(corpus(20), "doc_id long, text string").repartition(3)
    for done in (rounds.integrated(df, 30, 60), rounds.enhanced(df, 30, 60)):
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
