import random
import re

import pytest

from tessera.operators import chunkers, models, rounds


def texts(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé日") for _ in range(rnd.randrange(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(1, 15))) + rnd.choice([".", "!", "。", ";", "\n", "\n\n", ""])
    return ["", " \n ", "a", "x" * 90, *["".join(sentence() for _ in range(rnd.randrange(1, 20))) for _ in range(n)]]


def test_lcs_against_the_table():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row.copy()
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        assert chunkers.lcs(a, b) == row[-1]
    assert chunkers.lcs(["w"] * 20_000, ["w"] * 20_000) == 20_000


def test_tail_overlap():
    assert chunkers.tail_overlap("一二三。四五六。七八九", 8, 2) == ["一二三。四五六", "五六七八九"]
    assert chunkers.tail_overlap("short\n\nlonger one; two; three", 12, 3) == ["short", "longer one", "onetwo。three"]
    for t in texts(60):
        out = chunkers.tail_overlap(t, 40, 10)
        plain = re.sub(r"[\s。！？；!?;]", "", t)
        again = re.sub(r"[\s。！？；!?;]", "", "".join(chunkers.tail_overlap(t, 40, 0)))
        assert again == plain and all(out)


def test_model_pack_keeps_all_sentences():
    for t in texts(60):
        out = chunkers.model_pack(t, 30)
        assert "".join(out) == "".join(re.findall(r"[^。！？\.!\?\n]+[。！？\.!\?\n]*", t))
        sentences = re.findall(r"[^。！？\.!\?\n]+[。！？\.!\?\n]*", t)
        assert all(len(c) <= 30 or c in sentences for c in out)
    assert chunkers.model_pack("x" * 70, 30) == ["x" * 30, "x" * 30, "x" * 10]
    assert chunkers.model_pack("ab. " + "x" * 40, 30) == ["ab.", " " + "x" * 40]  # what follows a chunk is not cut before the next one comes


def test_sentence_budget():
    for t in texts(60):
        out, s = chunkers.sentence_budget(t, 50), chunkers.split_sentences(t)
        assert " ".join(out) == " ".join(s)
        assert all(len(c.replace(" ", "")) <= 50 or len(chunkers.split_sentences(c)) == 1 or c in s for c in out)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 5.0])
def test_overlapping_minima(threshold):
    for t in texts(60):
        s = chunkers.split_sentences(t)
        v = chunkers.bigram_perplexities(s) if s else []
        cuts = [i for i in range(1, len(v) - 1) if v[i] < v[i - 1] and (v[i] < v[i + 1] and (v[i - 1] - v[i] >= threshold or v[i + 1] - v[i] >= threshold) or v[i] == v[i + 1] and v[i - 1] - v[i] >= threshold)]
        out = chunkers.overlapping_minima(t, threshold)
        assert len(out) == (len(cuts) + 1 if s else 0)
        begin = 0
        for chunk, end in zip(out, [*cuts, len(s) - 1] if s else [], strict=True):
            assert chunk == " ".join(s[begin : end + 1])
            begin = end


def test_margins_follow_their_last_five():
    values = iter([0.5, 0.4, -0.1, 0.9, 0.3, 0.39, 0.1])
    out = chunkers.margin_chunks("a. b. c. d. e. f. g. h.", lambda held, s: next(values))
    # the threshold is 0 up to five margins, then their mean: 0.4, and 0.378 behind 0.39
    assert out == ["a. b. c.", "d. e. f.", "g.", "h."]
    for t in texts(40):
        assert " ".join(chunkers.margin_chunks(t)) == " ".join(chunkers.split_sentences(t)) == " ".join(chunkers.margin_chunks(t, size=8))


def plain_best(text, most):
    units = rounds.sentences(text)
    while True:
        best, at = -1.0, -1
        for i in range(len(units) - 1):
            if len(units[i]) + len(units[i + 1]) <= most and (g := rounds.gain(rounds._Unit(units[i]), rounds._Unit(units[i + 1]))) > best:
                best, at = g, i
        if at < 0:
            return [u[k : k + most] for u in units for k in range(0, len(u), most)] or [text]
        units[at : at + 2] = [units[at] + units[at + 1]]


def test_best_pairs_against_scanning_all():
    for t in texts(80, 4):
        assert rounds.merge_best(t, 60) == plain_best(t, 60)


def test_adaptive_cut():
    # under the least never, from the most on always, and the bar falls and rises with what came so far
    assert rounds.adaptive_cut([100] * 7, [1.0] * 7, 300, 600) == [0, 6]
    assert rounds.adaptive_cut([100] * 3, [1, 1, 900], 300, 600) == [0]
    ppl = [10.0] * 4 + [16.0] + [10.0] * 5
    bar = 10.6 + (sum((p - 10.6) ** 2 for p in ppl) / 9) ** 0.5
    assert 16 > bar and rounds.adaptive_cut([100] * 10, ppl, 300, 900) == [0, 4] and 16 < bar * 1.3
    assert rounds.adaptive_cut([150] * 10, ppl, 300, 900) == [0, 6]  # 750 characters are over 1.2 of the aim of 450
    assert rounds.adaptive_cut([], [], 1, 2) == [0]


def test_enhanced_chunks_keep_all_sentences(spark):
    docs = [(i, t) for i, t in enumerate(texts(30, 5))] + [(100, None)]
    rows = rounds.enhanced(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 40, 90).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.section, r.place)):
        by[r.doc_id] = by.get(r.doc_id, "") + r.chunk_text
        assert r.chunk_len == len(r.chunk_text) <= 99
    assert by == {i: "".join(s) for i, t in docs if (s := rounds.sentences(t or ""))}


def test_iterations_of_every_prompt(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 400), (3, None)], "id long, p string")
    got = models.with_iterations(df, "p", lambda p: min(90.0, len(p) / 4), lambda p, s: p + " Be exact.", most=3).collect()
    assert sorted((r.id, r["round"], r.n_chars) for r in got) == [(1, 0, 5), (1, 1, 15), (1, 2, 25), (1, 3, 35), (2, 0, 400)]


def test_sentences_of_the_metrics():
    assert chunkers.metric_sentences("版本3.5发布了。It is v1.2 now. ok. 真的很不错吗？好\n新的一行没有标点") == ["版本3.5发布了。", "It is v1.2 now.", "真的很不错吗？", "新的一行没有标点"]
    assert chunkers.metric_sentences("end of it.") == ["end of it."] and chunkers.metric_sentences("") == []
    for t in texts(60):
        assert "".join("".join(chunkers.metric_sentences(t, 1)).split()) == "".join(t.split())
