import re

from tessera.sources import files, guides

RULED = '"a1": "塔",\n' + "-" * 30 + "\n\n很高。\n第二行\n" + "-" * 30 + "\n" + '"b": "湖"\n' + "-" * 30 + "\n很大"
BODY = "这是一段足够长的正文，" * 6
TITLED = f"塔林\n{BODY}\n{BODY}\n\n小寺\n{BODY}\n\n尾\n短名\n短文"


def test_both_formats_and_whole_files():
    assert guides.ruled(RULED) == [("a1", "塔", "很高。\n第二行"), ("b", "湖", "很大")]
    got = guides.introduction(RULED, "区")
    assert [(r["chunk_id"], r["title"], r["text"]) for r in got] == [("区_a1", "塔", "【塔】\n很高。\n第二行"), ("区_b", "湖", "【湖】\n很大")]
    got = guides.introduction(TITLED, "区")
    assert [(r["chunk_id"], r["title"]) for r in got] == [("区_POI_000", "塔林"), ("区_POI_001", "小寺")]
    assert got[0]["text"] == f"【塔林】\n{BODY}\n{BODY}"
    whole = "很长的一行没有标题" * 20
    assert [(r["chunk_id"], r["title"], r["text"]) for r in guides.introduction(f"\n{whole}\n", "区")] == [("区_intro", "区景区介绍", whole)]
    assert guides.introduction("短", "区") == [] == guides.introduction("", "区")


def test_titles_are_those_of_the_grammar():
    # a title, a body that begins on the next line, and what ends it, as one expression
    grammar = re.compile(r"^([^\n]{2,20})\n([^\n].*?)(?=\n[^\n]{2,20}\n|\Z)", re.MULTILINE | re.DOTALL)
    import random

    rnd = random.Random(1)
    for _ in range(500):
        text = "\n".join(rnd.choice(["", "x", "ab", "title", "a line of more than twenty characters", "y" * 20, "z" * 21]) for _ in range(rnd.randrange(0, 9)))
        assert guides.titled(text) == grammar.findall(text), text


def test_sentences():
    got = guides.operation('开放时间为每天上午八点。短。他说“好。"门票价格为一百元每人。', "区")
    assert [(r["chunk_id"], r["text"]) for r in got] == [("区_operation_0000", "开放时间为每天上午八点。"), ("区_operation_0002", '他说“好。"门票价格为一百元每人。')]


def test_rows_of_files(spark, tmp_path):
    (tmp_path / "south").mkdir()
    (tmp_path / "south" / "intro.md").write_text(RULED)
    (tmp_path / "south" / "empty.md").write_text("")
    rows = guides.rows(files.directory(spark, str(tmp_path), "*.md"), "introduction").collect()
    assert sorted((r.chunk_id, r.area, r.source_file) for r in rows) == [("south_a1", "south", "intro.md"), ("south_b", "south", "intro.md")]


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) if i % 7 else "  " for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(text))
    (tmp_path / "small.txt").write_bytes(b"one\r\n\r\n three \r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = {r.doc_id: r.text for r in files.lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {f"big_line_{i:05d}": t.strip() for i, t in enumerate(text) if t.strip()}
    assert got == want | {"small_line_00000": "one", "small_line_00002": "three"}


def test_chunk_files_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("chunk_000", "a  b\r\n c"), ("chunk_001", " \n "), ("chunk_002", None), ("chunk_003", "d")], "chunk_id string, chunk_text string")
    path = str(tmp_path / "out")
    assert files.write_chunk_files(df, path) and files.finished(spark, path)
    assert sorted(tuple(r) for r in files.read_chunk_files(spark, path).collect()) == [("chunk_000", "a b c"), ("chunk_003", "d")]
    assert not files.write_chunk_files(df.limit(0), path) and files.read_chunk_files(spark, path).count() == 2


def test_shapes_of_chunk_files(spark, tmp_path):
    def read(text):
        (tmp_path / "c.json").write_text(text)
        return sorted(tuple(r) for r in files.chunk_json(spark, str(tmp_path / "c.json")).collect())

    assert read('[{"id": 1, "text": "x"}, {"id": 2, "text": " "}, {"text": "y"}]') == [("1", "x"), ("chunk_000002", "y")]
    assert read('[{"doc_id": "a", "doc_text": "x"}]') == [("a", "x")]
    assert read('{"documents": [{"docid": "a", "content": "x"}, {"content": "y"}]}') == [("a", "x"), ("chunk_000001", "y")]
    assert read('[{"doc_id": "d", "file_name": "f", "chunks": [{"chunk_text": "one"}, {"chunk_text": ""}, {"chunk_text": "two"}]}, {"doc_id": "e", "chunks": []}]') == [("d", "one\n\ntwo")]


def test_clean_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questanswer_1doc": [{"ID": "1", "questions": " q ", "answers": "a"}, {"ID": "2", "questions": " ", "answers": "a"}], "questanswer_3docs": [{"ID": "3", "questions": "q", "answers": null}, {"ID": "4", "questions": "q", "answers": "b"}], "other": [{"ID": "5"}]}')
    assert [tuple(r) for r in files.clean_questions(spark, str(tmp_path / "q.json")).collect()] == [("questanswer_1doc", "1", "q", "a"), ("questanswer_3docs", "4", "q", "b")]


def test_nested_answers_against_loops(spark, tmp_path):
    import json
    import random

    from tessera.sources import answers

    rnd = random.Random(3)
    place = lambda: rnd.choice([-1, 0, 1, 2, 5, 9, 40])
    schema = (
        "id long, question struct<text: string>, document struct<html: string>, long_answer_candidates struct<top_level: array<boolean>, start_token: array<int>, end_token: array<int>>, "
        "annotations struct<id: array<string>, long_answer: array<struct<start_token: int, end_token: int>>, short_answers: array<struct<text: array<string>, start_token: array<int>, end_token: array<int>>>, yes_no_answer: array<int>>"
    )
    rows = []
    for i in range(40):
        n, m = rnd.randrange(0, 15), rnd.randrange(0, 4)
        spans = lambda k: ([place() for _ in range(k)], [place() for _ in range(k)])
        shorts = []
        for _ in range(m):
            k = rnd.randrange(0, 3)
            shorts.append((rnd.sample(["w1", "w2 w3", "no"], rnd.randrange(0, 3)), *spans(k)))
        html = "<p>" + " ".join(f"w{k}" for k in range(rnd.randrange(0, 12))) + "</p><script>x</script>"
        rows.append((i, (f"q{i}",), (html,), ([rnd.random() < 0.7 for _ in range(n)], *spans(n)), ([f"a{k}" for k in range(m)], [(place(), place()) for _ in range(m)], shorts, [rnd.choice([-1, 0, 1]) for _ in range(m)])))
    rows.append((99, None, None, None, None))
    got = {r.id: r for r in answers.records(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows) and got["99"].document == "" and got["99"].long_answer_candidates == [] and got["99"].annotations.short_answers == []
    for i, q, (html,), (top, start, end), (ids, longs, shorts, yes) in rows[:-1]:
        r, words = got[str(i)], re.findall(r"w\d+", html)
        ok = lambda s, e: 0 <= s < e and s < len(words)  # noqa: B023, E731
        text = lambda s, e: " ".join(words[s:e])  # noqa: B023, E731
        assert r.question == q[0] and r.document == " ".join(words)
        assert [tuple(c) for c in r.long_answer_candidates] == [(k, s, e, text(s, e)) for k, (t, s, e) in enumerate(zip(top, start, end, strict=True)) if t and ok(s, e)][:10]
        held = []
        for own, s, e in shorts:
            held += own
            for a, b in zip(s, e, strict=True):
                if ok(a, b) and text(a, b) not in held:
                    held.append(text(a, b))
        assert r.annotations.short_answers == held
        assert [tuple(c) for c in r.annotations.long_answers] == [(a, s, e, text(s, e)) for a, (s, e) in zip(ids, longs, strict=True) if ok(s, e)]
        assert r.annotations.yes_no_answer == next((("NO", "YES")[v] for v in yes if v >= 0), None)
    files.write_json(answers.records(spark.createDataFrame(rows[:2], schema)), str(tmp_path / "out"))
    assert sorted(json.loads(x)["id"] for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()) == ["0", "1"]
