import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from tessera.llm import line_dedup, queries, shard_balance, simhash_anchor, url_reputation
from tessera.llm.common import indexed
from tessera.llm.queries import RULES


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    cut = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host.translate({c: c + 32 for c in range(65, 91)}), tail[:cut]


def slow_rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith("/" + r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_rules_and_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "https://example.com/en/8#f", "ftp://x.net/de/1", "http://example.net/de/81", "http://notexample.net/de/8", "http://org/es/", "http://org?x://y/es/", "http://É.org/es/\n", "http://u@h.co.uk:80/p", "http://1.2.3.4/", "http://com/EN/"]
    urls += ["http://bad.site/"] * 60 + ["http://good.site/"] * 60
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)] + [(None, urls[3], None, "x")], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(i, 0 if "bad" in (u or "") else 1, 0) for i, u in enumerate(urls)] + [(20, 1, None), (21, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = url_reputation.judge(pages, labels, RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        if r.page_id is None:
            continue
        host, path = slow_parts(urls[r.page_id])
        rule = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, f"{rule[1]}/{rule[2]}" if rule else None), urls[r.page_id]
        if rule:
            assert r.verdict == rule[0]
        elif r.page_id >= 14:
            assert r.verdict == ("block" if "bad" in urls[r.page_id] else "allow")
    allowed = url_reputation.keep_allowed(pages, labels, RULES)
    assert allowed.columns == pages.columns and allowed.filter("url LIKE '%bad%'").count() == 0
    assert url_reputation.judge(pages.limit(0), labels, RULES).count() == 0
    assert {r.verdict for r in url_reputation.judge(pages, labels.limit(0), []).collect()} == {"allow"}


def test_posterior_is_shrunk(spark):
    rows = [(f"h{i}.one.org", int(j < i)) for i in range(5) for j in range(10)] + [("new.one.org", None), ("tiny.two.org", 1)]
    found = {r.host: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert found["h0.one.org"].mean > 0 and found["h4.one.org"].mean < 0.41
    assert found["tiny.two.org"].mean < 1 and found["new.one.org"].bound < found["new.one.org"].mean


def test_suffix_table(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\n\ncom\nuk\nco.uk // two\n*.ck\n!www.ck\nblogs.example\n")
    rules = url_reputation.public_suffixes(spark, str(tmp_path / "rules.dat"))
    want = {
        "a.b.com": ("b.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "y.uk": ("y.uk", "uk"), "a.b.c.ck": ("b.c.ck", "c.ck"), "a.www.ck": ("www.ck", "ck"),
        "me.blogs.example": ("me.blogs.example", "blogs.example"), "a.unknown": ("a.unknown", "unknown"), "com": ("com", ""), "": ("", ""), "1.2.3.4:80": ("1.2.3.4", ""),
    }
    rows = url_reputation.with_domain(spark.createDataFrame([(h,) for h in want], "host string"), suffixes=rules).collect()
    assert {r.host: (r.domain, r.suffix) for r in rows} == want
    plain = url_reputation.with_domain(spark.createDataFrame([("x.y.co.uk",), ("a.b.com",)], "host string")).collect()
    assert {(r.domain, r.suffix) for r in plain} == {("y.co.uk", "co.uk"), ("b.com", "com")}


def test_method_blocks_and_allows_hosts_of_the_driver_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op1_url_reputation(spark, d).filter("rule IS NULL").collect()
    assert {r.verdict for r in rows} == {"allow", "block"}
    by_host = {}
    for r in rows:
        by_host.setdefault(r.host, set()).add(r.verdict)
    assert all(len(v) == 1 for v in by_host.values())
    # a host whose pages are all labelled bad is blocked, whatever the other pages' rate
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")
    worse = spark.createDataFrame([(10_000 + i, f"https://junk.example.org/{i}") for i in range(30)], pages.schema)
    marks = spark.createDataFrame([(10_000 + i, 0, 0) for i in range(30)], labels.schema)
    seen = url_reputation.judge(pages.unionByName(worse), labels.unionByName(marks), []).filter("host = 'junk.example.org'").collect()
    assert {r.verdict for r in seen} == {"block"}


def test_allowed_pages_keep_clashing_columns(spark):
    pages = spark.createDataFrame([(i, "http://bad.site/" if i % 2 else "http://good.site/", 1, 2, 3, 4) for i in range(80)], "page_id long, url string, host int, _host int, _blocked int, row int")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    kept = url_reputation.keep_allowed(pages, labels)
    assert kept.columns == pages.columns and sorted(kept.collect()) == sorted(r for r in pages.collect() if "good" in r.url)


def test_ranks_are_gapless(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id")
    got = sorted((r.k, r.id, r.idx) for r in indexed(df, ["k", "id"]).collect())
    assert [x[2] for x in got] == list(range(1000))


@pytest.mark.parametrize(("texts", "shards"), [([f"t{i}" for i in range(95)] + ["same"] * 60 + ["pair", "pair", None, "", "x" * 200_000], 7), (["one"] * 50, 8), (["a", "a", "b", "b"] * 10, 4), ([], 3), (["only"], 40)])
def test_shards_are_even_and_keep_groups(spark, texts, shards):
    df = spark.createDataFrame([(i // 2 if i < 4 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    rows = shard_balance.shard(df, shards).collect()
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert not rows or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    groups = {}
    for r in rows:
        groups.setdefault((r.h1, r.h2), Counter())[r.shard] += 1
    quota = -(-len(texts) // shards) if texts else 1
    # no group lies in many more shards than it must
    for c in groups.values():
        assert len(c) <= -(-sum(c.values()) // quota) + 2


def test_admission_never_exceeds_room():
    rnd = random.Random(8)
    for shards in (1, 2, 5, 40):
        for _ in range(20):
            wishes = {(a, b): rnd.randrange(9) for a in range(shards) for b in range(shards) if a != b and rnd.random() < 0.4}
            room = [rnd.choice([0, 0, rnd.randrange(6)]) for _ in range(shards)]
            may = shard_balance.admitted(wishes, room)
            assert all(0 < n <= wishes[p] for p, n in may.items())
            for s in range(shards):
                assert sum(n for (_, b), n in may.items() if b == s) - sum(n for (a, _), n in may.items() if a == s) <= room[s]
    assert shard_balance.admitted({(0, 1): 4, (1, 2): 3, (2, 0): 5}, [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}  # a circle without room


def slow_propagation(sizes, quota, least):
    """The rounds, with documents in place of tables: the shard of each linked document, by group."""
    shards, firsts = len(quota), [sum(sizes[:i]) for i in range(len(sizes))]
    homes = {g: [(g + j) % shards for j in range(n)] for g, n in zip(firsts, sizes, strict=True)}
    cut = lambda: sum(x != y for h in homes.values() for i, x in enumerate(h) for y in h[:i])
    before = cut()
    number = idle = 0
    while idle < shard_balance.PATIENCE:
        load = Counter(s for h in homes.values() for s in h)
        assert all(load[s] <= q for s, q in enumerate(quota))
        open_ = {s for s, q in enumerate(quota) if 50 * (q - load[s]) > q}
        moves = []
        factor = shard_balance.tie_factor(number)
        for g, h in homes.items():
            n = Counter(h)
            b = max(n, key=lambda s: (s in open_, n[s], (g % shard_balance.PRIME + s) * factor % shard_balance.PRIME))
            moves += [(s, b, -(n[b] - n[s] + 1).bit_length(), g) for s in n if s != b and n[b] >= n[s] for _ in range(n[s])]
        may = shard_balance.admitted(dict(Counter((s, b) for s, b, _, _ in moves)), [q - load[s] for s, q in enumerate(quota)])
        for pair, n in may.items():
            for s, b, _, g in [m for m in sorted(moves) if m[:2] == pair][:n]:
                homes[g][homes[g].index(s)] = b
        number, idle = number + 1, idle + 1 if sum(may.values()) <= least * sum(sizes) else 0
    return {(g, s): n for g, h in homes.items() for s, n in Counter(h).items()}, before, cut(), number


@pytest.mark.parametrize(("unlinked", "shards"), [(0, 40), (20, 40), (60, 40), (150, 40), (0, 3)])
def test_quotas_hold_and_links_are_kept(spark, unlinked, shards):
    rnd = random.Random(unlinked)
    sizes = [90, 200] if shards == 3 else []
    while sum(sizes) < 1200:
        sizes.append(rnd.choice([2, 2, 3, 4, 5]))
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(unlinked)]
    rnd.shuffle(texts)
    rows = shard_balance.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards, least=0.03).collect()
    counts = Counter(r.shard for r in rows)
    assert sum(counts.values()) == len(texts) and set(counts) <= set(range(shards))
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    # where each group's documents are, against plain Python
    found = {}
    for r in rows:
        found.setdefault((r.h1, r.h2), Counter())[r.shard] += 1
    groups = [found[h] for h in sorted(found) if found[h].total() > 1]
    sizes = [n.total() for n in groups]
    want, before, after, _ = slow_propagation(sizes, shard_balance.quotas(len(texts), shards), 0.03)
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    assert {(g, s): k for g, n in zip(firsts, groups, strict=True) for s, k in n.items()} == want
    assert after < 0.9 * before, (before, after)
    cohorts = spark.createDataFrame([(g, s, n) for (g, s), n in want.items()], "g long, s int, n long")
    assert shard_balance.cut_links(cohorts) == after


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert rows, name
        if k < 4:
            assert out.columns == columns, name
        kept = {r.doc_id for r in rows}
        if name == "lines":
            want = {r.doc_id: r.kept for r in line_dedup.dedup_lines(docs).collect()}
            assert {r.doc_id: r.text for r in rows} == want and kept == set(before)
        elif name == "near_duplicates":
            found = {r.doc_id: r.component_id for r in simhash_anchor.near_duplicates(docs).collect()}
            assert kept == {d for d, c in found.items() if d == c}
        elif name == "segmentation":
            assert kept == set(before) and all(r.lossless for r in rows)
        docs = out if k == 4 else spark.createDataFrame(out.toPandas(), docs.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


CLASH = ("row", "result", "kept", "matches", "ids", "lossless", "key", "th", "fp", "lost", "level", "stratum", "n_words", "entities", "d", "_doc", "_lost", "_kept", "_new", "_tried", "_f", "_key", "_host")


def pipeline_fixture(spark, folder):
    rnd = random.Random(31)
    sentence = lambda n=12: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    items = [(i, sentence(30)) for i in range(6)] + [(6, None), (7, ""), (8, "too short")]
    shared = [sentence() for _ in range(4)]
    texts = []
    for i in range(90):
        lines = [sentence() for _ in range(rnd.randrange(5, 9))] + rnd.sample(shared, rnd.randrange(3))
        if i % 9 == 0:
            passage = items[rnd.randrange(6)][1].split()
            passage[-1] = "other"
            lines.insert(1, " ".join(passage))
        if i % 10 == 3:
            lines = [" ".join(w + "#|" for w in x.split()) for x in lines]
        texts.append("\n".join(lines))
    texts += [texts[5], texts[5].upper(), texts[6] + " tail", None, None, "", "short text", sentence(40_000)]
    rows = [(i, t, rnd.choice(["en", "en", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (7, "another text under a used id " + sentence(60), "en", "s", 0), (None, sentence(70), "en", None, None), (None, texts[8], "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH))
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(90)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_pipeline_against_brute_force(spark, tmp_path):
    from math import comb

    from test_near_and_lines import brute_components, brute_lines, slow_fingerprint
    from test_text_operators import brute_matches, slow_features

    docs, items = pipeline_fixture(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    def step(name):
        nonlocal docs
        before, out = docs.collect(), stages[name](spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in docs.collect())
        return before

    from tessera.llm import quality_risk

    before = step("quality")
    f = [dict(zip(quality_risk.FEATURES, slow_features(r.text), strict=True)) for r in before]
    failed = [x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] for x in f]
    reject = lambda i, j: any(eval(e, {}, f[i]) > cs[j] for e, cs in quality_risk.RULES.values())  # noqa: E731, S307
    want = []
    held = {}
    for i, r in enumerate(before):
        if not failed[i] and r.doc_id is not None and r.doc_id < 90 and r.doc_id % 10 != 3:
            held.setdefault(r.lang, []).append(i)
    for i, r in enumerate(before):
        own, level = held.get(r.lang, []), None
        for j in range(quality_risk.LEVELS):
            n, k = len(own), sum(reject(x, j) for x in own)
            if sum(comb(n, x) * 0.05**x * 0.95 ** (n - x) for x in range(k + 1)) > 0.05 / len(held):
                break
            level = j
        if not failed[i] and (level is None or not reject(i, level)):
            want.append((r.doc_id, r.text))
    assert plain(docs) == sorted(want, key=repr) and len(want) > 80

    before = step("lines")
    want = brute_lines([(r.doc_id, r.text) for r in before])
    assert plain(docs) == sorted(((d, t) for d, _, _, t in want), key=repr) and sum(n for _, _, n, _ in want) > 10
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    before = step("near_duplicates")
    groups = brute_components([slow_fingerprint(r.text) for r in before])
    least = {}
    for g, r in zip(groups, before, strict=True):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    want = [(r.doc_id, r.text) for g, r in zip(groups, before, strict=True) if r.doc_id == least.get(g)]
    gone = {r.doc_id for g, r in zip(groups, before, strict=True) if r.doc_id != least.get(g)}
    assert plain(docs) == sorted([x for x in want if x[0] not in gone], key=repr) and len(want) < len(before)

    before = step("decontamination")
    assert plain(docs) == sorted(((r.doc_id, r.text) for r in before if not brute_matches(r.text, items)), key=repr)
    assert 5 <= len(before) - docs.count() <= 10

    done = stages["segmentation"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in done.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert all(r.lossless and r.n_ids == len(r.ids) for r in done.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs, _ = pipeline_fixture(spark, tmp_path)
    docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_queries_and_sql_agree_on_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.sql(queries.oracle_sql()[name])
    columns = sorted(r.columns)
    mine = queries.queries()[name](spark, sf_dir).select(columns)
    places = [r.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(x[p] for p in places) for x in r.fetchall()))) == sorted(repr(tuple(x)) for x in mine.collect())
