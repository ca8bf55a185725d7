"""Queries on tags, lengths, rankings, reviewed cases, windows and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as x
from tessera.operators import aggregates as agg
from tessera.plans import frames as f
from tessera.plans.registry import query
from tessera.scratch import indexed, quantiles

T = f"WITH {f.TAGS}"
N_DOCS = "(SELECT count(*) FROM documents)"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"{T} SELECT dim, tag, chunk_id // 65536 AS block, count(DISTINCT chunk_id) AS n, string_agg(DISTINCT chunk_id::varchar, ',' ORDER BY chunk_id::varchar) AS ids FROM tags GROUP BY ALL")
def inverted_index(spark, d):
    return agg.inverted_index(f.tags(spark, d)).withColumn("ids", F.expr("array_join(sort_array(transform(ids, x -> string(x))), ',')"))


@query(f"{T} SELECT chunk_id, count(DISTINCT dim) AS n_dims, string_agg(DISTINCT dim || '=' || tag, ';' ORDER BY dim || '=' || tag) AS facets FROM tags GROUP BY chunk_id")
def forward_index(spark, d):
    flat = F.expr("array_join(sort_array(flatten(transform(map_entries(facets), e -> transform(e.value, v -> concat(e.key, '=', v))))), ';')")
    return agg.forward_index(f.tags(spark, d)).select("chunk_id", F.size("facets").cast("long").alias("n_dims"), flat.alias("facets"))


COVER = f"""{T}, ds AS (SELECT doc_id chunk_id, lang dataset FROM documents), n AS (SELECT dataset, count(*) docs FROM ds GROUP BY 1),
s AS (SELECT dim, dataset, count(*) k FROM tags JOIN ds USING (chunk_id) GROUP BY ALL), v AS (SELECT dim, count(DISTINCT tag) n_values FROM tags GROUP BY 1),
c AS (SELECT dim, max(k / docs) coverage, any_value(n_values) n_values FROM s JOIN n USING (dataset) JOIN v USING (dim) GROUP BY dim)"""


def _coverage(spark, d):
    return agg.coverage_by_dataset(f.tags(spark, d), f.t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("dataset")))


@query(f"{COVER} SELECT dim, round(coverage, 6) AS coverage, n_values, coverage >= 0.5 AND n_values >= 5 AS kept FROM c")
def index_coverage_filter(spark, d):
    return rounded(_coverage(spark, d).withColumn("kept", (F.col("coverage") >= 0.5) & (F.col("n_values") >= 5)), "coverage")


@query(f"{COVER} SELECT round(x / 20, 2) AS threshold, count(*) FILTER (coverage >= x / 20) AS kept FROM c, range(1, 11) r(x) GROUP BY x")
def threshold_sweep(spark, d):
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: F.round(x / 20, 2))).alias("threshold")
    return _coverage(spark, d).select("coverage", steps).groupBy("threshold").agg(F.count_if(F.col("coverage") >= F.col("threshold")).alias("kept"))


DIAG = f"{T}, k AS (SELECT dim, tag, count(*) n FROM tags GROUP BY ALL), p AS (SELECT dim, n / sum(n) OVER (PARTITION BY dim) p FROM k), h AS (SELECT dim, -sum(p * ln(p)) h, count(*) n_values FROM p GROUP BY 1), c AS (SELECT dim, count(DISTINCT chunk_id) covered FROM tags GROUP BY 1)"


def _diagnostics(spark, d):
    return agg.diagnostics(f.tags(spark, d), f.t(spark, d, "documents").agg(F.count("*")).scalar())


@query(f"{DIAG} SELECT dim, covered, round(covered / {N_DOCS}, 6) AS coverage, round(CASE WHEN n_values > 1 THEN h / ln(n_values) ELSE 0 END, 6) AS entropy, n_values, covered / {N_DOCS} >= 0.2 AND (CASE WHEN n_values > 1 THEN h / ln(n_values) ELSE 0 END) >= 0.3 AS kept FROM h JOIN c USING (dim)")
def dim_diagnostics(spark, d):
    kept = (F.col("coverage") >= 0.2) & (F.col("entropy") >= 0.3)
    return rounded(_diagnostics(spark, d).withColumn("kept", kept), "coverage", "entropy").drop("raw_entropy")


@query(f"{DIAG} SELECT dim, round(n_values / {N_DOCS}, 6) AS value_share, round(h, 6) AS raw_entropy, h >= 1.0 AS kept FROM h JOIN c USING (dim)")
def dim_raw_entropy(spark, d):
    n = f.t(spark, d, "documents").agg(F.count("*")).scalar()
    return _diagnostics(spark, d).select("dim", F.round(F.col("n_values") / n, 6).alias("value_share"), F.round("raw_entropy", 6).alias("raw_entropy"), (F.col("raw_entropy") >= 1.0).alias("kept"))


JAC = f"{T}, v AS (SELECT DISTINCT dim, tag FROM tags), s AS (SELECT dim, count(*) n FROM v GROUP BY 1), j AS (SELECT x.dim a, y.dim b, count(*) k FROM v x JOIN v y ON x.tag = y.tag AND x.dim < y.dim GROUP BY ALL), r AS (SELECT a, b, k / (s1.n + s2.n - k) jaccard FROM j JOIN s s1 ON s1.dim = a JOIN s s2 ON s2.dim = b)"


@query(f"{JAC} SELECT a, b, round(jaccard, 6) AS jaccard FROM r")
def dim_jaccard(spark, d):
    return rounded(agg.jaccard_pairs(f.tags(spark, d)), "jaccard")


@query(f"{JAC} SELECT a, b, round(1 - jaccard, 6) AS difference FROM r WHERE 1 - jaccard < 0.3")
def dim_redundancy(spark, d):
    return agg.jaccard_pairs(f.tags(spark, d)).select("a", "b", F.round(1 - F.col("jaccard"), 6).alias("difference")).filter("difference < 0.3")


@query("""WITH s AS (SELECT n_chars v, row_number() OVER (ORDER BY n_chars) - 1 i, count(*) OVER () n FROM documents WHERE n_chars IS NOT NULL)
SELECT count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 4) AS sd, min(v) AS low, max(v) AS high, min(v) FILTER (i = n // 4) AS p25, min(v) FILTER (i = 3 * n // 4) AS p75 FROM s""")
def length_stats(spark, d):
    docs = f.t(spark, d, "documents")
    q = quantiles(docs, "n_chars", {"p25": 0.25, "p75": 0.75}, interpolate=False)
    middle = quantiles(docs, "n_chars", {"median": 0.5}).select(F.round("median", 6)).scalar()
    plain = docs.agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 4).alias("sd"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    return plain.withColumns({"median": middle, "p25": q.select("p25").scalar(), "p75": q.select("p75").scalar()})


def _hist(name, edges, sql_extra=""):
    labels = [f"<{e}" for e in edges] + [f">={edges[-1]}"]
    sql = "CASE " + " ".join(f"WHEN n_chars < {e} THEN '<{e}'" for e in edges) + f" ELSE '{labels[-1]}' END"

    def run(spark, d):
        docs = f.t(spark, d, "documents").filter("n_chars IS NOT NULL")
        col = F.lit(labels[-1])
        for e in reversed(edges):
            col = F.when(F.col("n_chars") < e, f"<{e}").otherwise(col)
        counts = docs.groupBy(col.alias("bucket")).agg(F.count("*").alias("n"))
        return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))

    query(f"SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {sql} bucket FROM documents WHERE n_chars IS NOT NULL) GROUP BY bucket", name)(run)


_hist("length_hist", (200, 500, 1000, 2000))


@query("""WITH s AS (SELECT n_chars v, row_number() OVER (ORDER BY n_chars) - 1 i, count(*) OVER () n FROM documents WHERE n_chars IS NOT NULL)
SELECT count(*) FILTER (v < 100) AS lt100, count(*) FILTER (v >= 100 AND v < 300) AS lt300, count(*) FILTER (v >= 300 AND v < 500) AS lt500, count(*) FILTER (v >= 500 AND v <= 800) AS upto800, count(*) FILTER (v > 800) AS over800, min(v) FILTER (i = 9 * n // 10) AS p90 FROM s""")
def length_hist2(spark, d):
    docs, v = f.t(spark, d, "documents").filter("n_chars IS NOT NULL"), F.col("n_chars")
    bins = {"lt100": v < 100, "lt300": (v >= 100) & (v < 300), "lt500": (v >= 300) & (v < 500), "upto800": (v >= 500) & (v <= 800), "over800": v > 800}
    return docs.agg(*[F.count_if(c).alias(n) for n, c in bins.items()]).withColumn("p90", quantiles(docs, "n_chars", {"p90": 0.9}, interpolate=False).scalar())


@query("SELECT round(min(l_extendedprice), 4) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(max(l_extendedprice), 4) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem")
def score_quantiles(spark, d):
    v = "l_extendedprice"
    li = f.t(spark, d, "lineitem").select(v)
    places = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    plain = li.agg(*[F.round(c(v), 4).alias(n) for n, c in (("low", F.min), ("high", F.max), ("mean", F.avg), ("sd", F.stddev_pop))])
    q = quantiles(li, v, places)
    return plain.withColumns({n: q.select(F.round(n, 4)).scalar() for n in places})


@query("SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1")
def metric_summary(spark, d):
    e = f.t(spark, d, "events").groupBy(F.col("event_type").alias("metric"))
    return e.agg(F.count("*").alias("n"), *[F.round(c("value"), 6).alias(n) for n, c in (("mean", F.avg), ("sd", F.stddev_pop), ("low", F.min), ("high", F.max))])


@query("""SELECT coalesce(r_name, 'ALL') AS area, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_tax), 2) AS tax, round(sum(l_discount), 2) AS disc
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)""")
def area_rollup(spark, d):
    s, n, r = (f.t(spark, d, x) for x in ("supplier", "nation", "region"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "r_name")
    joined = f.t(spark, d, "lineitem").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = {"qty": "l_quantity", "price": "l_extendedprice", "tax": "l_tax", "disc": "l_discount"}
    out = joined.rollup("r_name").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(a) for a, c in sums.items()])
    return out.withColumn("area", F.coalesce("r_name", F.lit("ALL"))).drop("r_name")


@query(f"{T} SELECT dim, count(DISTINCT chunk_id) AS docs, round(100.0 * count(DISTINCT chunk_id) / {N_DOCS}, 4) AS percent FROM tags GROUP BY dim")
def tag_coverage(spark, d):
    n = f.t(spark, d, "documents").agg(F.count("*")).scalar()
    return f.tags(spark, d).groupBy("dim").agg(F.count_distinct("chunk_id").alias("docs")).withColumn("percent", F.round(100.0 * F.col("docs") / n, 4))


@query(f"{T} SELECT dim, count(DISTINCT tag) AS value_count, rank() OVER (ORDER BY count(DISTINCT tag) DESC) AS place FROM tags GROUP BY dim")
def dims_by_values(spark, d):
    return f.tags(spark, d).groupBy("dim").agg(F.count_distinct("tag").alias("value_count")).withColumn("place", F.rank().over(Window.orderBy(F.desc("value_count"))))


# --- cases of an evaluation run: a case for each order; its parts are what was found, those sent back the evidence

CASES = """c AS (SELECT o_orderkey id, o_orderpriority question_type, o_custkey % 7 <> 0 answerable, o_totalprice > 1000 valid, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_custkey % 11 = 0 THEN 'unknown' ELSE o_orderpriority END answer, o_orderstatus = 'F' AND o_totalprice > 300000 err,
  o_orderpriority || ' ' || (o_custkey % 10) reference, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 20)::VARCHAR END gold_text,
  list(l_partkey) FILTER (l_quantity > 25) top, list(l_partkey) FILTER (l_returnflag = 'R') gold FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
b0 AS (SELECT *, coalesce(len(gold), 0) > 0 has_gold, coalesce(list_has_any(top, gold), false) hit, coalesce(len(top), 0) = 0 no_top,
  coalesce(len(list_filter(top, lambda p: contains(p::VARCHAR, gold_text))) > 0, false) text_hit, len(list_filter(regexp_extract_all(reference, '\\d+'), lambda n: NOT list_contains(regexp_extract_all(answer, '\\d+'), n))) > 0 number_missing,
  regexp_extract_all(lower(answer), '[a-z0-9]+') said, regexp_extract_all(lower(reference), '[a-z0-9]+') want FROM c),
b1 AS (SELECT *, len(list_filter(list_distinct(said), lambda t: list_contains(want, t))) shared FROM b0),
b AS (SELECT *, list_filter([CASE WHEN has_gold AND NOT hit THEN 'retrieval_miss_at_k' END, CASE WHEN NOT has_gold AND gold_text IS NOT NULL AND NOT text_hit THEN 'retrieval_miss_at_k_candidate' END, CASE WHEN err THEN 'system_error' END, CASE WHEN no_top THEN 'empty_retrieval' END, CASE WHEN answerable AND answer = '' THEN 'empty_answer' END,
  CASE WHEN answerable AND number_missing THEN 'reference_number_missing_candidate' END, CASE WHEN answerable AND 2 * shared < 0.2 * (len(said) + len(want)) THEN 'low_reference_overlap_candidate' END, CASE WHEN NOT answerable AND answer <> '' AND NOT answer LIKE '%SPECIFIED%' THEN 'out_of_scope_answer_candidate' END], lambda x: x IS NOT NULL) labels FROM b1)"""


def _cases(spark, d):
    o, li = f.t(spark, d, "orders"), f.t(spark, d, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("top"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("gold"))
    none = F.array().cast("array<bigint>")
    c = o.join(lists, o.o_orderkey == lists.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question_type"), (F.col("o_custkey") % 7 != 0).alias("answerable"), (F.col("o_totalprice") > 1000).alias("valid"),
        F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_custkey") % 11 == 0, "unknown").otherwise(F.col("o_orderpriority")).alias("answer"),
        F.concat("o_orderpriority", F.lit(" "), F.col("o_custkey") % 10).alias("reference"), F.when(F.col("o_custkey") % 3 == 0, (F.col("o_custkey") % 20).cast("string")).alias("gold_text"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)).alias("err"),
        F.coalesce("top", none).alias("top"), F.coalesce("gold", none).alias("gold"),
    )
    c = c.withColumns({"has_gold": F.size("gold") > 0, "hit": F.arrays_overlap("top", "gold"), "no_top": F.size("top") == 0})
    ask, said = F.col("answerable"), F.col("answer") != ""
    text_hit = F.exists("top", lambda p: F.contains(p.cast("string"), F.col("gold_text")))
    missing = F.size(F.array_except(x.numbers(F.col("reference")), x.numbers(F.col("answer")))) > 0
    # words stand once in references and answers, so shared ones are those of both sets
    told, want = x.tokens(F.col("answer")), x.tokens(F.col("reference"))
    low = 2 * F.size(F.array_intersect(told, want)) < 0.2 * (F.size(told) + F.size(want))
    labels = agg.case_labels(
        retrieval_miss_at_k=F.col("has_gold") & ~F.col("hit"), retrieval_miss_at_k_candidate=~F.col("has_gold") & F.col("gold_text").isNotNull() & ~text_hit, system_error=F.col("err"),
        empty_retrieval=F.col("no_top"), empty_answer=ask & ~said, reference_number_missing_candidate=ask & missing, low_reference_overlap_candidate=ask & low,
        out_of_scope_answer_candidate=~ask & said & ~F.contains("answer", F.lit("SPECIFIED")),
    )
    return c.withColumn("labels", labels)


SEVERITY = "CASE WHEN list_has_any(labels, ['system_error', 'empty_retrieval', 'empty_answer']) THEN 'critical' WHEN list_has_any(labels, ['retrieval_miss_at_k', 'reference_number_missing_candidate', 'out_of_scope_answer_candidate']) THEN 'major' WHEN len(labels) > 0 THEN 'minor_review' ELSE 'none' END"


@query(f"WITH {CASES} SELECT id, array_to_string(labels, ',') AS labels, {SEVERITY} AS severity, CASE WHEN has_gold THEN hit END AS hit FROM b")
def badcase_classify(spark, d):
    return _cases(spark, d).select("id", F.array_join("labels", ",").alias("labels"), agg.severity(F.col("labels")).alias("severity"), F.when(F.col("has_gold"), F.col("hit")).alias("hit"))


def rate(a, b):
    return f"round(CASE WHEN {b} > 0 THEN {a} / {b} END, 6)"


@query(f"""WITH {CASES}, s AS (SELECT count(*) total, count(*) FILTER (valid) valid_inputs, count(*) FILTER (valid AND answerable) answerable, count(*) FILTER (valid AND len(labels) > 0) candidates,
count(*) FILTER (valid AND list_contains(labels, 'system_error')) system_errors, count(*) FILTER (valid AND no_top) empty_retrieval, count(*) FILTER (valid AND list_contains(labels, 'empty_answer')) empty_answer,
count(*) FILTER (valid AND answerable AND has_gold) gold, count(*) FILTER (valid AND answerable AND has_gold AND hit) hits, count(*) FILTER (valid AND answerable AND len(labels) > 0) bad_answerable FROM b)
SELECT total, valid_inputs, total - valid_inputs AS invalid_inputs, answerable, total - answerable AS unanswerable, candidates, system_errors, empty_retrieval, empty_answer, gold, hits, gold - hits AS misses,
{rate('candidates', 'total')} AS candidate_rate, {rate('bad_answerable', 'answerable')} AS answerable_rate, {rate('system_errors', 'total')} AS error_rate, {rate('(gold - hits)', 'gold')} AS miss_rate, {rate('empty_retrieval', 'total')} AS empty_rate, {rate('empty_answer', 'answerable')} AS empty_answer_rate FROM s""")
def badcase_summary(spark, d):
    c, has = _cases(spark, d), lambda x: F.array_contains("labels", x)
    v, a, bad = F.col("valid"), F.col("valid") & F.col("answerable"), F.size("labels") > 0
    counts = {
        "total": F.lit(True), "valid_inputs": v, "answerable": a, "candidates": v & bad, "system_errors": v & has("system_error"), "empty_retrieval": v & F.col("no_top"),
        "empty_answer": v & has("empty_answer"), "gold": a & F.col("has_gold"), "hits": a & F.col("has_gold") & F.col("hit"), "bad_answerable": a & bad,
    }
    s = c.agg(*[F.count_if(x).alias(n) for n, x in counts.items()])
    s = s.withColumns({"invalid_inputs": F.expr("total - valid_inputs"), "unanswerable": F.expr("total - answerable"), "misses": F.expr("gold - hits")})
    rates = {"candidate_rate": ("candidates", "total"), "answerable_rate": ("bad_answerable", "answerable"), "error_rate": ("system_errors", "total"), "miss_rate": ("misses", "gold"), "empty_rate": ("empty_retrieval", "total"), "empty_answer_rate": ("empty_answer", "answerable")}
    return s.withColumns({n: F.round(F.try_divide(F.col(x), F.col(y)), 6) for n, (x, y) in rates.items()}).drop("bad_answerable")


@query(f"WITH {CASES} SELECT question_type, count(*) AS total, count(*) FILTER (len(labels) > 0) AS bad, round(count(*) FILTER (len(labels) > 0) / count(*), 6) AS bad_rate FROM b GROUP BY 1")
def badcase_by_type(spark, d):
    g = _cases(spark, d).groupBy("question_type").agg(F.count("*").alias("total"), F.count_if(F.size("labels") > 0).alias("bad"))
    return g.withColumn("bad_rate", F.round(F.col("bad") / F.col("total"), 6))


@query(f"WITH {CASES} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM b) GROUP BY label")
def label_counts(spark, d):
    return _cases(spark, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {CASES} SELECT coalesce(a, 'ALL') AS answer_state, coalesce(r, 'ALL') AS retrieval_state, count(*) AS n FROM (SELECT CASE WHEN answer = '' THEN 'empty' WHEN answerable THEN 'answered' ELSE 'unasked' END a, CASE WHEN NOT has_gold THEN 'unknown' WHEN hit THEN 'hit' ELSE 'miss' END r FROM b) GROUP BY CUBE (a, r)")
def judgement_crosstab(spark, d):
    a = F.when(F.col("answer") == "", "empty").when(F.col("answerable"), "answered").otherwise("unasked")
    r = F.when(~F.col("has_gold"), "unknown").when(F.col("hit"), "hit").otherwise("miss")
    c = _cases(spark, d).select(a.alias("a"), r.alias("r")).cube("a", "r").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("a", F.lit("ALL")).alias("answer_state"), F.coalesce("r", F.lit("ALL")).alias("retrieval_state"), "n")


GROUP = "CASE WHEN reviewed AND bad AND NOT hit THEN 'retrieval_miss' WHEN reviewed AND bad AND answer = '' THEN 'incomplete' WHEN reviewed AND bad AND NOT answerable THEN 'refused' WHEN reviewed AND bad THEN 'wrong' WHEN reviewed AND err THEN 'uncertain' WHEN reviewed THEN 'acceptable' WHEN NOT valid THEN 'invalid' ELSE 'unreviewed' END"


@query(f"WITH {CASES} SELECT group_name, count(*) AS n FROM (SELECT {GROUP} AS group_name FROM (SELECT *, len(labels) > 0 bad, valid AND has_gold reviewed FROM b)) GROUP BY 1")
def review_groups(spark, d):
    bad, seen = F.size("labels") > 0, F.col("valid") & F.col("has_gold")
    g = (
        F.when(seen & bad & ~F.col("hit"), "retrieval_miss").when(seen & bad & (F.col("answer") == ""), "incomplete").when(seen & bad & ~F.col("answerable"), "refused").when(seen & bad, "wrong")
        .when(seen & F.col("err"), "uncertain").when(seen, "acceptable").when(~F.col("valid"), "invalid").otherwise("unreviewed")
    )
    return _cases(spark, d).groupBy(g.alias("group_name")).agg(F.count("*").alias("n"))


# --- methods ranked by query: ship modes stand for methods, parts for queries

RANKS = "rk0 AS (SELECT l_partkey query_id, l_suppkey method, sum(l_quantity) q FROM lineitem GROUP BY ALL), rk AS (SELECT query_id, method, rank() OVER (PARTITION BY query_id ORDER BY q DESC, method) AS rank FROM rk0)"


def _rankings(spark, d):
    sums = f.t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("method")).agg(F.sum("l_quantity").alias("q"))
    return sums.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("q"), "method"))).drop("q")


@query(f"WITH {RANKS}, n AS (SELECT count(DISTINCT method) n FROM rk), s AS (SELECT method, sum(n - rank + 1)::bigint borda, count(*) FILTER (rank = 1) wins, count(*) k, round(avg(rank), 4) avg_rank FROM rk, n GROUP BY method) SELECT method, borda, wins, round(wins / k, 4) AS win_rate, avg_rank, round(borda / k, 2) AS score_per_query, rank() OVER (ORDER BY borda DESC) AS global_rank FROM s")
def borda_ranking(spark, d):
    return agg.borda(_rankings(spark, d))


@query(f"WITH {RANKS}, m AS (SELECT query_id, max(rank) last FROM rk GROUP BY 1) SELECT method, count(*) AS n, count(*) FILTER (rank = 1) AS first, count(*) FILTER (rank = 2) AS second, count(*) FILTER (rank = 3) AS third, count(*) FILTER (rank = last) AS last, round(avg(rank), 6) AS avg_rank FROM rk JOIN m USING (query_id) GROUP BY method")
def rank_aggregate(spark, d):
    r = _rankings(spark, d).withColumn("worst", F.max("rank").over(Window.partitionBy("query_id")))
    counts = [F.count_if(F.col("rank") == k).alias(n) for n, k in (("first", 1), ("second", 2), ("third", 3))]
    return r.groupBy("method").agg(F.count("*").alias("n"), *counts, F.count_if(F.col("rank") == F.col("worst")).alias("last"), F.round(F.avg("rank"), 6).alias("avg_rank"))


@query("SELECT p_brand AS task, count(*) AS num, round(avg(p_retailprice), 6) AS mean_score, round(avg(p_size) FILTER (p_size > 10), 6) AS mean_qa FROM part GROUP BY 1")
def task_overall(spark, d):
    return f.t(spark, d, "part").groupBy(F.col("p_brand").alias("task")).agg(F.count("*").alias("num"), F.round(F.avg("p_retailprice"), 6).alias("mean_score"), F.round(F.avg(F.when(F.col("p_size") > 10, F.col("p_size"))), 6).alias("mean_qa"))


@query("""WITH q AS (SELECT o_orderkey, any_value(o_totalprice) len, max(l_discount) score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CASE WHEN len < 40000 THEN '0-4k' WHEN len < 80000 THEN '4-8k' ELSE '8k+' END AS bucket, count(*) AS n, round(100 * avg(score), 2) AS score FROM q GROUP BY 1""")
def longbench_bucket(spark, d):
    o, li = f.t(spark, d, "orders"), f.t(spark, d, "lineitem")
    best = li.groupBy("l_orderkey").agg(F.max("l_discount").alias("score")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    b = F.when(F.col("o_totalprice") < 40000, "0-4k").when(F.col("o_totalprice") < 80000, "4-8k").otherwise("8k+")
    return best.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(100 * F.avg("score"), 2).alias("score"))


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{a}, round(stddev_pop({c}), 6) AS sd_{a}" for a, c in (("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax"))) + " FROM lineitem")
def judge_averages(spark, d):
    cols = (("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax"))
    return f.t(spark, d, "lineitem").agg(*[x for a, c in cols for x in (F.round(F.avg(c), 6).alias(f"mean_{a}"), F.round(F.stddev_pop(c), 6).alias(f"sd_{a}"))])


@query("""WITH w AS (SELECT unnest(['N', 'R', 'A']) metric, unnest([0.5, 0.3, 0.0]) weight), s AS (SELECT l_suppkey AS case_id, l_returnflag metric, avg(l_quantity) s FROM lineitem GROUP BY ALL)
SELECT case_id, round(coalesce(sum(weight * s) FILTER (weight > 0) / sum(weight) FILTER (weight > 0), avg(s)), 2) AS score FROM s LEFT JOIN w USING (metric) GROUP BY case_id""")
def weighted_score(spark, d):
    scores = f.t(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("score"))
    weights = spark.createDataFrame([("N", 0.5), ("R", 0.3), ("A", 0.0)], "metric string, weight double")
    return agg.weighted_score(scores, weights, "case_id")


@query("""WITH c AS (SELECT l_orderkey AS case_id, l_linenumber AS metric, l_partkey p, l_suppkey u, l_extendedprice e, greatest(0, least(1, l_discount * 15)) w FROM lineitem), t AS (SELECT *, sum(w) OVER (PARTITION BY case_id) t, count(*) OVER (PARTITION BY case_id) n FROM c),
s AS (SELECT *, round(round(CASE WHEN t > 0 THEN w / t ELSE 1.0 / n END, 10), 4) share FROM t)
SELECT case_id, metric, CASE WHEN t > 0 AND row_number() OVER (PARTITION BY case_id ORDER BY metric DESC, p DESC, u DESC, e DESC) = 1 THEN round(share + round(1 - sum(share) OVER (PARTITION BY case_id), 4), 4) ELSE share END AS weight FROM s""")
def weight_normalize(spark, d):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place")
    w = f.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("metric"), place, (F.col("l_discount") * 15).alias("raw"))
    return agg.normalize_weights(w, "case_id", "place", "raw").select("case_id", "metric", "weight")


@query("SELECT p_type AS prompt_type, count(*) AS n, count(*) FILTER (p_size > 25) AS active, round(avg(p_retailprice), 6) AS avg_score FROM part GROUP BY 1")
def prompt_stats(spark, d):
    return f.t(spark, d, "part").groupBy(F.col("p_type").alias("prompt_type")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("active"), F.round(F.avg("p_retailprice"), 6).alias("avg_score"))


@query("SELECT p_type AS prompt_type, p_partkey AS prompt_id, p_retailprice AS score, p_size > 45 AS active FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size > 45 DESC, p_retailprice DESC, p_partkey) = 1")
def best_prompt(spark, d):
    p = f.t(spark, d, "part").withColumn("active", F.col("p_size") > 45)
    w = Window.partitionBy("p_type").orderBy(F.desc("active"), F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("p_type").alias("prompt_type"), F.col("p_partkey").alias("prompt_id"), F.col("p_retailprice").alias("score"), "active")


@query("SELECT regexp_extract(c_name, '^([^#]*)#', 1) AS prefix, count(*) AS n FROM customer GROUP BY 1")
def prefix_counts(spark, d):
    return f.t(spark, d, "customer").groupBy(F.regexp_extract("c_name", "^([^#]*)#", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT lang AS genre, count(*) AS n FROM documents GROUP BY 1")
def genre_counts(spark, d):
    return f.t(spark, d, "documents").groupBy(F.col("lang").alias("genre")).agg(F.count("*").alias("n"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) term FROM documents) WHERE length(term) >= 2 AND term NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'die') GROUP BY 1 ORDER BY n DESC, term LIMIT 8")
def top_terms(spark, d):
    terms = f.t(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("term"))
    kept = terms.filter((F.length("term") >= 2) & ~F.col("term").isin("the", "of", "and", "de", "la", "der", "die"))
    return kept.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(8)


@query("SELECT name, count(*) AS n FROM documents, (SELECT unnest(['license', 'the', 'der', 'password', 'quelle']) AS name) WHERE contains(lower(text), name) GROUP BY name")
def mention_counts(spark, d):
    """Known names by the texts that hold them; the names are a parameter."""
    names = ["license", "the", "der", "password", "quelle"]
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower("text"), n))
    return f.t(spark, d, "documents").select(F.explode(held).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS model, " + ", ".join(f"round(avg(c_acctbal) FILTER (n_regionkey = {k}), 6) AS r{k}" for k in range(5)) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def leaderboard_pivot(spark, d):
    c = f.t(spark, d, "customer").join(f.t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy(F.col("c_mktsegment").alias("model")).pivot("n_regionkey", list(range(5))).agg(F.round(F.avg("c_acctbal"), 6))
    return p.withColumnsRenamed({str(k): f"r{k}" for k in range(5)})


# --- facet predicates: parts by brand, type and size

@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_type IN (SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 2)", "facet_filter_and")
def facet_filter_and(spark, d):
    p = f.t(spark, d, "part")
    types = p.select("p_type").distinct().orderBy("p_type").limit(2)
    return p.filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).join(types, "p_type", "left_semi").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') OR p_size IN (1, 2, 3)")
def facet_filter_or(spark, d):
    p = f.t(spark, d, "part")
    return p.filter(F.col("p_brand").isin("Brand#11", "Brand#12") | F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@query("SELECT doc_id AS chunk_id, lang, length(text)::bigint AS n FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 20")
def constraint_retrieve(spark, d):
    kept = f.t(spark, d, "documents").filter(F.col("lang").isin("en", "fr") & F.col("source").isin("src1", "src2")).orderBy("doc_id").limit(20)
    return kept.select(F.col("doc_id").alias("chunk_id"), "lang", F.length("text").cast("long").alias("n"))


ALL_MATCH = f"{T}, want AS (SELECT unnest(['lang', 'lang', 'size']) dim, unnest(['en', 'de', 'long']) tag)"


@query(f"{ALL_MATCH} SELECT chunk_id FROM tags JOIN want USING (dim, tag) GROUP BY chunk_id HAVING count(DISTINCT dim) = 2")
def facet_all_match(spark, d):
    """Chunks with one of the wanted values in every dim, off the forward index."""
    want = {"lang": ["en", "de"], "size": ["long"]}
    ok = F.lit(True)
    for dim, values in want.items():
        ok = ok & F.coalesce(F.arrays_overlap(F.try_element_at("facets", F.lit(dim)), F.array(*map(F.lit, values))), F.lit(False))
    return agg.forward_index(f.tags(spark, d)).filter(ok).select("chunk_id")


@query(f"{ALL_MATCH} SELECT chunk_id FROM tags JOIN want USING (dim, tag) GROUP BY chunk_id HAVING count(DISTINCT dim) = 2")
def facet_intersection(spark, d):
    """The same by intersecting posting lists."""
    want = spark.createDataFrame([("lang", "en"), ("lang", "de"), ("size", "long")], "dim string, tag string")
    hits = f.tags(spark, d).join(F.broadcast(want), ["dim", "tag"]).groupBy("chunk_id").agg(F.count_distinct("dim").alias("n"))
    return hits.filter("n = 2").select("chunk_id")


@query("SELECT item_id AS query_id, lang AS tag FROM benchmark, (SELECT DISTINCT lang FROM documents) WHERE contains(lower(text), lower(lang))")
def constraint_substring(spark, d):
    """Tags named in a query; the facet's few values are gathered into one array."""
    values = f.t(spark, d, "documents").agg(F.collect_set("lang")).scalar()
    named = F.filter("known", lambda v: F.contains(F.lower("text"), F.lower(v)))
    asked = f.t(spark, d, "benchmark").select("item_id", "text", values.alias("known"))
    return asked.select(F.col("item_id").alias("query_id"), F.explode(named).alias("tag"))


@query("SELECT c_custkey AS query_id, c_mktsegment AS tag, CASE WHEN contains(lower(c_name || ' ' || c_mktsegment), lower(c_mktsegment)) AND length(c_mktsegment) >= 2 THEN round(1 + least(length(c_mktsegment) / length(c_name || ' ' || c_mktsegment), 0.25), 6) ELSE 0 END AS score FROM customer")
def tag_match_score(spark, d):
    q, tag = F.concat("c_name", F.lit(" "), "c_mktsegment"), F.col("c_mktsegment")
    s = F.when(F.contains(F.lower(q), F.lower(tag)) & (F.length(tag) >= 2), F.round(1 + F.least(F.length(tag) / F.length(q), F.lit(0.25)), 6)).otherwise(0.0)
    return f.t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), tag.alias("tag"), s.alias("score"))


@query("SELECT c_custkey AS id, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b) + 1e-8), 6) AS score FROM (SELECT c_custkey, list_distinct(string_split(lower(c_name), '')) a, list_distinct(string_split(lower(c_mktsegment), '')) b FROM customer)")
def char_overlap_score(spark, d):
    chars = lambda c: F.array_distinct(F.split(F.lower(c), ""))
    a, b = chars("c_name"), chars("c_mktsegment")
    return f.t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b) + F.lit(1e-8)), 6).alias("score"))


@query("SELECT doc_id AS chunk_id, tag FROM (SELECT doc_id, text, unnest(['license', 'apache', 'zzzz']) tag FROM documents) WHERE contains(lower(text), tag) OR (len(list_distinct(string_split(tag, ''))) >= 3 AND len(list_filter(list_distinct(string_split(tag, '')), lambda c: contains(lower(text), c))) / len(list_distinct(string_split(tag, ''))) >= 0.75)")
def tag_evidence_filter(spark, d):
    """Tags with evidence in the text: the tag itself, or three quarters of its at least three distinct characters."""
    each = f.t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("t"), F.explode(F.array(*map(F.lit, ("license", "apache", "zzzz")))).alias("tag"))
    chars = F.array_distinct(F.split("tag", ""))
    held = F.size(F.filter(chars, lambda c: F.contains(F.col("t"), c)))
    return each.filter(F.contains("t", F.col("tag")) | ((F.size(chars) >= 3) & (held / F.size(chars) >= 0.75))).select("chunk_id", "tag")


# --- joins, merges, set operations

@query(f"WITH {f.TAGS} SELECT doc_id AS chunk_id, count(tag) AS n_tags FROM documents LEFT JOIN tags ON chunk_id = doc_id GROUP BY 1")
def tags_left_join(spark, d):
    docs = f.t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    return docs.join(f.tags(spark, d), "chunk_id", "left").groupBy("chunk_id").agg(F.count("tag").alias("n_tags"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return f.t(spark, d, "documents").join(f.t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_done(spark, d):
    return f.t(spark, d, "documents").select("doc_id").subtract(f.t(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id, lang, length(text)::bigint AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def retrieve_by_ids(spark, d):
    ids = f.emb(spark, d).filter("grp = 3").select(F.col("id").alias("doc_id"))
    return f.t(spark, d, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def text_range(spark, d):
    return f.t(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").offset(100).limit(50)


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS id, coalesce(o.c_name, n.c_name) AS corpus_id, coalesce(n.c_mktsegment, o.c_mktsegment) AS body FROM (SELECT * FROM customer WHERE c_acctbal > 0) o
FULL JOIN (SELECT c_custkey, c_name || '+' c_name, lower(c_mktsegment) c_mktsegment FROM customer WHERE c_acctbal < 5000) n ON n.c_custkey = o.c_custkey""")
def upsert_merge(spark, d):
    """New rows and new bodies of old ones; an old row keeps its corpus_id."""
    c = f.t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_acctbal")
    old = c.filter("c_acctbal > 0").select("id", F.col("c_name").alias("old_name"), F.col("c_mktsegment").alias("old_body"))
    new = c.filter("c_acctbal < 5000").select("id", F.concat("c_name", F.lit("+")).alias("new_name"), F.lower("c_mktsegment").alias("new_body"))
    return old.join(new, "id", "full").select("id", F.coalesce("old_name", "new_name").alias("corpus_id"), F.coalesce("new_body", "old_body").alias("body"))


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS id, coalesce(n.c_name, o.c_name) AS corpus_id, coalesce(n.c_mktsegment, o.c_mktsegment) AS body FROM (SELECT * FROM customer WHERE c_acctbal > 0) o
FULL JOIN (SELECT c_custkey, c_name || '+' c_name, lower(c_mktsegment) c_mktsegment FROM customer WHERE c_acctbal < 5000) n ON n.c_custkey = o.c_custkey""")
def upsert_overwrite(spark, d):
    """As upsert_merge, but the new corpus_id wins too."""
    c = f.t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment", "c_acctbal")
    old = c.filter("c_acctbal > 0").select("id", F.col("c_name").alias("old_name"), F.col("c_mktsegment").alias("old_body"))
    new = c.filter("c_acctbal < 5000").select("id", F.concat("c_name", F.lit("+")).alias("new_name"), F.lower("c_mktsegment").alias("new_body"))
    return old.join(new, "id", "full").select("id", F.coalesce("new_name", "old_name").alias("corpus_id"), F.coalesce("new_body", "old_body").alias("body"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint AS stable_id FROM documents")
def stable_id(spark, d):
    return f.t(spark, d, "documents").select("doc_id", F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long").alias("stable_id"))


@query(f"{T} SELECT chunk_id, " + ", ".join(f"string_agg(DISTINCT tag, '; ' ORDER BY tag) FILTER (dim = '{x}') AS dim_{x}" for x in ("lang", "source", "size", "quality", "toxic")) + " FROM tags GROUP BY chunk_id")
def tags_pivot_wide(spark, d):
    dims = ["lang", "source", "size", "quality", "toxic"]
    p = f.tags(spark, d).groupBy("chunk_id").pivot("dim", dims).agg(F.array_join(F.sort_array(F.collect_set("tag")), "; "))
    return p.select("chunk_id", *[F.when(F.col(x) != "", F.col(x)).alias(f"dim_{x}") for x in dims])


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NOT NULL AND {c}::varchar <> '') AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars")) + " FROM documents")
def nonempty_counts(spark, d):
    return f.t(spark, d, "documents").agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])


@query("SELECT a.l_suppkey AS id, count(*) AS n, round(avg(a.l_quantity - b.l_quantity), 6) AS mean_diff FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 GROUP BY 1")
def paired_diffs(spark, d):
    li = f.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    b = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_quantity").alias("q"))
    return li.join(b, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("l_quantity") - F.col("q")), 6).alias("mean_diff"))


@query("SELECT 'raw_' || c_custkey AS raw, c_custkey AS id FROM customer")
def suffix_id_recover(spark, d):
    """The longest valid id that a raw id ends with: its suffixes are joined to the ids, of which there may be too many to be sent."""
    valid = f.t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("suffix"), F.col("c_custkey").alias("id"))
    raws = valid.select(F.concat(F.lit("raw_"), "suffix").alias("raw"))
    ends = raws.select("raw", F.explode(F.transform(F.sequence(F.lit(1), F.length("raw")), lambda i: F.substring(F.col("raw"), i, F.length("raw")))).alias("suffix"))
    return ends.join(valid.hint("merge"), "suffix").groupBy("raw").agg(F.max_by("id", F.length("suffix")).alias("id"))


@query("SELECT c_nationkey AS id FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def candidate_union(spark, d):
    a = f.t(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("id"))
    return a.union(f.t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("id"))).distinct()


@query("SELECT c_nationkey AS id FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def tag_intersect(spark, d):
    a = f.t(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("id"))
    return a.intersect(f.t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("id")))


FP = "array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:4], ' ')"


@query(f"WITH x AS (SELECT doc_id, length(text) n, {FP} fp, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) w FROM documents) SELECT doc_id, n::bigint AS n FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY n DESC, doc_id) r FROM x WHERE n >= 50 AND w >= 4) WHERE r = 1 UNION ALL SELECT doc_id, n::bigint FROM x WHERE n < 50 OR w < 4")
def fingerprint_dedup(spark, d):
    """Of chunks with the same first four tokens the longest stays; short ones all stay. A join to each key's winner, so no key meets in one task."""
    words = F.split(F.btrim(F.regexp_replace("text", r"\s+", " ")), " ")
    x = f.t(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.array_join(F.slice(words, 1, 4), " ").alias("fp"), F.size(words).alias("w"))
    short = (F.col("n") < 50) | (F.col("w") < 4)
    best = x.filter(~short).groupBy("fp").agg(F.max(F.struct("n", -F.col("doc_id"))).alias("b"))
    return best.select((-F.col("b.col2")).alias("doc_id"), F.col("b.n").alias("n")).unionByName(x.filter(short).select("doc_id", "n"))


# --- windows over sequences: conversations, events and prices

@query("SELECT conv_id, turn, coalesce(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def context_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return f.t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "").alias("context"))


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return f.t(spark, d, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("conv_id", "turn", "text")


@query("SELECT conv_id, min(turn) AS turn, min_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def first_turn(spark, d):
    return f.t(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text"))


MIN = "v < p AND (v < n AND (p - v >= 5 OR n - v >= 5) OR v = n AND p - v >= 5)"


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity v, lag(l_quantity) OVER w p, lead(l_quantity) OVER w n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) SELECT l_orderkey, l_linenumber, v FROM s WHERE {MIN}")
def find_minima(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    s = f.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), F.lag("l_quantity").over(w).alias("p"), F.lead("l_quantity").over(w).alias("n"))
    return s.filter(MIN).select("l_orderkey", "l_linenumber", "v")


@query("WITH s AS (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) g FROM lineitem) SELECT l_orderkey, g::bigint AS chunk, string_agg(l_linenumber::varchar, ',' ORDER BY l_linenumber) AS members FROM s GROUP BY ALL")
def split_by_flag(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    s = f.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).over(w).alias("chunk"))
    return s.groupBy("l_orderkey", "chunk").agg(F.expr("array_join(transform(sort_array(collect_list(l_linenumber)), x -> string(x)), ',')").alias("members"))


@query("""WITH s AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) best FROM events WHERE value IS NOT NULL), g AS (SELECT *, best - coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY event_id), 0) gain FROM s),
k AS (SELECT *, sum(CASE WHEN gain >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) run FROM g) SELECT user_id, event_id, round(best, 6) AS best, round(gain, 6) AS gain, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS streak FROM k""")
def convergence_trace(spark, d):
    """Best so far, its gain, and how many steps in a row brought less than min_delta."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = f.t(spark, d, "events").filter("value IS NOT NULL").select("user_id", "event_id", F.max("value").over(w).alias("best"))
    g = s.withColumn("gain", F.col("best") - F.coalesce(F.lag("best").over(w), F.lit(0.0)))
    k = g.withColumn("run", F.sum(F.when(F.col("gain") >= 0.5, 1).otherwise(0)).over(w))
    streak = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id")) - F.when(F.col("run") > 0, 1).otherwise(0)
    return k.select("user_id", "event_id", F.round("best", 6).alias("best"), F.round("gain", 6).alias("gain"), streak.cast("long").alias("streak"))


@query("""WITH m AS (SELECT source, median(n_chars) med FROM documents GROUP BY 1), a AS (SELECT source, any_value(med) med, median(abs(n_chars - med)) mad FROM documents JOIN m USING (source) GROUP BY 1)
SELECT doc_id, n_chars FROM documents JOIN a USING (source) WHERE n_chars > med + 3.5 * 1.4826 * mad""")
def mad_filter(spark, d):
    docs = f.t(spark, d, "documents").select("doc_id", "source", "n_chars")
    med = docs.join(quantiles(docs, "n_chars", {"med": 0.5}, ["source"]), "source")
    mad = quantiles(med.withColumn("off", F.abs(F.col("n_chars") - F.col("med"))), "off", {"mad": 0.5}, ["source"])
    return med.join(mad, "source").filter("n_chars > med + 3.5D * 1.4826D * mad").select("doc_id", "n_chars")


@query("WITH a AS (SELECT source, avg(n_chars) m, stddev_pop(n_chars) s FROM documents GROUP BY 1) SELECT doc_id, n_chars FROM documents JOIN a USING (source) WHERE n_chars > m + 3 * s")
def sigma_filter(spark, d):
    docs = f.t(spark, d, "documents").select("doc_id", "source", "n_chars")
    a = docs.groupBy("source").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return docs.join(a, "source").filter("n_chars > m + 3 * s").select("doc_id", "n_chars")


@query("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 i, count(*) OVER (PARTITION BY p_brand) n FROM part), k AS (SELECT p_brand, any_value(n) n FROM r GROUP BY 1), w AS (SELECT DISTINCT p_brand, CASE WHEN n <= 10 THEN j ELSE round_even(j * (n - 1) / 9, 0)::bigint END i FROM k, range(10) u(j) WHERE n > 10 OR j < n) SELECT p_brand, p_partkey FROM r JOIN w USING (p_brand, i)")
def spread_sample(spark, d):
    """Ten rows of each brand at even distances, places rounded half to even."""
    by = indexed(f.t(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand", "p_partkey"], "at")
    bounds = by.groupBy("p_brand").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each brand
    r = by.join(bounds, "p_brand").withColumn("i", F.col("at") - F.col("first"))
    places = F.when(F.col("n") <= 10, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.bround(j * (F.col("n") - 1) / 9, 0).cast("long")))
    return r.filter(F.array_contains(places, F.col("i"))).select("p_brand", "p_partkey")
