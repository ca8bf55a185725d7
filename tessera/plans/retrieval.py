"""Queries on search, recall and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import fusion, recall, vector
from tessera.plans import frames as f
from tessera.plans.registry import query
from tessera.scratch import materialize

HEAD = f"WITH {f.EMB}, {f.Q}, {f.PAIRS}"


@query(f"WITH {f.sem_sql()} SELECT query_id, chunk_id, score, rank FROM sem")
def cosine_topk(spark, d):
    return f.sem(spark, d)


@query(f"WITH {f.EMB}, {f.Q}, s AS (SELECT query_id, vec_id chunk_id, round(list_dot_product(qv, v), 6) score FROM q, emb WHERE vec_id <> query_id) {f.rank('s', 10)}")
def ip_topk(spark, d):
    return vector.topk(f.emb(spark, d), f.queries(spark, d), 10, "ip")


@query(f"WITH {f.EMB}, {f.Q}, s AS (SELECT query_id, vec_id chunk_id, round(-sqrt(greatest(list_dot_product(qv, qv) + list_dot_product(v, v) - 2 * list_dot_product(qv, v), 0)), 6) score FROM q, emb WHERE vec_id <> query_id) {f.rank('s', 10)}")
def euclid_topk(spark, d):
    return vector.topk(f.emb(spark, d), f.queries(spark, d), 10, "euclid")


@query(f"{HEAD}, r AS ({f.rank('sims', 5)}) SELECT query_id, count(*) AS n, round(avg(score), 6) AS mean_score, string_agg(chunk_id::varchar, ',' ORDER BY rank) AS ids FROM r GROUP BY query_id")
def batch_topk(spark, d):
    best = vector.topk(f.emb(spark, d), f.queries(spark, d), 5)
    ids = F.expr("array_join(transform(sort_array(collect_list(struct(rank, chunk_id))), x -> string(x.chunk_id)), ',')")
    return best.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), ids.alias("ids"))


@query(f"{HEAD} {f.rank('sims', 10, 'label = qlabel')}")
def spot_filtered_topk(spark, d):
    return vector.topk(f.emb(spark, d), f.queries(spark, d), 10, same_group=True)


@query(f"{HEAD} {f.rank('sims', 20, 'score >= 0.2')}")
def threshold_topk(spark, d):
    return vector.topk(f.emb(spark, d), f.queries(spark, d), 20, least=0.2)


@query(f"{HEAD}, c AS ({f.rank('sims', 50, columns='query_id, chunk_id, score, label, qlabel')}), g AS (SELECT query_id, chunk_id, round(score + CASE WHEN label = qlabel THEN 0.1 ELSE 0 END, 6) score FROM c) {f.rank('g', 8)}")
def coarse_to_fine(spark, d):
    coarse = vector.topk(f.emb(spark, d), f.queries(spark, d), 50)
    grp = f.emb(spark, d).select("id", "grp")
    both = coarse.join(grp.withColumnsRenamed({"id": "chunk_id", "grp": "a"}), "chunk_id").join(grp.withColumnsRenamed({"id": "query_id", "grp": "b"}), "query_id")
    fine = both.select("query_id", "chunk_id", F.round(F.col("score") + F.when(F.col("a") == F.col("b"), 0.1).otherwise(0.0), 6).alias("score"))
    return vector.ranked(fine).filter("rank <= 8")


@query(f"WITH {f.EMB}, {f.TAGS}, {f.CENT} SELECT dim, tag, i - 1 AS j, round(x, 6) AS x FROM cell")
def tag_centroids(spark, d):
    found = recall.tag_vectors(f.tags(spark, d), f.emb(spark, d))
    return found.select("dim", "tag", F.posexplode("vec").alias("j", "x")).withColumns({"j": F.col("j").cast("long"), "x": F.round("x", 6)})


TAGGED = f"WITH {f.EMB}, {f.Q}, {f.TAGS}, {f.CENT}, {f.SIMILAR}"


@query(f"{TAGGED} SELECT query_id, dim, tag, score FROM simt WHERE score >= 0.1")
def soft_match(spark, d):
    vectors = recall.tag_vectors(f.tags(spark, d), f.emb(spark, d))
    return vector.scores(vectors, f.queries(spark, d), "dim", "tag", least=0.1)


@query(f"{TAGGED} SELECT query_id, dim, tag, score FROM simt QUALIFY row_number() OVER (PARTITION BY query_id, dim ORDER BY score DESC, tag) <= 1")
def top_tag_per_dim(spark, d):
    w = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "tag")
    return f.similar(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 1").drop("n")


MARGIN = "SELECT query_id, dim, tag, score, round(score - coalesce(lead(score) OVER w, 0), 6) margin, row_number() OVER w n FROM simt WINDOW w AS (PARTITION BY query_id, dim ORDER BY score DESC, tag)"


@query(f"{TAGGED}, g AS ({MARGIN}) SELECT query_id, dim, tag, score, margin, score >= 0.1 AND margin >= 0.04 AS accepted FROM g WHERE n = 1")
def tag_margin(spark, d):
    return recall.margins(f.similar(spark, d), 0.1, 0.04)


@query(f"WITH {f.sem_sql()}, {f.dim_sql()} SELECT * FROM dim")
def dim_recall_tag(spark, d):
    return f.dim(spark, d)


@query(f"WITH {f.EMB}, {f.Q}, {f.TAGS}, {f.ASK}, h AS (SELECT DISTINCT query_id, chunk_id, 1.0::double score FROM ask JOIN tags USING (dim, tag) JOIN emb ON vec_id = chunk_id WHERE chunk_id <> query_id) {f.rank('h', 50)}")
def dim_recall_constraint(spark, d):
    return recall.constraint_recall(f.constraints(spark, d), f.chunk_tags(spark, d), 50)


PAYLOAD = f"""{TAGGED}, {f.ASK}, g AS ({MARGIN}), e AS (SELECT query_id, dim, tag, 1.0::double score, true is_exact FROM ask),
o AS (SELECT query_id, dim, tag, score, false FROM g WHERE n = 1 AND score >= 0.05 AND margin >= 0.01),
u AS (SELECT * FROM e UNION ALL SELECT * FROM o WHERE (query_id, dim) NOT IN (SELECT (query_id, dim) FROM e)),
h AS (SELECT query_id, chunk_id, max(score) score FROM u JOIN tags USING (dim, tag) JOIN emb ON vec_id = chunk_id WHERE chunk_id <> query_id GROUP BY ALL)"""


@query(f"{PAYLOAD} {f.rank('h', 50)}")
def dim_recall_payload(spark, d):
    exact = f.constraints(spark, d).withColumn("score", F.lit(1.0))
    close = recall.margins(f.similar(spark, d), 0.05, 0.01).filter("accepted").select("query_id", "dim", "tag", "score")
    close = close.join(exact.select("query_id", "dim"), ["query_id", "dim"], "left_anti")
    return recall.expand(exact.unionByName(close), f.chunk_tags(spark, d), 50)


@query(f"""{TAGGED}, best AS (SELECT * FROM simt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dim, tag) <= 3),
h AS (SELECT dim, tag, max(score) s, count(*) n FROM best GROUP BY ALL)
SELECT chunk_id, round(max(s), 6) AS score, sum(n)::bigint AS n_queries, string_agg(dim || ':' || tag || '=' || n, ',' ORDER BY dim, tag) AS hits FROM h JOIN tags USING (dim, tag) GROUP BY chunk_id""")
def tag_expand(spark, d):
    """Chunks of the tags that queries hit, with the best score. Queries are counted by tag first, so a chunk holds a row for each of its tags, not for each query."""
    best = recall.best_tags(f.similar(spark, d), 3).groupBy("dim", "tag").agg(F.max("score").alias("s"), F.count("*").alias("n"))
    hit = F.sort_array(F.collect_list(F.struct("dim", "tag", "n")))
    joined = best.join(f.tags(spark, d), ["dim", "tag"]).groupBy("chunk_id").agg(F.round(F.max("s"), 6).alias("score"), F.sum("n").alias("n_queries"), hit.alias("h"))
    return joined.select("chunk_id", "score", "n_queries", F.expr("array_join(transform(h, x -> concat(x.dim, ':', x.tag, '=', string(x.n))), ',')").alias("hits"))


@query(f"WITH {f.sem_sql()} SELECT query_id, chunk_id, score, rank, lang, source, length(text)::bigint AS n FROM sem JOIN documents ON doc_id = chunk_id")
def candidate_payload_join(spark, d):
    docs = f.t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source", F.length("text").cast("long").alias("n"))
    return f.sem(spark, d).join(docs, "chunk_id")


@query(f"WITH {f.sem_sql()}, {f.TAGS}, c AS (SELECT DISTINCT chunk_id FROM sem) SELECT chunk_id, count(*) AS n_tags, string_agg(dim || '=' || tag, ';' ORDER BY dim, tag) AS tag_list FROM c JOIN tags USING (chunk_id) GROUP BY chunk_id")
def enrich_results(spark, d):
    wanted = f.sem(spark, d).select("chunk_id").distinct()
    held = f.tags(spark, d).join(wanted, "chunk_id", "left_semi")
    return held.groupBy("chunk_id").agg(F.count("*").alias("n_tags"), F.array_join(F.sort_array(F.collect_list(F.concat("dim", F.lit("="), "tag"))), ";").alias("tag_list"))


@query(f"""{TAGGED.replace(f.Q, f.Q + ", " + f.PAIRS)}, sem AS ({f.rank('sims', 20)}), p AS (SELECT query_id, chunk_id, dim, max(simt.score) s FROM sem JOIN tags USING (chunk_id) JOIN simt USING (query_id, dim, tag) WHERE simt.score >= 0.05 AND dim <> 'toxic' GROUP BY ALL)
SELECT query_id, chunk_id, round(sum(s), 6) AS score FROM p GROUP BY ALL""")
def tag_doc_score(spark, d):
    return recall.tag_doc_score(f.similar(spark, d), f.tags(spark, d), f.sem(spark, d), 0.05, ("toxic",))


@query(f"""WITH {f.sem_sql(50)}, {f.TAGS}, {f.CENT}, {f.SIMILAR}, b AS (SELECT query_id, dim, tag, score FROM simt QUALIFY row_number() OVER (PARTITION BY query_id, dim ORDER BY score DESC, tag) = 1),
o AS (SELECT chunk_id, dim, list(tag) own FROM tags GROUP BY ALL),
e AS (SELECT sem.query_id, sem.chunk_id, b.score, len(list_filter(own, lambda x: contains(tag, x) OR contains(x, tag))) > 0 ok FROM sem JOIN b ON b.query_id = sem.query_id JOIN o ON o.chunk_id = sem.chunk_id AND o.dim = b.dim),
s AS (SELECT query_id, chunk_id, sum(CASE WHEN ok THEN 1 ELSE 0.5 END)::double hits, sum(CASE WHEN ok THEN score ELSE 0.3 * score END) total FROM e GROUP BY ALL),
h AS (SELECT sem.query_id, sem.chunk_id, round(coalesce(CASE WHEN hits > 0 THEN hits * total / greatest(hits, 1) ELSE 0 END, 0), 8) score FROM sem LEFT JOIN s USING (query_id, chunk_id))
{f.rank('h', 50)}""")
def dim_hit_score(spark, d):
    w = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "tag")
    best = f.similar(spark, d).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return recall.hit_score(f.sem(spark, d, 50), best, f.tags(spark, d))


@query(f"""WITH {f.EMB}, {f.Q}, {f.PAIRS}, {f.TAGS}, {f.ASK}, n AS (SELECT query_id, count(DISTINCT dim) n FROM ask GROUP BY 1),
ok AS (SELECT query_id, chunk_id FROM ask JOIN tags USING (dim, tag) JOIN n USING (query_id) GROUP BY query_id, chunk_id HAVING count(DISTINCT dim) = any_value(n.n)),
has AS (SELECT DISTINCT query_id FROM ok WHERE chunk_id <> query_id AND chunk_id IN (SELECT vec_id FROM emb)),
p AS (SELECT sims.* FROM sims SEMI JOIN ok USING (query_id, chunk_id) UNION ALL SELECT * FROM sims WHERE query_id NOT IN (SELECT query_id FROM has)) {f.rank('p', 10)}""")
def hybrid_prefilter(spark, d):
    """Facet filter, then vectors; queries with nothing to filter for, or nothing left, are pure vector searches."""
    ask = f.constraints(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("dim", "tag"))).alias("sign"))
    combos = [r.dims for r in ask.select(F.col("sign.dim").alias("dims")).distinct().collect()]  # of dims: some, whatever the corpus
    asked = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in combos])).alias("dims") if combos else F.lit(None).cast("array<string>").alias("dims")
    held = f.chunk_tags(spark, d).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("dim", "tag"))).alias("own"))
    # a chunk's tags of the dims asked for, whole: only chunks that meet all constraints are joined to a query
    signed = held.select("chunk_id", "own", asked).select("chunk_id", F.expr("filter(own, x -> array_contains(dims, x.dim))").alias("sign"))
    sign = F.xxhash64("sign").alias("grp")
    vecs, q = f.emb(spark, d), f.queries(spark, d)
    # ranked within what a query asks for: the filter comes first, and a task keeps the best of each query
    rows = vecs.drop("grp").join(signed.distinct().select(F.col("chunk_id").alias("id"), sign), "id")
    wanted = q.drop("grp").join(ask.select(F.col("query_id").alias("id"), sign), "id")
    inside = materialize(vector.topk(rows, wanted, 10, same_group=True), "inside")
    rest = vector.topk(vecs, q.join(inside.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti"), 10)
    return inside.unionByName(rest)


@query(f"WITH {f.EMB}, {f.Q}, c0 AS (SELECT label, u.i, avg(v[u.i]) x FROM emb, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) c FROM c0 GROUP BY 1) SELECT query_id, label AS cluster, score FROM (SELECT query_id, label, {f.cos('qv', 'c')} score FROM q, c) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) = 1")
def nearest_cluster(spark, d):
    centres = vector.centroids(f.emb(spark, d).select(F.col("grp").alias("cluster"), "vec"), "cluster")
    found = vector.scores(centres, f.queries(spark, d), "cluster")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cluster")
    return found.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "cluster", "score")


@query(f"WITH {f.sem_sql()} SELECT query_id, round(avg(score), 6) AS mean_sim FROM sem GROUP BY query_id")
def mean_retrieval_sim(spark, d):
    return f.sem(spark, d).groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("mean_sim"))


# --- fusion

R = "coalesce(1.0 / ({k} + {r}), 0)"


def rr(r: str, first: int) -> str:
    return R.format(k=59 + first, r=r)


for _first in (0, 1):
    query(f.fused(f"0.2 * {rr('dr', _first)} + 0.8 * {rr('sr', _first)}", 8), f"rrf_fuse{_first}")(
        lambda spark, d, first=_first: fusion.rrf(f.dim(spark, d), f.sem(spark, d), first=first)
    )

MINMAX = "{0}n AS (SELECT query_id, chunk_id, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END score FROM {0} WINDOW w AS (PARTITION BY query_id))"
NORMED = f"{f.both_sql()}, {MINMAX.format('dim')}, {MINMAX.format('sem')}"
MERGED_N = f.MERGED.replace("FROM dim d", "FROM dimn d").replace("JOIN sem s", "JOIN semn s")
ZERO = "0.2 * coalesce(ds, 0) + 0.8 * coalesce(ss, 0)"


@query(f.fused(ZERO, 8, NORMED, MERGED_N))
def score_fuse(spark, d):
    return fusion.score_fuse(f.dim(spark, d), f.sem(spark, d))


@query(f.fused(f"({ZERO}) * CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 2 ELSE 1 END", 8, NORMED, MERGED_N))
def score_fuse_dup(spark, d):
    return fusion.score_fuse(f.dim(spark, d), f.sem(spark, d), count_lists=True)


@query(f.fused(ZERO, 8))
def weighted_fuse(spark, d):
    return fusion.weighted(f.dim(spark, d), f.sem(spark, d))


RANKED = "{0}n AS (SELECT query_id, chunk_id, rank, CASE WHEN count(*) OVER w <= 1 THEN 1 ELSE 1 - (rank - 1) / (count(*) OVER w - 1) END score FROM {0} WINDOW w AS (PARTITION BY query_id))"
BONUS = "bonus AS (SELECT query_id, chunk_id, count(*) FILTER (dim = 'source') e, count(*) / 2 c FROM ask JOIN tags USING (dim, tag) GROUP BY ALL)"


@query(f.fused("0.5 * coalesce(ds, 0) + 0.5 * coalesce(ss, 0) + 0.12 * coalesce(e, 0) + 0.08 * coalesce(c, 0)", 8, f"{f.both_sql()}, {f.ASK}, {BONUS}, {RANKED.format('dim')}, {RANKED.format('sem')}", MERGED_N.replace("m AS (", "m0 AS (") + ", m AS (SELECT m0.*, e, c FROM m0 LEFT JOIN bonus USING (query_id, chunk_id))"))
def rerank_score(spark, d):
    dim, sem = materialize(f.dim(spark, d), "dim"), materialize(f.sem(spark, d), "sem")
    # only the candidates' tags meet the constraints, not those of all chunks
    pool = dim.select("query_id", "chunk_id").unionByName(sem.select("query_id", "chunk_id")).distinct()
    hits = pool.join(f.tags(spark, d), "chunk_id").join(f.constraints(spark, d), ["query_id", "dim", "tag"]).groupBy("query_id", "chunk_id")
    bonus = hits.agg(F.count_if(F.col("dim") == "source").cast("double").alias("entity"), (F.count("*") / 2).alias("coverage"))
    return fusion.rerank_score(dim, sem, bonus)


@query(f"WITH {f.both_sql()}, {f.MERGED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY least(2 * dr, 2 * sr + 1)) AS rank FROM m QUALIFY rank <= 8")
def interleave(spark, d):
    return fusion.interleave(f.dim(spark, d), f.sem(spark, d))


SCALED = "{0}n AS (SELECT query_id, chunk_id, rank, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END score FROM {0} WINDOW w AS (PARTITION BY query_id))"


@query(f.fused(f"0.2 * (0.1 * coalesce(ds, 0) + {rr('dr', 1)}) + 0.8 * (0.1 * coalesce(ss, 0) + {rr('sr', 1)})", 8, f"{f.both_sql()}, {SCALED.format('dim')}, {SCALED.format('sem')}", MERGED_N))
def rrf_blend(spark, d):
    return fusion.rrf_blend(f.dim(spark, d), f.sem(spark, d))


@query(f.fused("ss + 0.2 * coalesce(ds, 0)", 20, merged=f.MERGED.replace("m AS (", "m0 AS (") + ", m AS (SELECT * FROM m0 WHERE sr IS NOT NULL)"))
def additive_fuse(spark, d):
    return fusion.additive(f.sem(spark, d), f.dim(spark, d))


@query(f.fused(f"{rr('sr', 1)} + 0.2 * {rr('dr', 1)}", 20))
def additive_rrf(spark, d):
    return fusion.additive_rrf(f.sem(spark, d), f.dim(spark, d))


@query(f"WITH {f.both_sql()}, e AS (SELECT query_id, chunk_id, round(sum(s), 6) score FROM (SELECT query_id, chunk_id, 0.5 / (60 + rank) s FROM dim UNION ALL SELECT query_id, chunk_id, 0.5 / (60 + rank) FROM sem) GROUP BY ALL) {f.rank('e', 8)}")
def ensemble_rrf(spark, d):
    return fusion.ensemble([f.dim(spark, d), f.sem(spark, d)], [0.5, 0.5])


PAIR = "c AS (SELECT doc_id, i, substr(text, i, 1) a, substr(text, i + 1, 1) b FROM documents, unnest(range(1, length(text))) u(i)), n2 AS (SELECT a, b, count(*) n FROM c GROUP BY ALL), n1 AS (SELECT a, sum(n) n FROM n2 GROUP BY a), pp AS (SELECT doc_id, round(exp(-sum(ln((n2.n + 1) / (n1.n + 65536))) / count(*)), 4) ppl FROM c JOIN n2 USING (a, b) JOIN n1 ON n1.a = c.a GROUP BY doc_id)"
PPL = PAIR + ", p AS (SELECT query_id, chunk_id, sem.rank, row_number() OVER (PARTITION BY query_id ORDER BY ppl, chunk_id) pr FROM sem JOIN pp ON doc_id = chunk_id)"


@query(f"WITH {f.sem_sql()}, {PPL}, g AS (SELECT query_id, chunk_id, round(1.0 / (60 + rank) + 1.0 / (60 + pr), 6) score FROM p) {f.rank('g', 8)}")
def ppl_rrf(spark, d):
    """Place in the list and place by perplexity, which a hook can give; here by character pairs counted over all documents."""
    from tessera.plans.texts import char_ppl

    ppl = char_ppl(f.t(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    w = Window.partitionBy("query_id").orderBy("ppl", "chunk_id")
    both = f.sem(spark, d).join(ppl, "chunk_id").withColumn("pr", F.row_number().over(w))
    return vector.ranked(both.select("query_id", "chunk_id", F.round(1.0 / (60 + F.col("rank")) + 1.0 / (60 + F.col("pr")), 6).alias("score"))).filter("rank <= 8")


def _evidence(spark, d, dim):
    ask = f.constraints(spark, d)
    hits = dim.join(f.tags(spark, d), "chunk_id").join(ask, ["query_id", "dim", "tag"]).groupBy("query_id", "dim").agg(F.max("score").alias("s"))
    n = ask.groupBy("query_id").agg(F.count_distinct("dim").alias("n_dims")).withColumn("n_bound", F.col("n_dims"))
    return n.join(hits.groupBy("query_id").agg(F.sum("s").alias("e")), "query_id", "left")


CON = """{0}c AS (SELECT query_id, CASE WHEN sum(score) <= 0 THEN 0 WHEN count(*) <= 1 THEN 1 ELSE 1 - h / ln(count(*)) END c FROM (SELECT *, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) OVER (PARTITION BY query_id) h FROM (SELECT *, CASE WHEN sum(score) OVER (PARTITION BY query_id) > 0 THEN score / sum(score) OVER (PARTITION BY query_id) END p FROM {0} WHERE rank <= 5)) GROUP BY query_id, h)"""
EVID = "ev0 AS (SELECT query_id, dim.score s, t.dim dn FROM dim JOIN tags t USING (chunk_id) JOIN ask a USING (query_id) WHERE a.dim = t.dim AND a.tag = t.tag), ev AS (SELECT query_id, sum(s) e FROM (SELECT query_id, dn, max(s) s FROM ev0 GROUP BY ALL) GROUP BY 1), nd AS (SELECT query_id, count(DISTINCT dim) n FROM ask GROUP BY 1)"
ADAPT = f"""{f.both_sql()}, {f.ASK}, {EVID}, {CON.format('dim')}, {CON.format('sem')},
w0 AS (SELECT query_id, coalesce(CASE WHEN n > 0 THEN 2.0 * n / (n + n + 1) END, 0) p, coalesce(CASE WHEN n > 0 THEN 2.0 * coalesce(e, 0) / (n + coalesce(e, 0) + 1) END, 0) t, coalesce(dimc.c, 0) cd, coalesce(semc.c, 0) cs
  FROM dimc FULL JOIN semc USING (query_id) LEFT JOIN nd USING (query_id) LEFT JOIN ev USING (query_id)),
aw AS (SELECT query_id, round((p + t + cd) / ((p + t + cd) + (1 - p) + (1 - t) + cs + 1e-6), 6) alpha_dim FROM w0)"""


@query(f"WITH {ADAPT} SELECT query_id, alpha_dim, round(1 - alpha_dim, 6) AS alpha_sem FROM aw")
def adaptive_weights(spark, d):
    dim, sem = materialize(f.dim(spark, d), "dim"), materialize(f.sem(spark, d), "sem")
    found = fusion.adaptive_weights(dim, sem, _evidence(spark, d, dim))
    return found.withColumn("alpha_sem", F.round(1 - F.col("alpha_dim"), 6))


@query(f"WITH {ADAPT}, {f.MERGED.replace('m AS (', 'm0 AS (')}, m AS (SELECT m0.*, alpha_dim a FROM m0 JOIN aw USING (query_id)), g AS (SELECT query_id, chunk_id, round(a * {rr('dr', 1)} + (1 - a) * {rr('sr', 1)}, 6) score, {f.SOURCE} FROM m) {f.rank('g', 8, columns='query_id, chunk_id, score, source')}")
def adaptive_fuse(spark, d):
    dim, sem = materialize(f.dim(spark, d), "dim"), materialize(f.sem(spark, d), "sem")
    weights = fusion.adaptive_weights(dim, sem, _evidence(spark, d, dim))
    m = fusion.merge(dim, sem).join(weights, "query_id")
    a = F.col("alpha_dim")
    return fusion.scored(m, a * fusion.reciprocal("dim_rank", 60, 1) + (1 - a) * fusion.reciprocal("sem_rank", 60, 1), 8)


@query(f"{CON.format('x').replace('xc AS', 'WITH ' + f.sem_sql() + ', xc AS').replace('FROM x ', 'FROM sem ')} SELECT query_id, round(c, 6) AS concentration FROM xc")
def concentration(spark, d):
    best = f.sem(spark, d).filter("rank <= 5")
    total = F.sum("score").over(Window.partitionBy("query_id"))
    share = best.withColumn("p", F.when(total > 0, F.col("score") / total))
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    n = F.count("*").cast("double")
    return share.groupBy("query_id").agg(F.round(F.when(F.sum("score") <= 0, 0.0).when(n <= 1, 1.0).otherwise(1 - h / F.log(n)), 6).alias("concentration"))


@query("SELECT o_orderkey AS query_id, round(CASE WHEN o_orderstatus = 'F' THEN 0.3 / (0.3 + 0.6) WHEN o_orderstatus = 'O' THEN 0.7 WHEN o_totalprice > 100000 THEN 1 - 0.4 ELSE 0.5 END, 6) AS alpha FROM orders")
def resolve_alpha(spark, d):
    """Which weights a request gives: both, the dim side's, the semantic side's, or none."""
    o = f.t(spark, d, "orders")
    status, dear = F.col("o_orderstatus"), F.col("o_totalprice") > 100000
    dim = F.when(status == "F", 0.3).when(status == "O", 0.7)
    sem = F.when(status == "F", 0.6).when((status != "O") & dear, 0.4)
    return o.select(F.col("o_orderkey").alias("query_id"), F.round(fusion.resolve_alpha(dim, sem, F.lit(0.5)), 6).alias("alpha"))


BEST = "best AS (SELECT * FROM simt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dim, tag) <= 20)"


def _rerank(spark, d):
    """The first 50 of the dim recall with their hit tags, exact ones scored 1."""
    best = materialize(recall.best_tags(f.similar(spark, d), 20).select("query_id", "dim", "tag", "score"), "best")
    exact = f.constraints(spark, d).withColumn("exact", F.lit(1.0))
    tag_score = best.join(exact, ["query_id", "dim", "tag"], "left").select("query_id", "dim", "tag", F.coalesce("exact", "score").alias("s"))
    pool = recall.expand(best, f.chunk_tags(spark, d), 100).filter("rank <= 50").select("query_id", "chunk_id", "rank")
    return pool, pool.join(f.tags(spark, d), "chunk_id").join(tag_score, ["query_id", "dim", "tag"])


HITS = f"{f.ASK}, ts AS (SELECT query_id, dim, tag, CASE WHEN EXISTS (SELECT 1 FROM ask WHERE ask.query_id = best.query_id AND ask.dim = best.dim AND ask.tag = best.tag) THEN 1 ELSE score END s FROM best), hits AS (SELECT query_id, chunk_id, dim.rank, t.dim dn, t.tag, s FROM dim JOIN tags t USING (chunk_id) JOIN ts USING (query_id) WHERE dim.rank <= 50 AND ts.dim = t.dim AND ts.tag = t.tag)"


@query(f"WITH {f.both_sql()}, {HITS}, g AS (SELECT query_id, chunk_id, round(avg(s), 8) score FROM hits GROUP BY ALL) {f.rank('g', 50)}")
def rerank_tag_sim(spark, d):
    _, hits = _rerank(spark, d)
    return vector.ranked(hits.groupBy("query_id", "chunk_id").agg(F.round(F.avg("s"), 8).alias("score")))


@query(f"WITH {f.both_sql()}, {HITS}, g AS (SELECT query_id, chunk_id, round(sum(s), 6) score FROM (SELECT query_id, chunk_id, dn, max(s) s FROM hits GROUP BY ALL) GROUP BY ALL) {f.rank('g', 50)}")
def rerank_tag_match(spark, d):
    _, hits = _rerank(spark, d)
    per_dim = hits.groupBy("query_id", "chunk_id", "dim").agg(F.max("s").alias("s"))
    return vector.ranked(per_dim.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score")))


@query(f"""WITH {f.both_sql()}, {HITS}, g AS (SELECT query_id, chunk_id, avg(s) score FROM hits GROUP BY ALL), x AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END fine FROM g WINDOW w AS (PARTITION BY query_id)),
i AS (SELECT query_id, chunk_id, round(1.0 / (60 + rank) + coalesce(fine, 0), 8) score FROM dim LEFT JOIN x USING (query_id, chunk_id) WHERE rank <= 50) {f.rank('i', 8)}""")
def internal_rrf(spark, d):
    pool, hits = _rerank(spark, d)
    return fusion.internal(pool, hits.groupBy("query_id", "chunk_id").agg(F.avg("s").alias("score")))


@query(f"WITH {f.both_sql()}, {HITS} SELECT query_id, chunk_id, string_agg(e, ',' ORDER BY e) AS evidence FROM (SELECT query_id, chunk_id, dn || ':' || tag e FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY dn, tag) <= 3) GROUP BY ALL")
def evidence_list(spark, d):
    _, hits = _rerank(spark, d)
    first = F.slice(F.sort_array(F.collect_list(F.struct("dim", "tag"))), 1, 3)
    return hits.groupBy("query_id", "chunk_id").agg(first.alias("h")).select("query_id", "chunk_id", F.expr("array_join(transform(h, x -> concat(x.dim, ':', x.tag)), ',')").alias("evidence"))


@query(f"""WITH {f.EMB}, {f.Q}, {f.TAGS}, {f.ASK}, n AS (SELECT query_id, count(*) n FROM ask GROUP BY 1), k AS (SELECT chunk_id, string_agg(dim || '=' || tag, ';' ORDER BY dim, tag) facets FROM tags WHERE dim IN ('lang', 'source') GROUP BY 1),
c AS (SELECT facets, count(*) chunks, min(chunk_id) one FROM k GROUP BY 1)
SELECT query_id, facets, any_value(chunks) AS n_chunks, round(count(*) / any_value(n), 6) AS coverage FROM c JOIN tags ON chunk_id = one JOIN ask USING (dim, tag) JOIN n USING (query_id) GROUP BY query_id, facets""")
def dim_coverage(spark, d):
    """Which part of a query's constraints chunks meet: by the combinations of facets that chunks have, each with its number of chunks, not by pairs of query and chunk."""
    ask = f.constraints(spark, d)
    n = ask.groupBy("query_id").agg(F.count("*").alias("n"))
    own = f.tags(spark, d).filter(F.col("dim").isin("lang", "source")).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("dim", "tag"))).alias("own"))
    kinds = materialize(own.groupBy("own").agg(F.count("*").alias("n_chunks")), "kinds")
    named = kinds.select("n_chunks", F.expr("array_join(transform(own, x -> concat(x.dim, '=', x.tag)), ';')").alias("facets"), F.inline("own"))
    hits = named.join(ask, ["dim", "tag"]).groupBy("query_id", "facets").agg(F.first("n_chunks").alias("n_chunks"), F.count("*").alias("k"))
    return hits.join(n, "query_id").select("query_id", "facets", "n_chunks", F.round(F.col("k") / F.col("n"), 6).alias("coverage"))


# --- retrieval metrics; relevant is what has the query's label


def _relevant(spark, d):
    e = f.emb(spark, d).select("id", "grp")
    found = f.sem(spark, d).join(e.withColumnsRenamed({"id": "chunk_id", "grp": "a"}), "chunk_id").join(e.withColumnsRenamed({"id": "query_id", "grp": "b"}), "query_id")
    sizes = e.groupBy("grp").agg((F.count("*") - 1).alias("n_relevant"))
    return found.withColumn("ok", F.col("a") == F.col("b")).join(sizes, F.col("b") == sizes["grp"]).drop("grp")


REL = f"WITH {f.sem_sql()}, z AS (SELECT label, count(*) - 1 nr FROM emb GROUP BY 1), r AS (SELECT sem.query_id, sem.chunk_id, rank, c.label = q.qlabel ok, nr FROM sem JOIN emb c ON c.vec_id = sem.chunk_id JOIN q USING (query_id) JOIN z ON z.label = q.qlabel)"


@query(f"{REL} SELECT query_id, k, round(CASE WHEN any_value(nr) > 0 THEN count(*) FILTER (ok AND rank <= k) / any_value(nr) ELSE 0 END, 6) AS recall FROM r, (VALUES (5), (10), (20)) v(k) GROUP BY query_id, k")
def recall_at_k(spark, d):
    r = _relevant(spark, d).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (5, 10, 20)])))
    hit = F.count_if(F.col("ok") & (F.col("rank") <= F.col("k")))
    return r.groupBy("query_id", "k").agg(hit.alias("h"), F.first("n_relevant").alias("n")).select("query_id", "k", F.round(F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0), 6).alias("recall"))


@query(f"""{REL}, p AS (SELECT *, sum(ok::int) OVER (PARTITION BY query_id ORDER BY rank) seen FROM r WHERE rank <= 10),
g AS (SELECT query_id, max(CASE WHEN ok AND rank <= 2 THEN 1 ELSE 0 END) h2, max(CASE WHEN ok AND rank <= 4 THEN 1 ELSE 0 END) h4, max(CASE WHEN ok AND rank <= 6 THEN 1 ELSE 0 END) h6, max(CASE WHEN ok AND rank <= 8 THEN 1 ELSE 0 END) h8, max(CASE WHEN ok THEN 1 ELSE 0 END) h10,
coalesce(sum(1.0 / rank) FILTER (ok), 0) / least(any_value(nr), 10) ap_new, coalesce(sum(seen / rank) FILTER (ok), 0) / least(any_value(nr), 10) ap, coalesce(max(1.0 / rank) FILTER (ok), 0) rr FROM p GROUP BY query_id)
SELECT round(avg(h2), 6) AS hits2, round(avg(h4), 6) AS hits4, round(avg(h6), 6) AS hits6, round(avg(h8), 6) AS hits8, round(avg(h10), 6) AS hits10, round(avg(ap_new), 6) AS map10_new, round(avg(ap), 6) AS map10, round(avg(rr), 6) AS mrr10 FROM g""")
def hits_map_mrr(spark, d):
    """map10_new adds newly found items / rank, as published numbers do; map10 is the usual average precision."""
    seen = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    p = _relevant(spark, d).filter("rank <= 10").withColumn("seen", seen)
    least = F.least(F.first("n_relevant"), F.lit(10))
    ok = lambda x: F.coalesce(F.sum(F.when(F.col("ok"), x)), F.lit(0.0))
    hits = [F.max(F.when(F.col("ok") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hits{k}") for k in (2, 4, 6, 8, 10)]
    g = p.groupBy("query_id").agg(*hits, (ok(1.0 / F.col("rank")) / least).alias("map10_new"), (ok(F.col("seen") / F.col("rank")) / least).alias("map10"), F.coalesce(F.max(F.when(F.col("ok"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr10"))
    return g.agg(*[F.round(F.avg(c), 6).alias(c) for c in g.columns if c != "query_id"])


@query(f"{REL} SELECT query_id, bool_or(ok AND rank <= 5) AS hit, min(rank) FILTER (ok) AS first_rank FROM r GROUP BY query_id")
def hit_at_k(spark, d):
    return _relevant(spark, d).groupBy("query_id").agg(F.bool_or(F.col("ok") & (F.col("rank") <= 5)).alias("hit"), F.min(F.when(F.col("ok"), F.col("rank"))).cast("long").alias("first_rank"))


@query(f"WITH {f.sem_sql(10)} SELECT query_id, chunk_id, round(1 - score, 6) AS distance, round(1 - round(1 - score, 6), 6) AS similarity FROM sem")
def distance_similarity(spark, d):
    """What a store answers with, distances, back to similarities."""
    found = f.sem(spark, d, 10).select("query_id", "chunk_id", F.round(1 - F.col("score"), 6).alias("distance"))
    return found.withColumn("similarity", F.round(1 - F.col("distance"), 6))


@query(f"WITH {f.sem_sql(50)} SELECT query_id, chunk_id, score, rank, 'dim' AS source FROM sem")
def dim_recall_vec(spark, d):
    """Recall by vectors that stands in for that by dimensions, told apart by its source."""
    return f.sem(spark, d, 50).withColumn("source", F.lit("dim"))
