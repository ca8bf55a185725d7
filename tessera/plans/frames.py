"""The driver tables as the engine's entities, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import recall, vector

#: Every row whose id is divisible by this is a query of the searches.
EVERY = 20


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("grp"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).filter(F.col("id") % EVERY == 0)


def tags(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, dim, tag) of documents and labels, one row for each."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    wide = docs.select(F.col("doc_id").alias("chunk_id"), "lang", "source", F.when(F.col("n_chars").isNotNull(), size).alias("size"))
    marks = labels.select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    melt = lambda df, *dims: df.unpivot(["chunk_id"], list(dims), "dim", "tag").filter("tag IS NOT NULL")
    return melt(wide, "lang", "source", "size").unionByName(melt(marks, "quality", "toxic"))


def chunk_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags of chunks that have a vector."""
    return tags(spark, d).join(emb(spark, d).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def sem(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return vector.topk(emb(spark, d), queries(spark, d), k)


def similar(spark: SparkSession, d: str) -> DataFrame:
    return recall.tag_similarities(queries(spark, d), recall.tag_vectors(tags(spark, d), emb(spark, d)))


def dim(spark: SparkSession, d: str, k: int = 100, n_tags: int = 20) -> DataFrame:
    return recall.expand(recall.best_tags(similar(spark, d), n_tags).select("query_id", "dim", "tag", "score"), chunk_tags(spark, d), k)


def constraints(spark: SparkSession, d: str) -> DataFrame:
    """What a query asks for: its own language and source."""
    q = queries(spark, d).select(F.col("id").alias("query_id"))
    own = tags(spark, d).filter(F.col("dim").isin("lang", "source"))
    return q.join(own, q.query_id == own.chunk_id).select("query_id", "dim", "tag")


EMB = "emb AS (SELECT vec_id, embedding::DOUBLE[] v, label FROM embeddings)"
Q = f"q AS (SELECT vec_id query_id, v qv, label qlabel FROM emb WHERE vec_id % {EVERY} = 0)"
TAGS = """tags AS (SELECT doc_id chunk_id, 'lang' dim, lang tag FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END FROM documents WHERE n_chars IS NOT NULL
  UNION ALL SELECT doc_id, 'quality', quality::varchar FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'toxic', toxic::varchar FROM labels WHERE toxic IS NOT NULL)"""


def cos(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8), 6)"


PAIRS = f"sims AS (SELECT query_id, vec_id chunk_id, qlabel, label, {cos('qv', 'v')} score FROM q, emb WHERE vec_id <> query_id)"


def rank(table: str, k: int, where: str = "true", columns: str = "query_id, chunk_id, score") -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {table} WHERE {where} QUALIFY rank <= {k}"


def sem_sql(k: int = 20) -> str:
    return f"{EMB}, {Q}, {PAIRS}, sem AS ({rank('sims', k)})"


CENT = """cell AS (SELECT dim, tag, u.i, avg(v[u.i]) x FROM tags JOIN emb ON chunk_id = vec_id, unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL),
cent AS (SELECT dim, tag, list(x ORDER BY i) c FROM cell GROUP BY ALL)"""
SIMILAR = f"simt AS (SELECT query_id, dim, tag, {cos('qv', 'c')} score FROM q, cent)"


def dim_sql(k: int = 100, n_tags: int = 20) -> str:
    """After EMB and Q: dim."""
    return f"""{TAGS}, {CENT}, {SIMILAR},
best AS (SELECT * FROM simt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dim, tag) <= {n_tags}),
hit AS (SELECT query_id, chunk_id, max(score) score FROM best JOIN tags USING (dim, tag) JOIN emb ON vec_id = chunk_id WHERE chunk_id <> query_id GROUP BY ALL),
dim AS ({rank('hit', k)})"""


def both_sql() -> str:
    return f"{sem_sql()}, {dim_sql()}"


ASK = "ask AS (SELECT query_id, dim, tag FROM q JOIN tags ON chunk_id = query_id WHERE dim IN ('lang', 'source'))"
MERGED = """m AS (SELECT coalesce(d.query_id, s.query_id) query_id, coalesce(d.chunk_id, s.chunk_id) chunk_id, d.score ds, s.score ss, d.rank dr, s.rank sr
  FROM dim d FULL JOIN sem s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id)"""
SOURCE = "CASE WHEN dr IS NULL THEN 'sem' WHEN sr IS NULL THEN 'dim' ELSE 'both' END AS source"


def fused(score: str, k: int, base: str | None = None, merged: str = MERGED) -> str:
    return f"WITH {base or both_sql()}, {merged}, f AS (SELECT query_id, chunk_id, round({score}, 6) score, {SOURCE} FROM m) {rank('f', k, columns='query_id, chunk_id, score, source')}"
