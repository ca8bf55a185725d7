"""Recall by facet tags. Tags are long: (chunk_id, dim, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.vector import centroids, ranked, scores
from tessera.scratch import materialize

TAG = ["dim", "tag"]
#: Rows that a task of expand() takes.
EXPANDED = 512


def tag_vectors(tags: DataFrame, vectors: DataFrame) -> DataFrame:
    """(dim, tag, vec): the mean vector of each tag's chunks; *vectors* is (id, vec), joined by a merge: a planner that takes their file for small would have every task hold them all."""
    return centroids(tags.join(vectors.select(F.col("id").alias("chunk_id"), "vec").hint("merge"), "chunk_id"), *TAG)


def tag_similarities(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, dim, tag, score): each query (id, vec) against the tag vectors."""
    return scores(vectors, queries, *TAG)


def best_tags(similar: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *TAG)
    return similar.withColumn("tag_rank", F.row_number().over(order)).filter(F.col("tag_rank") <= n)


def expand(found: DataFrame, tags: DataFrame, k: int, extra: int = 1) -> DataFrame:
    """Chunks of the tags in *found* (query_id, dim, tag, score) by their best tag, the first *k* with rank.

    Of each tag's chunks only the first k + *extra* ids are joined. That loses nothing: a chunk
    behind them has that many before it, which score at least as high and have smaller ids.
    *extra* covers the query itself, which is left out. Nor are tags joined that score less than one of the query's that has so many
    chunks: all of its come first. So a query meets its best tags up to the first full one, not all. As each row becomes k + *extra*, tasks
    are cut by the number of rows, not by bytes.
    """
    place = F.dense_rank().over(Window.partitionBy(*TAG).orderBy("chunk_id"))
    first = materialize(tags.withColumn("n", place).filter(F.col("n") <= k + extra), "first")
    full = first.filter(F.col("n") == k + extra).select(*TAG).distinct()
    floor = found.join(full, TAG).groupBy("query_id").agg(F.max("score").alias("_floor"))
    some = found.join(floor, "query_id", "left").filter(F.col("_floor").isNull() | F.col("score").isNull() | (F.col("score") >= F.col("_floor")))
    wanted = materialize(some.drop("_floor"), "wanted")
    each = wanted.repartition(1 + wanted.count() // EXPANDED, "query_id")
    hits = each.join(first.drop("n"), TAG).filter("chunk_id <> query_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ranked(hits).filter(F.col("rank") <= k)


def constraint_recall(constraints: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """Chunks with any of a query's constraints (query_id, dim, tag), scored 1."""
    return expand(constraints.withColumn("score", F.lit(1.0)), tags, k)


def margins(similar: DataFrame, least: float, margin: float) -> DataFrame:
    """By query and dim the best tag, its lead over the second, and whether both suffice."""
    w = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "tag")
    lead = F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))
    top = similar.withColumns({"n": F.row_number().over(w), "margin": F.round(lead, 6)}).filter("n = 1").drop("n")
    return top.withColumn("accepted", (F.col("score") >= least) & (F.col("margin") >= margin))


def hit_score(sem: DataFrame, best: DataFrame, tags: DataFrame) -> DataFrame:
    """Semantic hits by facet: a matched dim counts 1 with its score, another tag of it 0.5 with 0.3 of its score."""
    held = tags.groupBy("chunk_id", "dim").agg(F.collect_set("tag").alias("own"))
    match = F.exists("own", lambda t: F.contains(F.col("tag"), t) | F.contains(t, F.col("tag")))
    each = sem.select("query_id", "chunk_id").join(best, "query_id").join(held, ["chunk_id", "dim"])
    sums = each.groupBy("query_id", "chunk_id").agg(
        F.sum(F.when(match, 1.0).otherwise(0.5)).alias("hits"), F.sum(F.when(match, F.col("score")).otherwise(0.3 * F.col("score"))).alias("total")
    )
    found = sem.select("query_id", "chunk_id").join(sums, ["query_id", "chunk_id"], "left")
    score = F.when(F.col("hits") > 0, F.col("hits") * F.col("total") / F.greatest("hits", F.lit(1.0))).otherwise(0.0)
    return ranked(found.select("query_id", "chunk_id", F.round(F.coalesce(score, F.lit(0.0)), 8).alias("score")))


def tag_doc_score(similar: DataFrame, tags: DataFrame, candidates: DataFrame, least: float, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Per candidate (query_id, chunk_id) the best matched tag of each dim, summed over dims."""
    matched = similar.filter((F.col("score") >= least) & ~F.col("dim").isin(*excluded))
    per_dim = candidates.select("query_id", "chunk_id").join(tags, "chunk_id").join(matched, ["query_id", "dim", "tag"]).groupBy("query_id", "chunk_id", "dim").agg(F.max("score").alias("s"))
    return per_dim.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score"))
