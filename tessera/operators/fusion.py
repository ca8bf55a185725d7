"""Fusion of ranked lists (query_id, chunk_id, score, rank): a facet side `dim` and a semantic side `sem`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.vector import ranked

KEY = ["query_id", "chunk_id"]


def merge(dim: DataFrame, sem: DataFrame) -> DataFrame:
    """Both sides in one row for each query and chunk; what a side lacks is null."""
    a = dim.select(*KEY, F.col("score").alias("dim_score"), F.col("rank").alias("dim_rank"))
    b = sem.select(*KEY, F.col("score").alias("sem_score"), F.col("rank").alias("sem_rank"))
    return a.join(b, KEY, "full")


def scored(merged: DataFrame, score: Column, k: int | None, digits: int = 6) -> DataFrame:
    """The first *k* by the rounded *score* (None: all), with rank and the side(s) a chunk comes from."""
    source = F.when(F.col("dim_rank").isNull(), "sem").when(F.col("sem_rank").isNull(), "dim").otherwise("both")
    out = ranked(merged.select(*KEY, F.round(score, digits).alias("score"), source.alias("source")))
    return out if k is None else out.filter(F.col("rank") <= k)


def reciprocal(rank: str, k: int, first: int) -> Column:
    """1 / (k + rank), ranks counting from *first*; 0 for what a side lacks."""
    return F.coalesce(1.0 / (F.lit(k - 1 + first) + F.col(rank)), F.lit(0.0))


def rrf(dim: DataFrame, sem: DataFrame, alpha: float | Column = 0.2, k: int = 60, first: int = 1, top: int | None = 8) -> DataFrame:
    """Weighted reciprocal ranks."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return scored(merge(dim, sem), a * reciprocal("dim_rank", k, first) + (1 - a) * reciprocal("sem_rank", k, first), top)


def min_max(side: DataFrame) -> DataFrame:
    """Scores brought to 0..1 by query; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return side.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def score_fuse(dim: DataFrame, sem: DataFrame, alpha: float = 0.2, top: int | None = 8, count_lists: bool = False) -> DataFrame:
    """Weighted min-max scores; with *count_lists* a chunk of both lists counts twice, as some rank lists are merged."""
    m = merge(min_max(dim), min_max(sem))
    s = alpha * F.coalesce("dim_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("sem_score", F.lit(0.0))
    if count_lists:
        s = s * F.when(F.col("dim_rank").isNotNull() & F.col("sem_rank").isNotNull(), 2).otherwise(1)
    return scored(m, s, top)


def rank_scores(side: DataFrame) -> DataFrame:
    """Scores replaced by 1 - place / (n - 1); 1 for a single row."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return side.withColumn("score", F.when(n <= 1, 1.0).otherwise(1 - (F.col("rank") - 1) / (n - 1)))


def rerank_score(dim: DataFrame, sem: DataFrame, bonus: DataFrame, alpha: float = 0.5, entity: float = 0.12, coverage: float = 0.08, top: int | None = 8) -> DataFrame:
    """Rank scores with bonuses from *bonus* (query_id, chunk_id, entity, coverage)."""
    m = merge(rank_scores(dim), rank_scores(sem)).join(bonus, KEY, "left")
    zero = F.lit(0.0)
    s = alpha * F.coalesce("dim_score", zero) + (1 - alpha) * F.coalesce("sem_score", zero)
    return scored(m, s + entity * F.coalesce("entity", zero) + coverage * F.coalesce("coverage", zero), top)


def interleave(dim: DataFrame, sem: DataFrame, top: int = 8) -> DataFrame:
    """dim, sem, dim, ... each chunk at its first place."""
    m = merge(dim, sem)
    place = F.least(2 * F.col("dim_rank"), 2 * F.col("sem_rank") + 1)
    out = m.select(*KEY, F.row_number().over(Window.partitionBy("query_id").orderBy(place)).alias("rank"))
    return out.filter(F.col("rank") <= top)


def weighted(dim: DataFrame, sem: DataFrame, alpha: float = 0.2, top: int | None = 8) -> DataFrame:
    """Weighted raw scores; what a side lacks is 0."""
    return scored(merge(dim, sem), alpha * F.coalesce("dim_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("sem_score", F.lit(0.0)), top)


def rrf_blend(dim: DataFrame, sem: DataFrame, alpha: float = 0.2, k: int = 60, part: float = 0.1, top: int | None = 8) -> DataFrame:
    """Reciprocal ranks with a part of each score, divided by its list's maximum."""

    def scaled(side: DataFrame) -> DataFrame:
        high = F.max("score").over(Window.partitionBy("query_id"))
        return side.withColumn("score", F.when(high > 0, F.col("score") / high).otherwise(0.0))

    m = merge(scaled(dim), scaled(sem))
    d = part * F.coalesce("dim_score", F.lit(0.0)) + reciprocal("dim_rank", k, 1)
    s = part * F.coalesce("sem_score", F.lit(0.0)) + reciprocal("sem_rank", k, 1)
    return scored(m, alpha * d + (1 - alpha) * s, top)


def additive(vec: DataFrame, tags: DataFrame, alpha: float = 0.2, top: int | None = 20) -> DataFrame:
    """The vector list alone, its scores raised by the tag scores."""
    m = merge(tags, vec).filter(F.col("sem_rank").isNotNull())
    return scored(m, F.col("sem_score") + alpha * F.coalesce("dim_score", F.lit(0.0)), top)


def additive_rrf(vec: DataFrame, tags: DataFrame, alpha: float = 0.2, k: int = 60, top: int | None = 20) -> DataFrame:
    return scored(merge(tags, vec), reciprocal("sem_rank", k, 1) + alpha * reciprocal("dim_rank", k, 1), top)


def adaptive_weights(dim: DataFrame, sem: DataFrame, evidence: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, alpha_dim): weights from confidence, label evidence and concentration of the first *top* rows.

    *evidence* (query_id, n_dims, n_bound, e): dims asked for, those with a value, and the sum of each dim's best score among the hits.
    A list whose scores sum to nothing has concentration 0.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        best = df.filter(F.col("rank") <= top)
        total = F.sum("score").over(Window.partitionBy("query_id"))
        share = F.when(total > 0, F.col("score") / total)
        c = best.withColumn("p", share).groupBy("query_id").agg(
            F.count("*").alias("n"),
            F.coalesce(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p"))), F.lit(0.0)).alias("h"), F.coalesce(F.max("p"), F.lit(0.0)).alias("any"),
        )
        con = F.when(F.col("any") == 0, 0.0).when(F.col("n") <= 1, 1.0).otherwise(1 - F.col("h") / F.log(F.col("n").cast("double")))
        return c.select("query_id", con.alias(f"{name}_c"))

    both = side(dim, "dim").join(side(sem, "sem"), "query_id", "full").join(evidence, "query_id", "left")
    zero = F.lit(0.0)
    n_dims = F.coalesce("n_dims", F.lit(0))
    p, t = structure(n_dims, F.coalesce("n_bound", F.lit(0))), labels(F.coalesce("e", zero), n_dims)
    u_dim, u_sem = p + t + F.coalesce("dim_c", zero), (1 - p) + (1 - t) + F.coalesce("sem_c", zero)
    return both.select("query_id", F.round(u_dim / (u_dim + u_sem + 1e-6), 6).alias("alpha_dim"))


def structure(n_dims: Column, n_bound: Column) -> Column:
    """Confidence in a query's structure: dims asked for, and those of them with a value."""
    return F.when(n_dims > 0, 2.0 * n_bound / (n_dims + n_bound + 1)).otherwise(0.0)


def labels(evidence: Column, n_dims: Column) -> Column:
    """Confidence from the labels hit: the sum of each dim's best score."""
    return F.when(n_dims > 0, 2.0 * evidence / (n_dims + evidence + 1)).otherwise(0.0)


def resolve_alpha(dim: Column, sem: Column, adaptive: Column) -> Column:
    """The dim side's weight: both given are normalised, one gives the other, none is adaptive."""
    total = dim + sem
    return (
        F.when(dim.isNotNull() & sem.isNotNull(), F.when(total > 0, dim / total).otherwise(0.5))
        .when(dim.isNotNull(), dim).when(sem.isNotNull(), 1 - sem).otherwise(adaptive)
    )


def ensemble(lists: list[DataFrame], weights: list[float], k: int = 60, top: int | None = 8) -> DataFrame:
    """Weighted reciprocal ranks of lists (query_id, chunk_id, rank) whose rows are told apart by chunk_id."""
    parts = [x.groupBy(*KEY).agg(F.min("rank").alias("rank")).select(*KEY, (w / (k + F.col("rank"))).alias("s")) for x, w in zip(lists, weights, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = ranked(every.groupBy(*KEY).agg(F.round(F.sum("s"), 6).alias("score")))
    return out if top is None else out.filter(F.col("rank") <= top)


def internal(recall: DataFrame, rerank: DataFrame, k: int = 60, top: int | None = 8) -> DataFrame:
    """The recall's reciprocal rank plus the rerank score divided by its maximum."""
    high = F.max("score").over(Window.partitionBy("query_id"))
    fine = rerank.select(*KEY, F.when(high > 0, F.col("score") / high).otherwise(0.0).alias("fine"))
    joined = recall.join(fine, KEY, "left")
    out = ranked(joined.select(*KEY, F.round(1.0 / (k + F.col("rank")) + F.coalesce("fine", F.lit(0.0)), 8).alias("score")))
    return out if top is None else out.filter(F.col("rank") <= top)
