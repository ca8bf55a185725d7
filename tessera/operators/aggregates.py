"""Aggregations over tags, lengths, scores, rankings and reviewed cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.scratch import materialize, running

#: Ids in one block of a posting list.
POSTING_BLOCK = 1 << 16


def inverted_index(tags: DataFrame) -> DataFrame:
    """(dim, tag, block, n, ids): posting lists in blocks of neighbouring ids, so no list outgrows a row."""
    block = F.floor(F.col("chunk_id") / POSTING_BLOCK).cast("long").alias("block")
    return tags.groupBy("dim", "tag", block).agg(F.sort_array(F.collect_set("chunk_id")).alias("ids")).withColumn("n", F.size("ids").cast("long"))


def forward_index(tags: DataFrame) -> DataFrame:
    """(chunk_id, facets): a map from dim to its distinct tags."""
    lists = tags.groupBy("chunk_id", "dim").agg(F.sort_array(F.collect_set("tag")).alias("own"))
    return lists.groupBy("chunk_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dim", "own")))).alias("facets"))


def coverage_by_dataset(tags: DataFrame, dataset: DataFrame) -> DataFrame:
    """(dim, coverage, n_values): the largest share of tag occurrences in a dataset's documents; *dataset* is (chunk_id, dataset).

    Occurrences, not documents, count, so a multi-valued dim can exceed 1.
    """
    docs = dataset.groupBy("dataset").agg(F.count("*").alias("docs"))
    seen = tags.join(dataset, "chunk_id").groupBy("dim", "dataset").agg(F.count("*").alias("n")).join(docs, "dataset")
    values = tags.groupBy("dim").agg(F.count_distinct("tag").alias("n_values"))
    return seen.groupBy("dim").agg(F.max(F.col("n") / F.col("docs")).alias("coverage")).join(values, "dim")


def diagnostics(tags: DataFrame, n_chunks: Column) -> DataFrame:
    """(dim, covered, coverage, entropy, raw_entropy, n_values): entropy is divided by that of equal shares, 0 for one value."""
    counts = tags.groupBy("dim", "tag").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))
    shares = counts.withColumn("p", p).groupBy("dim").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count("*").alias("n_values"))
    covered = tags.groupBy("dim").agg(F.count_distinct("chunk_id").alias("covered"))
    norm = F.when(F.col("n_values") > 1, F.col("h") / F.log(F.col("n_values").cast("double"))).otherwise(0.0)
    return shares.join(covered, "dim").select("dim", "covered", (F.col("covered") / n_chunks).alias("coverage"), norm.alias("entropy"), F.col("h").alias("raw_entropy"), "n_values")


def jaccard_pairs(tags: DataFrame) -> DataFrame:
    """(a, b, jaccard) for pairs of dims a < b that share a value; by joining values, not dims."""
    values = tags.select("dim", "tag").distinct()
    sizes = values.groupBy("dim").agg(F.count("*").alias("n"))
    both = values.select(F.col("dim").alias("a"), "tag").join(values.select(F.col("dim").alias("b"), "tag"), "tag").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    joined = both.join(sizes.withColumnsRenamed({"dim": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"dim": "b", "n": "nb"}), "b")
    return joined.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def borda(rankings: DataFrame) -> DataFrame:
    """Global ranking of (query_id, method, rank): sum of n - rank + 1, wins, average rank, competition rank."""
    n = rankings.agg(F.count_distinct("method")).scalar()
    sums = rankings.groupBy("method").agg(
        F.sum(n - F.col("rank") + 1).alias("borda"), F.count_if(F.col("rank") == 1).alias("wins"), F.count("*").alias("n"), F.round(F.avg("rank"), 4).alias("avg_rank")
    )
    win_rate, per_query = F.round(F.col("wins") / F.col("n"), 4), F.round(F.col("borda") / F.col("n"), 2)
    sums = materialize(sums, "sums")
    # how many methods have more, by the scores' global order: methods may be many
    above = running(sums.groupBy((-F.col("borda")).alias("k")).agg(F.count("*").alias("m")), ["k"], "m", "above").select((-F.col("k")).alias("borda"), "above")
    ranked = sums.join(above, "borda").withColumn("global_rank", F.col("above") + 1)
    return ranked.select("method", "borda", "wins", win_rate.alias("win_rate"), "avg_rank", per_query.alias("score_per_query"), "global_rank")


def normalize_weights(df: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """Weights clamped to 0..1 and brought to the sum 1 at four places; the last takes the residue; equal ones if all are 0."""
    w = Window.partitionBy(group)
    clamped = df.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(weight, F.lit(0.0)))))
    total, n = F.sum("w").over(w), F.count("*").over(w)
    shares = clamped.withColumn("t", total).withColumn("share", F.round(F.round(F.when(total > 0, F.col("w") / total).otherwise(1.0 / n), 10), 4))
    last = F.row_number().over(w.orderBy(F.desc(order))) == 1
    fixed = F.round(F.col("share") + F.round(1 - F.sum("share").over(w), 4), 4)
    return shares.withColumn("weight", F.when(last & (F.col("t") > 0), fixed).otherwise(F.col("share"))).drop("w", "t", "share")


def weighted_score(scores: DataFrame, weights: DataFrame, case: str) -> DataFrame:
    """By case: the metric means by their weights over the weight used; without any, the plain mean. *scores* (case, metric, score), *weights* (metric, weight)."""
    means = scores.groupBy(case, "metric").agg(F.avg("score").alias("s")).join(weights, "metric", "left")
    used = F.sum(F.when(F.col("weight") > 0, F.col("weight")))
    total = F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("s")))
    return means.groupBy(case).agg(F.round(F.coalesce(total / used, F.avg("s")), 2).alias("score"))


def severity(labels: Column) -> Column:
    """The severity of a case's labels."""
    critical = F.array(*map(F.lit, ("system_error", "empty_retrieval", "empty_answer")))
    major = F.array(*map(F.lit, ("retrieval_miss_at_k", "reference_number_missing_candidate", "out_of_scope_answer_candidate")))
    return (
        F.when(F.arrays_overlap(labels, critical), "critical").when(F.arrays_overlap(labels, major), "major").when(F.size(labels) > 0, "minor_review").otherwise("none")
    )


def case_labels(**given: Column) -> Column:
    """The labels whose conditions hold, in this order; names as in :func:`severity`."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in given.items()]), lambda x: x.isNotNull())
