"""Incremental runs: rows seen before are passed over, keyed rows are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(source: DataFrame, key: str, transform, target: str, checkpoint: str):
    """Append *transform*(batch) of the rows whose key *target* doesn't hold yet; runs once over what is there."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if _exists(spark, target):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        transform(fresh).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(source: DataFrame, key: str, target: str, checkpoint: str):
    """Keep the last row of each key in *target*: versions are written by batch and place in it, the newest is what counts."""

    def each(batch: DataFrame, version: int) -> None:
        batch.withColumns({"_version": F.lit(version), "_place": F.monotonically_increasing_id()}).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str, key: str) -> DataFrame:
    rows = spark.read.parquet(target)
    others = [c for c in rows.columns if c not in (key, "_version", "_place")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("_version", "_place")).alias("r"))
    return best.select(key, "r.*")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type and window of a stream with (ts, event_type, value); late rows are waited for, then dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", size))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
