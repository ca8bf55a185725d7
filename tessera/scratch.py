"""Tables in the folder that driver and executors share, and what such tables make possible: global order, running sums, exact quantiles."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where it is unset, one below the warehouse is taken and set; on a cluster that must not be a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if root.startswith(("file:", "/")) and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Scratch paths of this process that are still there, each with what deletes it.
_LEFT: dict[str, Callable[[], None]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the process ends is deleted then."""
    path = f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext

    def delete() -> None:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    _LEFT[path] = delete
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write *df* to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the
    true size, so that it broadcasts a side only when that side is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads; others are let be."""
    for df in tables:
        if delete := _LEFT.pop(getattr(df, "_tessera_path", ""), None):
            delete()


@atexit.register
def _discard_all() -> None:
    while _LEFT:
        with contextlib.suppress(Exception):  # the session, or its JVM, may be gone: then the folder's owner cleans up
            _LEFT.popitem()[1]()


def indexed(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """*df* in the order of *keys* with a gapless global index from 0.

    Rows are range partitioned and sorted, so a key that many rows share is
    still dealt to many tasks as long as the keys together tell rows apart.
    The row's place is its place in its partition plus the sizes of the
    partitions before it, a table with one row for each partition.
    """
    mid = "_mid"
    ranked = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn(mid, F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright(F.col(mid), 33)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_start"))
    # one row for each partition of the range exchange: its size is bounded by that count
    out = ranked.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", mid)


def running(df: DataFrame, keys: list[str], amount: str, name: str = "before") -> DataFrame:
    """*df* with the sum of *amount* over the rows before each one, in the order of *keys* over the whole table.

    Like indexed(): range partitions, a sum within each, and what the partitions before hold, a row for each.
    """
    part = F.spark_partition_id().alias("_part")
    ranked = materialize(df.repartitionByRange(*[F.col(k) for k in keys]).select("*", part), "running")
    sizes = ranked.groupBy("_part").agg(F.sum(amount).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition of the range exchange: its size is bounded by that count
    out = ranked.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own"))
    return out.drop("_part", "_start", "_own")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), interpolate: bool = True) -> DataFrame:
    """(by, a column for each of *shares*): exact quantiles, by linear interpolation or at place floor(n * share).

    Equal values are counted first, and the counts are summed in the values' global order, so neither a
    key nor a value that most rows hold meets in one task.
    """
    keys = [*by] or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    placed = running(counts, [*keys, "_v"], "_k", "_before")
    bounds = placed.groupBy(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)]).agg(F.min("_before").alias("_base"), F.sum("_k").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    at = placed.join(bounds, same).withColumn("_at", F.col("_before") - F.col("_base"))
    found, cols = [], []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(share) if interpolate else F.floor(F.col("_n") * F.lit(share))
        for end, p in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            found.append(F.max(F.when((F.col("_at") <= p) & (p < F.col("_at") + F.col("_k")), F.col("_v"))).alias(f"{name}_{end}"))
        found.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cols.append((lo + (hi - lo) * F.col(f"{name}_part") if interpolate else lo).alias(name))
    return at.groupBy(*keys).agg(*found).select(*by, *cols)
