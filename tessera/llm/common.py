"""Helpers shared by the corpus operators: whole rows, bounded batches, components; scratch tables are those of the package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import discard, indexed, materialize, running, scratch_path, scratch_root

__all__ = ["discard", "indexed", "materialize", "running", "scratch_path", "scratch_root"]

#: Characters that the contracts call white space: space and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, size: str = "4m") -> DataFrame:
    """*df*, from now on sent to Python in Arrow batches of *size* at most.

    The default bounds rows only, and whole texts are wide: 10,000 of them would be held
    several times over in the JVM and in Python.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def release_memory() -> None:
    """Hand freed memory back to the system where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released[T](results: Iterator[T]) -> Iterator[T]:
    """*results*, and at their end the memory is handed back: the worker may idle or run other operators next."""
    try:
        yield from results
    finally:
        release_memory()


def packed(df: DataFrame) -> Column:
    """The whole row as one column `row`, so that no name of the caller's clashes with an operator's own."""
    return F.struct(*[df[f"`{c.replace('`', '``')}`"] for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The columns of `row`, those in *added* in place of columns of the same name or else behind them."""
    stay = [added.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return df.select(*stay, *[v.alias(c) for c, v in added.items() if c not in columns])


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


#: A node with more than this part of all edges is dealt to SALTS tasks.
HOT_PART, SALTS = 1000, 64


def _with_hot(both: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """*both* (u, v) joined with *least* (u, m, n): the rows of a node with many of all edges are dealt to many tasks."""
    hot = F.col("n") > n_edges / HOT_PART
    # at most 2 * HOT_PART nodes, as the edges have 2 * n_edges ends
    marked = both.join(F.broadcast(least.filter(hot).select("u", F.lit(True).alias("hot"))), "u", "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    salts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    return salted.join(least.select("u", "m", salts), ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Components of the undirected edges (a, b): one row (node, root) for each node.

    Alternating large-star and small-star rounds until the edges no longer
    change; with *max_rounds*, RuntimeError if they still do then. Minima are
    pre-aggregated before each exchange; in the joins back, the rows of hot nodes are dealt to many tasks.
    """
    e = materialize(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )

    def mark(df):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    before, rounds = mark(e), 0
    while before[0]:
        if max_rounds is not None and rounds == max_rounds:
            raise RuntimeError(f"components not finished after {rounds} rounds")
        rounds += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_hot(both, least, before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_hot(large, least2, before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after_e = materialize(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(after_e)
        discard(e)
        e, changed, before = after_e, after != before, after
        if not changed:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
