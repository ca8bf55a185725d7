"""Graphs of a document's pieces, as edge tables (conv_id, i, j, ...). A document has few pieces."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalized(edges: DataFrame, delta: float) -> DataFrame:
    """(conv_id, i, j, weight) of edges (conv_id, i, j, g, own, tokens, nodes).

    exp of the score against the target's *own* by its number of tokens, within 50, plus *delta* for the relative distance; 1 from a node to itself.
    """
    scaled = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (F.col("g") - F.col("own")) / F.greatest(F.lit(1), F.col("tokens"))))
    weight = F.exp(scaled) + delta * F.abs(F.col("i") - F.col("j")) / F.greatest(F.lit(1), F.col("nodes") - 1)
    return edges.select("conv_id", "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(weight).alias("weight"))


def degree_entropy(edges: DataFrame) -> DataFrame:
    """(conv_id, entropy): of the nodes' shares of all edge ends, to base 2."""
    ends = edges.select("conv_id", F.explode(F.array("i", "j")).alias("n")).groupBy("conv_id", "n").agg(F.count("*").alias("k"))
    p = ends.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("conv_id")))
    return p.groupBy("conv_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def mean_paths(weights: dict[int, dict[int, float]], start: int) -> dict[int, int]:
    """The node before each node on its path of least running mean from *start*.

    A step's weight is averaged with all steps before it. That isn't additive, so the order of work matters: nearest first, then by number.
    """
    dist, steps, parent = {start: 0.0}, {start: 0}, {}
    queue = [(0.0, start)]
    while queue:
        now, node = heapq.heappop(queue)
        if now > dist[node]:
            continue
        for to, w in sorted(weights.get(node, {}).items()):
            if to == node or w == 0:
                continue
            mean = (now * steps[node] + w) / (steps[node] + 1)
            if mean < dist.get(to, math.inf):
                dist[to], steps[to], parent[to] = mean, steps[node] + 1, node
                heapq.heappush(queue, (mean, to))
    return parent


def path_entropy(weights: dict[int, dict[int, float]]) -> float:
    """Entropy, to base 2, of the nodes' shares in the ends of all edges that lie on a path."""
    used = set()
    for start in sorted(weights):
        parent = mean_paths(weights, start)
        for node in parent:
            seen = set()
            while node != start and node in parent and node not in seen:
                seen.add(node)
                used.add((parent[node], node))
                node = parent[node]
    degree = Counter(n for edge in used for n in edge)
    total = degree.total()
    return -math.fsum(k / total * math.log2(k / total) for k in degree.values()) + 0.0 if total else 0.0


def path_entropies(edges: DataFrame) -> DataFrame:
    """(conv_id, entropy) of edges (conv_id, i, j, weight); a group is one document's graph."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights: dict[int, dict[int, float]] = {}
        for i, j, w in zip(rows["i"], rows["j"], rows["weight"], strict=True):
            weights.setdefault(int(i), {})[int(j)] = float(w)
        return pd.DataFrame({"conv_id": [rows["conv_id"].iloc[0]], "entropy": [round(path_entropy(weights), 6)]})

    return edges.select("conv_id", "i", "j", "weight").groupBy("conv_id").applyInPandas(run, "conv_id long, entropy double")


_SHARED = "conv_id long, i long, j long, g double, own double, tokens int, nodes long"


def shared_words(turns: DataFrame) -> DataFrame:
    """_SHARED: for each ordered pair of a document's *turns* (conv_id, turn, t: its words) how many distinct words both hold, and the second one's sizes.

    A group is one document; each turn's words come to it once, as one set of bits over the document's own vocabulary. The pairs are what a full graph has.
    """

    def run(group: pa.Table) -> pa.Table:
        words = [set(w or ()) for w in group["t"].to_pylist()]
        place = {w: k for k, w in enumerate(set().union(*words))}
        bits = [sum(1 << place[w] for w in own) for own in words]
        n, turn = len(words), group["turn"].to_numpy()
        both = np.array([[(a & b).bit_count() for b in bits] for a in bits], np.float64).reshape(n, n)
        sizes = group["n"].to_numpy()
        return pa.table({
            "conv_id": pa.array(np.repeat(group["conv_id"].to_numpy()[:1], n * n)), "i": np.repeat(turn, n), "j": np.tile(turn, n), "g": both.ravel(),
            "own": np.tile([float(len(w)) for w in words], n), "tokens": pa.array(np.tile(sizes, n), pa.int32()), "nodes": np.full(n * n, n),
        })

    held = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "t", F.size("t").alias("n"))
    return held.groupBy("conv_id").applyInArrow(run, _SHARED)
