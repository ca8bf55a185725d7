"""Lexical search: BM25 of a bounded set of queries over all documents, the best k kept in each task."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as x
from tessera.operators.vector import ranked
from tessera.scratch import materialize

TOKEN = re.compile("[一-鿿]|[A-Za-z0-9]+")


def _postings(terms: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at, n, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = TOKEN.findall((text.as_py() or "").lower())
                held = Counter(filter(None, map(terms.get, words)))
                sizes.append(len(words))
                at += held.keys()
                n += held.values()
                ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (at, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "len", "at", "n"])

    return run


def _best(k: int, queries: np.ndarray, terms: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float):
    """The best *k* rows of a task for each query; query i asks for the terms of rows (i, t) of *terms*."""
    asked = [[] for _ in range(len(idf))]  # queries by term
    for q, t in terms.tolist():
        asked[t].append(q)
    asked = [np.array(v, np.int64) for v in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        for batch in batches:
            ends = batch.column("at").offsets.to_numpy()
            at, n = (batch.column(c).flatten().to_numpy() for c in ("at", "n"))
            norm = k1 * (1 - b + b * batch.column("len").to_numpy() / mean)
            found = np.zeros((batch.num_rows, len(queries)))
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            weight = idf[at] * n * (k1 + 1) / (n + norm[of])
            for row, t, w in zip(of.tolist(), at.tolist(), weight.tolist(), strict=True):
                found[row, asked[t]] += w
            found = np.round(found, 6)
            found[found == 0] = -np.inf
            score = np.concatenate([score, found.T], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(batch.column("doc_id").to_numpy(), found.T.shape)], axis=1)
            order = np.lexsort((ids, -score))[:, :k]
            score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        q, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(ids[q, j]), pa.array(score[q, j])], ["query_id", "chunk_id", "score"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, block: int = 256) -> DataFrame:
    """(query_id, chunk_id, score, rank): the *k* best of *docs* (doc_id, text) for each of *queries* (query_id, text).

    One pass writes each document's length and its counts of terms that queries ask for. Document frequencies and the mean length are over all
    documents. Queries are sent to the tasks in blocks; a task scores its whole documents and keeps *k* rows a query, so no row for a query and a
    document is shuffled. Scores have six places; equal ones go by id. Rows without id are left out.
    """
    spark = docs.sparkSession
    asked = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(x.tokens(F.col("text")))).alias("t")).distinct()
    rows = asked.toArrow()  # the stated query set: its terms
    words = sorted(set(rows["t"].to_pylist()))
    place = {t: i for i, t in enumerate(words, 1)}
    pairs = np.array([(q, place[t]) for q, t in zip(rows["query_id"].to_pylist(), rows["t"].to_pylist(), strict=True)], np.int64).reshape(-1, 2)
    held = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = materialize(held.mapInArrow(_postings(place), "doc_id long, len long, at array<int>, n array<int>"), "postings")
    sizes = posted.agg(F.count("*").alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("mean")).first()
    idf = np.zeros(len(words) + 1)
    for r in posted.select(F.explode("at").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term of the queries
        idf[r["t"]] = np.log(1 + (sizes["n"] - r["count"] + 0.5) / (r["count"] + 0.5))
    out = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    ids = np.unique(pairs[:, 0])
    for at in range(0, len(ids), block):
        own = ids[at : at + block]
        mine = pairs[np.isin(pairs[:, 0], own)]
        mine[:, 0] = np.searchsorted(own, mine[:, 0])
        best = _best(k, own, mine, idf, sizes["mean"] or 1.0, k1, b)
        out = out.unionByName(posted.mapInArrow(best, "query_id long, chunk_id long, score double"))
    return ranked(out).filter(F.col("rank") <= k)


def counted(tokens: Column) -> Column:
    """An array of (t, n): the distinct tokens of each array, and how often each stands there."""
    kind = pa.struct([("t", pa.string()), ("n", pa.int64())])

    def run(lists: pa.Array) -> pa.Array:
        sizes, parts = [0], []
        for x in lists:
            found = pc.value_counts(x.values) if x.is_valid and len(x.values) else None
            sizes.append(sizes[-1] + (len(found) if found is not None else 0))
            if found is not None:
                parts.append(pa.StructArray.from_arrays([found.field("values"), found.field("counts")], fields=list(kind)))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], kind))

    return F.arrow_udf(run, "array<struct<t: string, n: bigint>>")(tokens)
