"""Exact vector search and centroids."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT

METRICS = ("cosine", "ip", "euclid")
#: Blocks of queries that meet a block of rows in one task.
DEALT = 32
#: Products of two norms from which the cosine's 1e-8 changes no score by more than 1e-6; the share of pairs up to which pairs are looked at one by one.
NORMS, FEW = 1e-2, 1 / 16


def similarities(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One row for each query; larger is nearer."""
    if metric == "euclid":
        square = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :] - 2 * queries @ rows.T
        return -np.sqrt(np.maximum(square, 0))
    scores = queries @ rows.T
    if metric == "cosine":
        scores /= np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :] + 1e-8
    return scores


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Units:
    """Vectors of length one in single precision: their products are cosines but for *margin*, at half the work."""

    def __init__(self, vectors: np.ndarray):
        norms = np.linalg.norm(vectors, axis=1)
        self.least = norms.min(initial=np.inf) if np.isfinite(norms).all() else 0.0
        self.units = (vectors / norms[:, None]).astype(np.float32) if self.least > 0 else None
        # an entry is off by one part in 2**24, a product by three, and their sum by as many more as there are entries
        self.margin = (2 * vectors.shape[1] + 8) * 2.0**-24

    def near(self, rows: Units, least: np.ndarray, digits: int) -> np.ndarray | None:
        """The pairs whose rounded cosine may be *least* or more, one number for each vector; None if that can't be said."""
        if self.units is None or rows.units is None or not self.least * rows.least >= NORMS:
            return None
        bound = np.nextafter((least - self.margin - 2e-6 - 10.0**-digits).astype(np.float32), np.float32(-np.inf))
        return self.units @ rows.units.T >= bound[:, None]


def _partial(k: int, metric: str, digits: int, exclude_self: bool, same_group: bool, least: float | None):
    """The best *k* of some rows for each of a block of queries: (id, vec, grp) tables to (query_id, chunk_id, score)."""

    def _pairs(maybe: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query by number, id, score) of the pairs that may come in, in full precision."""
        q, j = np.nonzero(maybe)
        if exclude_self:
            q, j = q[ids[q] != own[j]], j[ids[q] != own[j]]
        scores = np.empty(len(q))
        for at in range(0, len(q), 8192):
            a, b = vectors[q[at : at + 8192]], rows[j[at : at + 8192]]
            scores[at : at + 8192] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-8)
        scores = np.round(scores, digits)
        fits = np.isfinite(scores) if least is None else scores >= least
        return q[fits], own[j[fits]], scores[fits]

    def _merge(best_score: np.ndarray, best_id: np.ndarray, q: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        new = np.unique(q)
        q = np.concatenate([np.repeat(new, k), q])
        scores, found = np.concatenate([best_score[new].ravel(), scores]), np.concatenate([best_id[new].ravel(), found])
        order = np.lexsort((found, -scores, q))
        order = order[(np.searchsorted(q[order], new)[:, None] + np.arange(k)).ravel()]  # each query has k at least
        best_score[new], best_id[new] = scores[order].reshape(-1, k), found[order].reshape(-1, k)

    def best(queries: pa.Table, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None or not queries.num_rows:
            return None
        ids, groups = (queries.column(c).to_numpy() for c in ("id", "grp"))
        width = len(first.column("vec")[0])
        vectors = _matrix(queries.column("vec").combine_chunks(), width)
        best_score = np.full((len(ids), k), -np.inf)
        best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        units = Units(vectors) if metric == "cosine" and not same_group else None
        for batch in itertools.chain([first], batches):
            own, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "grp"))
            rows = _matrix(batch.column("vec"), width)
            for at in range(0, len(own), 512):
                part = slice(at, at + 512)
                maybe = units.near(Units(rows[part]), best_score[:, -1], digits) if units else None
                if maybe is not None and np.count_nonzero(maybe) <= FEW * maybe.size:
                    _merge(best_score, best_id, *_pairs(maybe, vectors, ids, rows[part], own[part]))
                    continue
                scores = np.round(similarities(metric, vectors, rows[part]), digits)
                if exclude_self:
                    scores[ids[:, None] == own[part][None, :]] = -np.inf
                if same_group:
                    scores[groups[:, None] != label[part][None, :]] = -np.inf
                if least is not None:
                    scores[scores < least] = -np.inf
                # only queries with a row that may come in are ranked anew
                maybe = (scores >= best_score[:, -1:]) & np.isfinite(scores)
                if np.count_nonzero(maybe) <= FEW * maybe.size:
                    q, j = np.nonzero(maybe)
                    _merge(best_score, best_id, q, own[part][j], scores[q, j])
                    continue
                new = np.flatnonzero(maybe.any(axis=1))
                scores = np.concatenate([best_score[new], scores[new]], axis=1)
                every = np.concatenate([best_id[new], np.broadcast_to(own[part], (len(new), len(own[part])))], axis=1)
                order = np.lexsort((every, -scores))[:, :k]
                best_score[new], best_id[new] = np.take_along_axis(scores, order, 1), np.take_along_axis(every, order, 1)
        q, j = np.nonzero(np.isfinite(best_score))
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_id[q, j]), pa.array(best_score[q, j])], ["query_id", "chunk_id", "score"])

    return best


def _every(keys: list[str], digits: int, least: float | None):
    """Every row of a block with each of a block of queries: (id, vec) and (keys, vec) tables to (query_id, keys, score)."""

    def score(queries: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows or not queries.num_rows:
                continue
            width = len(whole.column("vec")[0])
            ids, vectors = queries.column("id").to_numpy(), _matrix(queries.column("vec").combine_chunks(), width)
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = np.round(similarities("cosine", vectors, _matrix(batch.column("vec"), width)), digits)
                q, j = np.nonzero(found >= (-np.inf if least is None else least))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), *[batch.column(c).take(pa.array(j)) for c in keys], pa.array(found[q, j])], ["query_id", *keys, "score"])

    return score


def _blocks(rows: DataFrame, n_rows: int, queries: DataFrame, n_queries: int, block: int, row_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (_q, _r): each block of queries meets each block of rows. Blocks are dealt by hash, about *block* and *row_block* rows each."""
    nq, nr = max(1, -(-n_queries // block)), max(1, -(-n_rows // row_block))
    name = rows.columns[0]
    left = queries.withColumns({"_q": F.pmod(F.xxhash64("id"), F.lit(nq)), "_r": F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<bigint>"))})
    right = rows.withColumns({"_r": F.pmod(F.xxhash64(name, F.xxhash64("vec")), F.lit(nr)), "_q": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>"))})
    return left, right


def topk(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = 6, exclude_self: bool = True,
    same_group: bool = False, least: float | None = None, block: int = DEFAULT.query_block, row_block: int = DEFAULT.row_block,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the *k* nearest rows of *corpus* for each row of *queries*.

    Both have (id, vec, grp). Up to *block* queries are sent to all tasks, each of which keeps
    the best k of its rows. More are dealt in DEALT blocks together, as are the rows, and each pair of those is a task's;
    neither side goes to the driver. The final exchange holds k rows for each query and task.
    Scores are rounded to *digits*; equal ones go by id. With *same_group* a filter on grp
    comes before the ranking, so it costs no recall.
    """
    if metric not in METRICS:
        raise ValueError(f"metric: {metric}")
    spark = corpus.sparkSession
    wanted = queries.filter("vec IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.coalesce("grp", F.lit(-1)).cast("long").alias("grp"))
    rows = corpus.filter("vec IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.coalesce("grp", F.lit(-2)).cast("long").alias("grp"))
    best = _partial(k, metric, digits, exclude_self, same_group, least)
    kinds = "query_id long, chunk_id long, score double"
    n = wanted.count()
    if n <= block:
        data = spark.sparkContext.broadcast(wanted.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = best(data.value, batches)
            if found is not None:
                yield found

        found = rows.mapInArrow(run, kinds)
    else:

        def pair(own: pa.Table, others: pa.Table) -> pa.Table:
            found = [best(own.slice(at, block), others.to_batches()) for at in range(0, own.num_rows, block)]
            return pa.Table.from_batches([x for x in found if x is not None], schema=TOPK)

        # rows are many and queries few: rows are sent once for DEALT blocks of queries, which their task takes one by one
        left, right = _blocks(rows, rows.count(), wanted, n, DEALT * block, row_block)
        found = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(pair, kinds)
    return ranked(found).filter(F.col("rank") <= k)


TOPK = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def scores(
    corpus: DataFrame, queries: DataFrame, *keys: str, digits: int = 6, least: float | None = None, block: int = DEFAULT.query_block, row_block: int = DEFAULT.row_block
) -> DataFrame:
    """(query_id, keys, score): the cosine of every query with every row of *corpus* (keys, vec), or of those from *least*.

    Meant for rows whose number doesn't follow the corpus, like tags or centres: up to *block* of them are sent to
    all tasks, which go over the queries; beyond that both sides are dealt in blocks, as in topk().
    """
    spark = corpus.sparkSession
    wanted = queries.filter("vec IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = corpus.filter("vec IS NOT NULL").select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    kinds = ", ".join(["query_id long", *[f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema], "score double"])
    every = _every([*keys], digits, least)
    few = rows.limit(block + 1).toArrow()  # bounded: decides, and is what is sent
    if few.num_rows <= block:
        data = spark.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = data.value.combine_chunks().to_batches()
            for batch in batches:
                yield from every(pa.Table.from_batches([batch]), held)

        return wanted.mapInArrow(run, kinds)
    schema = pa.schema([("query_id", pa.int64()), *[few.schema.field(c) for c in keys], ("score", pa.float64())])

    def pair(own: pa.Table, others: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(every(own, others.combine_chunks().to_batches())), schema=schema)

    left, right = _blocks(rows, rows.count(), wanted, wanted.count(), block, row_block)
    return left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(pair, kinds)


def ranked(found: DataFrame, *by: str) -> DataFrame:
    """Add `rank`: by score downwards, then chunk_id, for each query (and *by*)."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order))


def centroids(members: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, vec): the element-wise mean of the vectors `vec` of each key, by a column *weight* if there is one; summed as vectors before the exchange."""
    held = members.filter("vec IS NOT NULL").select(*keys, array_to_vector(F.col("vec").cast("array<double>")).alias("vec"), *([weight] if weight else []))
    mean = Summarizer.mean(F.col("vec"), F.col(weight)) if weight else Summarizer.mean(F.col("vec"))
    return held.groupBy(*keys).agg(vector_to_array(mean).alias("vec"))
