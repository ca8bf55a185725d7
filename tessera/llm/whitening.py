"""Whitening of embeddings: principal components by a randomised range finder, and the rows projected on them.

An entry c becomes the integer x = floor(64 c) + 1,000,000. Sums of x are exact; a covariance is taken over all rows, centred
before multiplying, with the number of rows as divisor. A pass multiplies the covariance V with an orthonormal basis Q: each task
adds up its rows' share of V Q (dimensions by columns of Q), and the shares are summed by entry in one exchange. The first Q is
random, with more columns than components are wanted; each pass gives the Rayleigh-Ritz pairs of the span of Q, their residuals and
the next Q. Where the residuals don't reach the rounding of V (eigenvalues that lie close together), Q is expanded to an orthonormal
basis of all dimensions, for which the pairs are exact. Numbers of the size of dimensions squared at most come to the driver.

Rows: those whose vector is null or empty or holds null or non-finite entries, or ones whose x would have over 40 bits, are dropped; so are
vectors of another length than most rows have (of equally many, the longer). Repeated rows count each time; null ids stay; tied
eigenvalues get any orthonormal basis of their space. Components without variance (below 1e-12 of all) can't be scaled
to one and aren't returned; without any, as for one row or none, the result is empty. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded

SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**40
#: A residual of this part of the largest eigenvalue is rounding.
ROUNDING = 1e-14
#: Eigenvalues below this part of their sum are none.
NO_VARIANCE = 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


class Fit(NamedTuple):
    n: int
    sums: list[int]
    #: Orthonormal columns, by falling eigenvalue.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    #: Columns of the basis that gave them, and how many passes over the rows that took.
    columns: int
    passes: int

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole parts and the rest of the means."""
        return _centre(self.n, self.sums)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.float64) / n


def valid(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < MOST))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine, F.lit(False))


def whole(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that are fit on, all of one length."""
    rows = df.filter(valid(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.filter(F.size("v") == (width.w if width else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The integers x, a row for each vector."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * c).astype(np.int64) + OFFSET).reshape(len(column), -1)


def _summed(rows: DataFrame, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of share(x of some rows), which has *shape*: added up in each task, then by entry in one exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += share(matrix(batch.column(0)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "x"])

    parts = bounded(rows.select("v")).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(shape)
    out.ravel()[parts["at"].to_numpy()] = parts["x"].to_numpy()
    return out


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)).sum(axis=0)  # 41 bits and the rows of a batch: within 64
                n, sums = n + batch.num_rows, x.astype(object) if sums is None else sums + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([Decimal(n), *map(Decimal, sums)], pa.decimal128(38, 0))], ["at", "x"])

    found = bounded(rows.select("v")).mapInArrow(run, "at int, x decimal(38,0)").groupBy("at").agg(F.sum("x").alias("x")).sort("at").collect()
    return (int(found[0].x), [int(r.x) for r in found[1:]]) if found else (0, [])


def fit(rows: DataFrame, components: int = 32, oversampling: int = 8, passes: int = 3, seed: int = 1) -> Fit | None:
    """The leading eigenvectors of the covariance of *rows* (whole()); None without rows.

    At most *passes* passes are made with *components* + *oversampling* random columns, then one with all dimensions.
    """
    n, sums = totals(rows)
    if not n:
        return None
    floor, rest = _centre(n, sums)
    d = len(sums)
    k, width = min(components, d), min(components + oversampling, d)

    def times(q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def share(x: np.ndarray) -> np.ndarray:
            c = (x - floor) - rest
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), np.square(c).sum())])  # the last row: the trace

        return share

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for done in range(1, passes + 2):
        if done > passes and q.shape[1] < d:  # the residuals failed: all dimensions, of which the span so far is a part
            q = np.linalg.qr(np.hstack([q, np.random.default_rng(seed + 1).standard_normal((d, d - q.shape[1]))]))[0]
        both = _summed(rows, times(q), (d + 1, q.shape[1])) / n
        z, trace = both[:d], float(both[d, 0])
        t = q.T @ z
        values, inner = np.linalg.eigh((t + t.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        vectors = q @ inner
        residual = np.linalg.norm((z @ inner - vectors * values)[:, :k], axis=0)
        if q.shape[1] == d or residual.max() <= ROUNDING * max(values[0], 0):
            break
        q = np.linalg.qr(z @ inner)[0]
    held = values[:k] > NO_VARIANCE * trace
    return Fit(n, sums, vectors[:, :k][:, held], values[:k][held], trace, q.shape[1], done)


def projected(x: np.ndarray, f: Fit) -> np.ndarray:
    floor, rest = f.centre()
    return (((x - floor) - rest) @ f.components) / np.sqrt(f.eigenvalues)


def identity_error(rows: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: a pass of its own over all rows."""
    k = len(f.eigenvalues)

    def share(x: np.ndarray) -> np.ndarray:
        w = projected(x, f)
        return np.vstack([w.T @ w, w.sum(axis=0)[None]])

    both = _summed(rows, share, (k + 1, k)) / f.n
    # the rows are centred, so the means are rounding
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    floor, rest = _centre(n, sums)
    near = np.square(((x - floor) - rest) * n).sum(axis=1)
    left = np.array([s % n for s in sums], np.int64)
    fits = near < 9e18
    exact = np.full(len(x), None, object)
    exact[fits] = np.square((x[fits] - floor) * n - left).sum(axis=1)
    for i in np.flatnonzero(~fits & (near < 1e19)):
        v = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        exact[i] = v if v < 1 << 63 else None
    return exact.tolist()


def whiten(df: DataFrame, components: int = 32, oversampling: int = 8, passes: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component from 1."""
    rows = whole(df, key, vector)
    f = fit(rows, components, oversampling, passes)
    if f is None or not len(f.eigenvalues):
        return df.sparkSession.createDataFrame([], f"{OUT}, identity_error double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(f.eigenvalues)
        share = f.eigenvalues / f.trace
        for batch in batches:
            x = matrix(batch.column("v"))
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            one = [batch.column("vec_id"), pa.array(deviations(x, f.n, f.sums), pa.int64())]
            ids, deviation = (c.take(at) for c in one)
            cols = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, f.n), deviation, projected(x, f).ravel(), np.tile(share, m)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [c.partition(" ")[0] for c in OUT.split(", ")])

    return bounded(rows).mapInArrow(run, OUT).withColumn("identity_error", F.lit(identity_error(rows, f)))
