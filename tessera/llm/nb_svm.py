"""A quality classifier: naive Bayes support vectors over n-gram indicators.

A text is the set of its n-grams: runs of 3 bytes, words (between ASCII white space, A-Z lower-cased) and pairs of them, and runs of up to
3 flags that say whether a word is the word before. Each is hashed to one of 2^bits features. Over all labelled rows a feature's log-count
ratio r is log of its smoothed share in class 1 over that in class 0. A row's vector is r at its features, scaled to unit length; a linear
hinge-loss model is fit to these by dual coordinate descent, each class weighing alike, and drawn towards plain naive Bayes by *beta*.

The ratios are counted over all labelled rows. The descent runs in one task on a sample of the labelled rows of *fit_rows* in the mean
(all, where there are no more), drawn by a hash of the id. A score is the logistic function of the margin, so 0.5 is the margin's sign.

Rows: null and empty texts have one feature of their own; repeated rows get the same score; null ids have no label. Labels that are null are
none; a document with several has the least. A text of any length is taken whole, in pieces that overlap by three words. Where
labels lack a class, every score is the share of label 1, or 0.5 without labels. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, bounded, discard, materialize, packed, released, unpacked

BITS = 18
#: Bytes of a text that are worked on at once.
PIECE = 1 << 20
#: Labels up to this many are sent to all tasks (some 30 MB); more are joined by an exchange of the labelled texts.
SENT_LABELS = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[list(ASCII_SPACE.encode())] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind * BASE % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to size - 1, modulo 2^64."""
    up, down = (np.full(size, b % 2**64, np.uint64) for b in (BASE, pow(BASE, -1, 2**64)))
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some bytes, and where it begins: differences of one running sum over the bytes."""
    gap = np.concatenate(([True], SPACE[data], [True]))
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _powers(1 << max(12, len(data).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWER[data] + np.uint64(1)) * up[: len(data)])))
    return _mix((total[end] - total[start]) * down[start], 1), start


def _piece(data: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Hashes of the n-grams of some bytes, and where the last three words begin."""
    found = []
    if len(data) > 2:
        x = data.astype(np.uint64)
        found.append(_mix((x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:], 2))
    words, start = word_hashes(data)
    found += [words, _mix(words[:-1] * np.uint64(31) + words[1:], 3)]
    flag = (words[1:] == words[:-1]).astype(np.uint64)
    for n in range(1, min(3, len(flag)) + 1):
        codes = np.zeros(len(flag) - n + 1, np.uint64)
        for k in range(n):
            codes = codes * np.uint64(2) + flag[k : len(flag) - n + 1 + k]
        found.append(_mix(np.unique(codes), 4 + n))
    return found, int(start[-3]) if len(start) > 2 else 0


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """The sorted features of a text."""
    data, shift = np.frombuffer(text, np.uint8), np.uint64(64 - bits)
    if not len(data):
        return (_mix(np.zeros(1, np.uint64), 9) >> shift).astype(np.int32)
    parts, at, size = [], 0, PIECE
    while at < len(data):
        end = at + size
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        hashes, back = _piece(data[at:end])
        if end < len(data) and not back:  # too few words to go on behind them
            size *= 2
            continue
        parts.append(np.unique((np.concatenate(hashes) >> shift).astype(np.int32)))
        at, size = (at + back if end < len(data) else end), PIECE
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.large_binary())]


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels aren't learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnt(labels: DataFrame) -> DataFrame:
    """(_id, y): the labels that are learnt from, one for each document."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    return known.groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") >= 1).cast("int").alias("y"))


class Model(NamedTuple):
    #: By feature: weight times ratio, and the square of the ratio.
    weights: np.ndarray
    squares: np.ndarray
    bias: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(self.squares[at].sum() + 1e-12)) + self.bias


def class_counts(rows: DataFrame, bits: int) -> np.ndarray:
    """How many of *rows* (text, y) of each class have each feature; behind the features, how many rows there are."""
    size = (1 << bits) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            for text, y in zip(_bytes(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                counts[y, features(text, bits)] += 1
                counts[y, -1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    parts = bounded(rows.select("text", "y")).mapInArrow(lambda b: released(run(b)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, size), np.int64)
    counts.ravel()[parts["at"].to_numpy()] = parts["n"].to_numpy()
    return counts


def log_ratios(counts: np.ndarray, alpha: float) -> np.ndarray:
    smooth = counts[:, :-1] + alpha
    low, high = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return high - low


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float, epochs: int, least: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model of the unit vectors of ratios at *rows*, classes *y* of -1 and 1, by dual coordinate descent.

    One pass over all rows in a new random order is an epoch; the end is where the projected gradients' range is below *least*.
    """
    w, bias, rng = np.zeros(len(ratios)), 0.0, np.random.default_rng(seed)
    values = [ratios[at] / np.sqrt(np.square(ratios[at]).sum() + 1e-12) for at in rows]
    square = np.array([v @ v for v in values]) + 1.0  # the bias is a feature that all rows have
    top = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    dual = np.zeros(len(y))
    for _ in range(epochs):
        high, low = -np.inf, np.inf
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            bound = min(gradient, 0) if dual[i] == 0 else max(gradient, 0) if dual[i] == top[i] else gradient
            high, low = max(high, bound), min(low, bound)
            if bound:
                before = dual[i]
                dual[i] = min(max(before - gradient / square[i], 0.0), top[i])
                step = (dual[i] - before) * y[i]
                w[at] += step * v
                bias += step
        if high - low < least:
            break
    return w, bias


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = 8192, alpha: float = 1.0, cost: float = 1.0, beta: float = 0.5, epochs: int = 40) -> Model | float:
    """The model of the rows of *docs* (doc_id, text) that learnt(*labels*) has; the share of label 1 where a class is missing."""
    spark = docs.sparkSession
    y = materialize(learnt(labels), "labels")
    n = y.count()
    rows = docs.select("doc_id", "text").join(F.broadcast(y) if n <= SENT_LABELS else y, F.col("doc_id") == F.col("_id"))
    counts = class_counts(rows, bits)
    of_class = counts[:, -1]
    if not of_class.all():
        discard(y)
        return float(of_class[1] / of_class.sum()) if of_class.any() else 0.5
    ratios = spark.sparkContext.broadcast(log_ratios(counts, alpha))
    place = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30))
    # fit_rows ids in the mean
    drawn = F.broadcast(y.filter(place < max(1, round(min(1.0, fit_rows / n) * (1 << 30)))))
    chosen = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, bits) for t in _bytes(batch.column("text"))]
            if found:
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate(found))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists], ["doc_id", "y", "at"])

    def solve(group: pa.Table) -> pa.Table:
        at = group["at"].combine_chunks()
        at = at if isinstance(at, pa.ListArray) else at.chunk(0)
        flat, ends = at.flatten().to_numpy(), at.offsets.to_numpy()
        held = [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
        keys = [(i, h.tobytes()) for i, h in zip(group["doc_id"].to_pylist(), held, strict=True)]
        order = sorted(range(len(held)), key=keys.__getitem__)  # rows arrive in any order
        sign = group["y"].to_numpy()[order] * 2.0 - 1
        w, bias = descend([held[i] for i in order], sign, ratios.value, cost, epochs)
        # towards naive Bayes: the mean size of the weights for all features
        w = (1 - beta) * np.abs(w[w != 0]).mean() + beta * w if w.any() else w
        return pa.table({"w": [w], "bias": [bias]})

    taken = bounded(chosen).mapInArrow(lambda b: released(sets(b)), "doc_id long, y int, at array<int>")
    # the sample is of bounded size
    done = materialize(taken.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "w array<double>, bias double"), "model").first()
    discard(y)
    r = ratios.value
    w = np.array(done.w) if done else np.ones(len(r))
    return Model(w * r, np.square(r), done.bias if done else 0.0)


def with_score(docs: DataFrame, model: Model | float, bits: int = BITS) -> DataFrame:
    """*docs* with `score`."""
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers, twice

    def of_batch(texts: pa.Array) -> pa.Array:
        margin = np.array([sent.value.margin(features(t, bits)) for t in _bytes(texts)], np.float64)
        return pa.array(1 / (1 + np.exp(-4 * np.clip(margin, -100, 100))))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(map(of_batch, batches))

    return bounded(docs).withColumn("score", F.arrow_udf(run, "double")(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of *docs*: the model that train() makes, on whole texts."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    scored = with_score(rows, train(rows, labels, **parameters))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **parameters) -> DataFrame:
    """The rows of *docs* with a score of *least* or more; the columns stay as they are."""
    model = train(docs.select(F.col("doc_id").cast("long"), "text"), labels, **parameters)
    scored = with_score(docs.select(packed(docs), F.col("text")), model)
    return unpacked(scored.filter(F.col("score") >= least), docs.columns, {})
