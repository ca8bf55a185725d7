"""Pairs of neighbouring characters: counted over all texts, and what their frequencies make of each text.

Pairs are counted in the tasks, so that an exchange holds a row for each pair and task. A model of up to SENT pairs is sent to all tasks; of a
larger one each row gets the part that it needs by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Characters that the smoothing counts on; pairs of a model that is sent; characters that are looked at together; pairs that a task holds.
KINDS, SENT, CHARS, HELD = 65_536, 2_000_000, 1 << 19, 1 << 20
#: Pairs of characters below this are counted by place.
LOW = 512


class Model(NamedTuple):
    #: (g, n2, n1): pairs as numbers, how often they stand, and how often their first character begins a pair.
    pairs: DataFrame
    #: The same by g, or None where they are too many to be sent.
    sent: pa.Table | None


def text_pairs(text: str) -> np.ndarray:
    """A number for each pair of neighbours, by place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-1] << 21 | c[1:]


def _slices(texts: Iterator[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of *texts* end to end, and the text of each."""
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    inside = of[1:] == of[:-1]
    return text_pairs("".join(texts))[inside], of[1:][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, seen, n_held = np.zeros(LOW * LOW, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g, at = np.unique(np.concatenate([g for g, _ in seen]), return_inverse=True)
        return g, np.bincount(at, np.concatenate([n for _, n in seen]), len(g)).astype(np.int64)

    for texts in _slices(t for batch in batches for t in batch.column(0).to_pylist() if t):
        g = _joined(texts)[0]
        a, b = g >> 21, g & (1 << 21) - 1
        small = (a < LOW) & (b < LOW)
        low += np.bincount(a[small] * LOW + b[small], minlength=LOW * LOW)
        seen.append(np.unique(g[~small], return_counts=True))
        n_held += len(seen[-1][0])
        if n_held > HELD:
            seen = [merged()]
            n_held = len(seen[0][0])
            if n_held > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in seen[0]], ["g", "n"])
                seen, n_held = [], 0
    at = np.flatnonzero(low)
    for g, n in ((at // LOW << 21 | at % LOW, low[at]), merged()):
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "n"])


def count(texts: DataFrame, text: str | Column = "text", most_sent: int = SENT) -> Model:
    """The model of all *texts*."""
    n2 = materialize(texts.select(text).mapInArrow(_count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n2")), "pairs")
    n1 = n2.groupBy(F.shiftright("g", 21).alias("a")).agg(F.sum("n2").alias("n1"))
    pairs = materialize(n2.join(n1, F.shiftright("g", 21) == F.col("a")).select("g", "n2", "n1"), "model")
    return Model(pairs, pairs.orderBy("g").toArrow() if pairs.count() <= most_sent else None)


class Losses:
    """The loss of each pair: the logarithm of its smoothed frequency behind its first character, negative."""

    def __init__(self, g: np.ndarray, n2: np.ndarray, n1: np.ndarray, kinds: int = KINDS):
        self.g, self.kinds, self.value = g, kinds, np.log((n1 + kinds) / (n2 + 1))
        self.first, at = np.unique(g >> 21, return_index=True)
        self.unseen = np.log(n1[at] + float(kinds))

    def of(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.g):
            return np.full(len(pairs), np.log(float(self.kinds)))
        at = np.minimum(np.searchsorted(self.g, pairs), len(self.g) - 1)
        out, new = self.value[at], self.g[at] != pairs
        if new.any():  # a pair that isn't counted, behind a first character that is, or isn't either
            a = pairs[new] >> 21
            at = np.minimum(np.searchsorted(self.first, a), len(self.first) - 1)
            out[new] = np.where(self.first[at] == a, self.unseen[at], np.log(float(self.kinds)))
        return out


def _arrays(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in ("g", "n2", "n1")]


def with_losses(rows: DataFrame, keys: list[str], text: Column, model: Model):
    """(*rows*, maker): what gives each batch's rows their Losses.

    maker(batch) lists them. Of a model that isn't sent, *rows* have a column `_model` more: what it holds of the pairs of *text*, and of no others. So a text
    that is made of parts of *text*, which brings new pairs together, is looked up anew.
    """
    spark = rows.sparkSession
    if model.sent is not None:
        data = spark.sparkContext.broadcast(model.sent)
        held: list[Losses] = []

        def sent(batch: pa.RecordBatch) -> list[Losses]:
            if not held:
                held.append(Losses(*_arrays(data.value)))
            return held * batch.num_rows

        return rows, sent

    def own(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(text_pairs(t or "")) for t in texts.to_pylist()], pa.list_(pa.int64()))

    asked = rows.select(*keys, F.explode(F.arrow_udf(own, "array<bigint>")(text)).alias("g"))
    # a pair that isn't counted stands for itself with none
    n1 = model.pairs.groupBy(F.shiftright("g", 21).alias("a")).agg(F.first("n1").alias("n1"))
    found = asked.join(model.pairs.select("g", "n2"), "g", "left").join(n1, F.shiftright("g", 21) == F.col("a")).withColumn("n2", F.coalesce("n2", F.lit(0)))
    parts = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", "n2", "n1"))).alias("_model"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = rows.alias("l").join(parts.alias("r"), on, "left").select("l.*", "r._model")

    def looked_up(batch: pa.RecordBatch) -> list[Losses]:
        out = []
        for m in batch.column("_model"):
            fields = m.values.flatten() if m.is_valid else [pa.array([], pa.int64())] * 3
            out.append(Losses(*[x.to_numpy(zero_copy_only=False) for x in fields]))
        return out

    return joined, looked_up


def sums(rows: DataFrame, keys: list[str], text: str = "text", most_sent: int = SENT) -> DataFrame:
    """(keys, n, loss): how many pairs the texts of each key have, and their losses together. Keys without a pair are left out."""
    rows = rows.select(*keys, text)
    model = count(rows, text, most_sent)
    if model.sent is None:  # rows of one key need not be one text
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        rows = materialize(rows, "rows")
    held, maker = with_losses(rows, ["_row"] if model.sent is None else keys, F.col(text), model)
    kinds = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "n long", "loss double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, losses = [t or "" for t in batch.column(text).to_pylist()], maker(batch)
            n, loss = [], []
            if model_is_sent:
                for part in _slices(iter(texts)):
                    g, of = _joined(part)
                    n.append(np.bincount(of, minlength=len(part)))
                    loss.append(np.bincount(of, losses[0].of(g), len(part)))
            else:
                for t, own in zip(texts, losses, strict=True):
                    g = text_pairs(t)
                    n.append([len(g)])
                    loss.append(np.bincount(np.zeros(len(g), np.int64), own.of(g), 1))  # in order, as above
            if texts:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(loss), pa.float64())], [*keys, "n", "loss"])

    model_is_sent = model.sent is not None
    each = held.mapInArrow(run, kinds).filter("n > 0")
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
