"""A threshold that is carried through all documents in their order: an associative scan over the whole table."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.scratch import materialize


def local_minima(values: DataFrame, doc: str, place: str, value: str) -> DataFrame:
    """(doc, place, high, low): values below the one before, and below the one after or equal to it.

    *high* is the larger and *low* the smaller step to the neighbours; where the next one is equal, both are the step from the one before.
    """
    w = Window.partitionBy(doc).orderBy(place)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    steps = values.select(doc, place, v.alias("_v"), (before - v).alias("_l"), (after - v).alias("_r")).filter("_l > 0 AND _r >= 0")
    left, right = F.col("_l"), F.when(F.col("_r") > 0, F.col("_r")).otherwise(F.col("_l"))
    return steps.select(doc, place, F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))


class Steps:
    """How a stretch of minima changes the threshold that comes into it.

    A minimum (high, low) is taken if high reaches the threshold, which then falls to low if that is less. So a stretch maps some intervals
    (a, b] of thresholds each to one value and leaves others as they are; the intervals are disjoint and in order.
    """

    def __init__(self, pieces: Iterable[tuple[float, float, float]] = ()):
        self.pieces = list(pieces)

    def add(self, high: float, low: float) -> None:
        """One more minimum behind the stretch."""
        # what came out in (low, high] now comes out as low
        ends = [p[1] for p in self.pieces]
        first = bisect.bisect_right([p[2] for p in self.pieces], low)  # values rise with the intervals
        last = bisect.bisect_right([p[2] for p in self.pieces], high)
        start = max(low, ends[first - 1]) if first else low
        stop = max(high, ends[last - 1]) if last else high
        if start < stop:
            self.pieces[first:last] = [(start, stop, low)]

    def of(self, threshold: float) -> float:
        k = bisect.bisect_left([p[1] for p in self.pieces], threshold)
        return self.pieces[k][2] if k < len(self.pieces) and self.pieces[k][0] < threshold else threshold


_STEPS = "_part int, a double, b double, c double"


def taken_minima(minima: DataFrame, doc: str, place: str, threshold: float, warm: int = 100) -> DataFrame:
    """The rows of *minima* (doc, place, high, low) that a scan of all documents in order takes.

    Up to *warm* taken minima the *threshold* holds; from then on it is the least low of all taken ones. The first *warm* are a top-k of the
    order. What each range of the order does to a threshold is worked out in its own task (Steps), the driver puts these together, a few
    numbers for each range, and each range is run once more with the threshold that comes into it.
    """
    order = [doc, place]
    minima = materialize(minima, "minima")
    enough = minima.filter(F.col("high") >= threshold)
    first = enough.select(doc, place, "low").orderBy(*order).limit(warm).collect()
    if len(first) < warm:
        return enough
    last, least = first[-1], min(r.low for r in first)
    behind = (F.col(doc) > F.lit(last[doc])) | ((F.col(doc) == F.lit(last[doc])) & (F.col(place) > F.lit(last[place])))
    rest = materialize(minima.filter(behind).repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")), "ranges")

    def steps(group: pa.Table) -> pa.Table:
        s = Steps()
        for high, low in zip(*(group.sort_by([(k, "ascending") for k in order])[c].to_pylist() for c in ("high", "low")), strict=True):
            s.add(high, low)
        part = group["_part"][0].as_py()
        a, b, c = zip(*s.pieces, strict=True) if s.pieces else ((), (), ())
        return pa.table({"_part": pa.array([part] * len(a), pa.int32()), "a": pa.array(a, pa.float64()), "b": pa.array(b, pa.float64()), "c": pa.array(c, pa.float64())})

    of: dict[int, list] = {}
    # only what a threshold of *least* or below can meet
    for r in rest.select(*order, "high", "low", "_part").groupBy("_part").applyInArrow(steps, _STEPS).filter(F.col("a") < least).sort("_part", "a").collect():
        of.setdefault(r._part, []).append((r.a, r.b, r.c))
    now, comes_in = least, {}
    for part in sorted(r._part for r in rest.select("_part").distinct().collect()):
        comes_in[part] = now
        now = Steps(of.get(part, ())).of(now)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in order])
        t, kept = comes_in[group["_part"][0].as_py()], []
        for high, low in zip(group["high"].to_pylist(), group["low"].to_pylist(), strict=True):
            kept.append(high >= t)
            if kept[-1]:
                t = min(t, low)
        return group.drop_columns(["_part"]).filter(pa.array(kept, pa.bool_()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in minima.schema)
    late = rest.select(*minima.columns, "_part").groupBy("_part").applyInArrow(run, kinds)
    return enough.filter(~behind).unionByName(late)


def dynamic_chunks(values: DataFrame, doc: str, place: str, value: str, threshold: float, warm: int = 100) -> DataFrame:
    """(doc, place, chunk): each row of *values* with its chunk; chunks end with a taken minimum, and a document's last row ends one.

    Values that are null or not finite are no minima; ties in order have no defined result.
    """
    fine = values.filter(F.col(value).isNotNull() & (F.abs(F.col(value)) < math.inf))
    taken = taken_minima(local_minima(fine, doc, place, value), doc, place, threshold, warm)
    w = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    cut = values.select(doc, place).join(taken.select(doc, place, F.lit(1).alias("_cut")), [doc, place], "left")
    return cut.select(doc, place, F.coalesce(F.sum("_cut").over(w), F.lit(0)).alias("chunk"))
