"""What is new in each document against its neighbours in the order of their ids: rows of terms, which are never spread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lsa import _packed, _unpacked
from tessera.scratch import indexed, materialize

#: Terms that are sent to all tasks, the most frequent; documents that are compared in a task's step.
SENT, BLOCK = 1 << 20, 256


def _weight(n: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log(n)) * (np.log((1 + n_docs) / (1 + df)) + 1)


def neighbours(rows: DataFrame, order: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, total, c): for each of *rows* (doc_id, c ARRAY<STRUCT<t, n>>) the sum of its weights, brought to unit length, and its cosine
    with the row of the next id in *order* (doc_id, place without gaps); 0 without terms.

    A term in one document only needs no number, as no neighbour has it. Of the others the SENT most frequent are numbered and sent; beyond
    those a row gets its own by a join. Rows are exchanged once, as numbers and counts, the first of each block twice; the driver holds the
    first id of each block.
    """
    rows = rows.filter("doc_id IS NOT NULL")
    firsts = order.filter((F.pmod("place", F.lit(BLOCK)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").toArrow()["doc_id"].combine_chunks()
    df = materialize(rows.select(F.explode("c.t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).filter("df >= 2"), "df")
    known = df.orderBy(F.desc("df"), "t").limit(SENT).toArrow()
    more = df.count() > len(known)
    if more:
        last = known.slice(len(known) - 1).to_pylist()[0]
        rest = indexed(df.filter((F.col("df") < last["df"]) | ((F.col("df") == last["df"]) & (F.col("t") > last["t"]))), ["t"], "id")
        own = rows.select("doc_id", F.explode("c.t").alias("t")).join(rest, "t").groupBy("doc_id").agg(F.collect_list(F.struct("t", (F.col("id") + SENT).alias("id"), "df")).alias("more"))
        rows = rows.join(own, "doc_id", "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast("array<struct<t: string, id: long, df: long>>"))
    sent = rows.sparkSession.sparkContext.broadcast((known["t"].combine_chunks(), known["df"].to_numpy(), np.sort(firsts.to_numpy())))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, dfs, firsts = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                lists = batch.column("c")
                of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                t, n = lists.flatten().flatten()
                n = n.to_numpy().astype(np.int32)
                at = pc.fill_null(pc.index_in(t, value_set=terms), -1).to_numpy().astype(np.int64)
                d = np.where(at >= 0, dfs[np.maximum(at, 0)], 1) if len(dfs) else np.ones(len(at), np.int64)
                left = np.flatnonzero(at < 0)
                if more:
                    held = [{x["t"]: (x["id"], x["df"]) for x in own or ()} for own in batch.column("more").to_pylist()]
                    for k, name in zip(left.tolist(), t.take(pa.array(left)).to_pylist(), strict=True):
                        at[k], d[k] = held[of[k]].get(name, (-1, 1))
                w = _weight(n, d, n_docs)
                length = np.maximum(np.sqrt(np.bincount(of, w * w, batch.num_rows)), 1e-300)
                total = np.bincount(of, w, batch.num_rows) / length
                shared = np.flatnonzero(at >= 0)
                shared = shared[np.lexsort((at[shared], of[shared]))]
                own_df = d[shared if more else shared[:0]].astype(np.int32)
                packed = [*_packed(of[shared], batch.num_rows, at[shared].astype(np.int32), n[shared]), *_packed(of[shared if more else shared[:0]], batch.num_rows, own_df)]
                ids = batch.column("doc_id").to_numpy()
                block = np.searchsorted(firsts, ids, "right") - 1
                first_of = (block >= 0) & (firsts[np.maximum(block, 0)] == ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(block), pa.array(first_of), pa.array(total), pa.array(length), *packed], ["doc_id", "own", "first", "total", "length", "ids", "ns", "dfs"])

    numbered = rows.select("doc_id", "c", "more").mapInArrow(number, f"doc_id {kind}, own long, first boolean, total double, length double, ids binary, ns binary, dfs binary")
    dealt = numbered.withColumn("block", F.explode(F.when(F.col("first"), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        batch = table.sort_by("doc_id").combine_chunks().to_batches()[0]
        of, at = _unpacked(batch.column("ids"), np.int32)
        n = _unpacked(batch.column("ns"), np.int32)[1]
        d = _unpacked(batch.column("dfs"), np.int32)[1] if more else sent.value[1][at]
        w = _weight(n, d, n_docs) / batch.column("length").to_numpy()[of]
        # one number for row and term, rising: the same term in the next row is one step further
        step = int(at.max(initial=0)) + 1
        keys = of * step + at
        c = np.zeros(batch.num_rows)
        if len(keys):
            to = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
            same = keys[to] == keys + step
            c += np.bincount(of[same], w[same] * w[to[same]], batch.num_rows)
        out = pa.table({"doc_id": batch.column("doc_id"), "total": batch.column("total"), "c": pa.array(c)})
        return out.filter(pc.equal(batch.column("own"), key[0]))

    return dealt.groupBy("block").applyInArrow(compare, f"doc_id {kind}, total double, c double")
