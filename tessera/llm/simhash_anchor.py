"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits; bit j is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles, repeats included.

Search: two fingerprints at distance 4 or 5 at most differ in two bits at most
in one of their 32-bit halves, so in 31 bits of that half. The anchors of a half
are the words of the perfect Hamming code [31, 26], a covering code of radius 1.
Each fingerprint goes to every anchor within 1 + 2 = 3 bits of it: always 156.
The anchor next to one fingerprint of a linked pair (its home) is then among the
anchors of the other, so comparing homes with all that came to an anchor finds
every link. Distinct fingerprints alone are replicated, so exact copies add
nothing, and each anchor emits a spanning forest of its links, not all pairs.

Scale: replication is dealt by fingerprint over as many tasks as its 312 rows each need. Comparing tasks
get their rows in order, an anchor's homes first, and hold the homes of one anchor and a
chunk of rows. Homes of an anchor that has very many are dealt to several parts, to each of which all rows of
the anchor go; such anchors are HOT_ANCHORS at most.

Near copies: a link is 4 bits or fewer of the 64, as the contract fixes it. Texts with a shingle similarity of 0.8
differ in some 9 bits on average, so about half of all near copies are linked; the README states the measured part.

Defined results: an empty table gives an empty result; a null or empty text has fingerprint 0 and links like any
other; a null doc_id is never a component's id unless nothing else is in it
(then null); repeated rows are kept as they are; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, connected_components, materialize, released

BITS = 31
MASK = (1 << BITS) - 1
REPLICAS = 156
#: Rows of (slot, fingerprint) that a comparing task should get, and that it holds at once.
ROWS_PER_TASK, ROWS_AT_ONCE = 2_000_000, 400_000
#: Pairs that a comparing task holds at once.
PAIRS_AT_ONCE = 1_000_000
#: An anchor with more homes than this, and than one in HOT_ANCHORS of all, is dealt to several parts.
HOT_HOMES, HOT_ANCHORS = 20_000, 10_000


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.lower().split()  # of bytes: A-Z only, and white space as in the contract
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    counts = np.zeros(64, np.int64)
    total = n - width + 1
    for at in range(0, total, 1 << 16):
        upto = min(total, at + (1 << 16))
        hashes = np.array(
            [digest(view[a:b], 42) for a, b in zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist(), strict=True)],
            np.dtype("<u8"),
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(1))
            fps = np.fromiter(values, np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return lambda batches: released(run(batches))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints(width), "doc_id long, fp long"
    )


def syndrome(words: np.ndarray) -> np.ndarray:
    """XOR of the places (from 1) of the set bits: 0 for the code's words."""
    out = np.zeros(words.shape, np.int64)
    for j in range(BITS):
        out ^= np.where((words >> j) & 1, j + 1, 0)
    return out


def error_patterns() -> np.ndarray:
    """By syndrome, the 156 patterns of at most 3 bits that have it."""
    by: list[list[int]] = [[] for _ in range(32)]
    by[0].append(0)
    for i in range(1, 32):
        by[i].append(1 << (i - 1))
        for j in range(i + 1, 32):
            by[i ^ j].append(1 << (i - 1) | 1 << (j - 1))
            for k in range(j + 1, 32):
                by[i ^ j ^ k].append(1 << (i - 1) | 1 << (j - 1) | 1 << (k - 1))
    return np.array(by, np.int64)


def homes(halves: np.ndarray) -> np.ndarray:
    """The one anchor within one bit of each 31-bit half."""
    s = syndrome(halves)
    return np.where(s > 0, halves ^ (1 << np.maximum(s - 1, 0)), halves)


def _half(fps: np.ndarray, half: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(MASK)).astype(np.int64)


def _homes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([homes(_half(fps, h)) | h << BITS for h in (0, 1)]))], ["anchor"])


def _replicate(hot: dict[int, int]):
    """A fingerprint's rows (slot, fp). A slot is part * 2^33 + anchor * 2, and 1 more but at the fingerprint's home; *hot* has anchors by number of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = error_patterns()
        many = np.array(sorted(hot), np.int64)
        n_parts = np.array([hot[a] for a in sorted(hot)], np.int64)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 1024):
                fps = np.ascontiguousarray(every[at : at + 1024])
                for half in (0, 1):
                    words = _half(fps, half)
                    anchors = words[:, None] ^ patterns[syndrome(words)]
                    far = (anchors != homes(words)[:, None]).ravel()
                    anchors, who = anchors.ravel() | half << BITS, np.repeat(fps, REPLICAS)
                    slot = anchors << 1 | far
                    if len(many):
                        place = np.minimum(np.searchsorted(many, anchors), len(many) - 1)
                        parts = np.where(many[place] == anchors, n_parts[place], 1)
                        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                        slot, who, far, parts = (np.repeat(x, parts) for x in (slot, who, far, parts))
                        own = (who.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                        slot = (slot | (far | (part != own))) + (part << (BITS + 2))
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(who)], ["slot", "fp"])

    return run


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of nodes to the least node of their component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _pairs(slot: np.ndarray, fp: np.ndarray, carried: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links of homes with the rows of the same anchor and part. Slots are in order; the first *carried* rows are homes that met one another before."""
    key = slot >> 1
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[start[1:], len(key)]
    group = np.repeat(np.arange(len(start)), ends - start)
    first = np.maximum(start, carried)  # homes of a later group are compared with all of its rows
    size = np.maximum(ends - first, 0)
    left = np.flatnonzero((slot & 1 == 0) & (ends[group] - start[group] > 1) & (size[group] > 0))
    work = size[group[left]]
    cuts = np.cumsum(work)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(cuts, (cuts[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        mine, n = left[lo:hi], work[lo:hi]
        lo = hi
        i = np.repeat(mine, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[mine]], n)
        x, y = fp[i], fp[j]
        near = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius) & (x != y)
        if near.any():
            a, b = forest(x[near], y[near])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held_slot, held_fp = none, none  # homes of the anchor that the last chunk ended in
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal held_slot, held_fp
            slot, fp = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            if len(held_slot) and held_slot[0] >> 1 != slot[0] >> 1:
                held_slot, held_fp = none, none
            carried = len(held_slot)
            slot, fp = np.r_[held_slot, slot], np.r_[held_fp, fp]
            yield from _pairs(slot, fp, carried, radius)
            last = (slot >> 1 == slot[-1] >> 1) & (slot & 1 == 0)
            held_slot, held_fp = slot[last], fp[last]

        rows = 0
        for b in batches:
            if b.num_rows:
                waiting.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
                rows += b.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from chunk()
                rows = 0
        if waiting:
            yield from chunk()

    return lambda batches: released(run(batches))


def hot_anchors(fps: DataFrame, n: int) -> dict[int, int]:
    """Anchors with many homes, by the number of parts that these are dealt to: HOT_ANCHORS at most."""
    most = max(HOT_HOMES, -(-2 * n // HOT_ANCHORS))
    counted = fps.select("fp").mapInArrow(_homes_of, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return {r.anchor: -(-r.n // most) for r in counted.collect()}


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints *fps* as links of *radius* do."""
    if not 0 <= radius <= 5:
        raise ValueError("the anchors guarantee all links up to 5 bits")
    spark = fps.sparkSession
    n = fps.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * 2 * REPLICAS // ROWS_PER_TASK))
    sent = fps.select("fp").repartition(tasks, "fp").mapInArrow(_replicate(hot_anchors(fps, n)), "slot long, fp long")
    dealt = sent.repartition(tasks, F.shiftright("slot", 1)).sortWithinPartitions("slot")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of *docs*."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "distinct")
    roots = connected_components(links(fps, radius)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    named = materialize(rooted.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """*docs* without the near copies: of each group the row of the least doc_id stays.

    The columns stay as they are. Of repeated rows with that doc_id all stay
    that have equal text; rows without a doc_id go where their group has one,
    and stay where it has none.
    """
    found = near_duplicates(docs, width, radius)
    lost = materialize(
        found.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("_lost"))
        .distinct(),
        "lost",
    )
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["_lost"]), "left_anti")
