"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, shared shingles, exact verification.

Items and documents are sequences of lower-cased words. For each item size the
windows of that many words slide over a document one word at a time. A window
less than `least` of whose weight is in five-word shingles of items of its size can't reach
the similarity `least` with any of them and is passed over. The others get a 64-bit weighted SimHash. Items of the same
size are indexed by four 16-bit blocks of the fingerprint: fingerprints within
the radius differ in radius // 4 bits at most in one of them, so the index holds each block's value with
all values that near, and a window finds all items within the radius by four exact lookups. A random item
shares such a block with one window in 23. Similar
windows beyond the radius are found by the shingles that they share with an
item: those that hold enough of its weight for the similarity `least` are
candidates too, so none is lost. Each candidate is then verified by the exact weighted Jaccard
similarity of the shingles (multisets; a shingle that several items share
weighs less).

Items are collected and sent to the tasks in blocks of about
`block_items` (some 17 KB an item), one block after another; each is compared with all documents,
whole, and its finds are written before the next one comes. How many items share
a shingle is counted over all items once, so the blocks don't change the result; the weights of the
shingles that several items share go to all tasks, 9 bytes each, of which `most_shared` are allowed (ValueError beyond it).

Defined results: an empty table of documents gives an empty result, one of items finds nothing; items of fewer than five words (null and empty texts among
them) have no shingle and match nothing; a null or empty document matches
nothing; equal items each get their own match; rows that repeat a doc_id and text are treated alike; a document's
columns stay, but that with_matches replaces one named `matches`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, discard, materialize, packed, released, unpacked

WORD = re.compile(r"\w+")
#: Weight of a shingle that one item holds, or none.
WEIGHT = 8
#: Blocks of a fingerprint, of 16 bits each.
BLOCKS = 4
#: Window starts that are fingerprinted at once.
STARTS = 8192
#: Pairs of a shingle's place and an item that are looked at at once.
PAIRS = 4_000_000
MATCH = "array<struct<item_id: long, start_word: long, n_words: long, distance: int, similarity: double>>"


class Item(NamedTuple):
    item_id: int
    fp: int
    shingles: dict[bytes, int]
    weight: int


class Weights(NamedTuple):
    """The weights of shingles that several items hold; of all others it is WEIGHT."""

    hashes: np.ndarray  # in order
    values: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), WEIGHT, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], WEIGHT).astype(np.int32)


class Index(NamedTuple):
    words: dict[str, int]
    gate: np.ndarray  # sorted codes of the items' shingles
    gate_weight: np.ndarray
    gate_sizes: dict[int, np.ndarray]  # by size, which codes are in items of that size
    bloom: np.ndarray
    weights: Weights  # of shingle hashes that several items share, of this block or others
    floor: int  # the least weight of a shingle that no item of this block holds
    sizes: dict[int, list[Item]]
    blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by size and block: values near an item's in order, and whose they are
    fps: dict[int, np.ndarray]
    holders: dict[int, tuple[np.ndarray, np.ndarray]]  # by size: where each gate code's items begin, and these


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit code for each run of *width* values."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ values[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def signed_bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def simhashes(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the runs of *size* shingles that begin at *starts*."""
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(signed_bits(hashes) * weights[:, None], axis=0, out=sums[1:])
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1, bitorder="little").view("<u8").ravel()


def block_values(fps: np.ndarray) -> list[np.ndarray]:
    """The blocks of neighbouring bits of each fingerprint."""
    return [((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.uint16) for k in range(BLOCKS)]


def near_masks(bits: int) -> np.ndarray:
    """All 16-bit values of at most *bits* bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


def near_index(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By block the values near that of any fingerprint, in order, and whose they are."""
    masks = near_masks(radius // BLOCKS)
    out = []
    for own in block_values(fps):
        values = (own[:, None] ^ masks[None, :]).ravel()
        order = np.argsort(values, kind="stable")
        out.append((values[order], (order // len(masks)).astype(np.int32)))
    return out


def candidates(fps: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in *fps*, place of an item) that are near in a block at least: all within the radius are among them."""
    found = [np.zeros(0, np.int64)]
    for own, (values, whose) in zip(block_values(fps), blocks, strict=True):
        low, high = np.searchsorted(values, own, side="left"), np.searchsorted(values, own, side="right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        found.append(np.repeat(np.arange(len(fps)), n) * n_items + whose[at])
    pairs = np.unique(np.concatenate(found))
    return pairs // n_items, pairs % n_items


def sharing(codes: np.ndarray, weight: np.ndarray, starts: np.ndarray, span: int, total: np.ndarray, items: list[Item], held: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in *starts*, place of an item) that share shingles enough for the similarity *least*: none of these is missing.

    *codes* are places in the gate, -1 where there is none, *total* is the weight of each start's window.
    """
    first, items_of = held
    places = np.flatnonzero(codes >= 0)
    low = first[codes[places]]
    n = first[codes[places] + 1] - low
    if n.sum() > PAIRS and len(starts) > 1:  # shingles that many items hold: fewer starts at once
        half, found = len(starts) // 2, []
        for lo, hi in ((0, half), (half, len(starts))):
            a, b = int(starts[lo]), int(starts[hi - 1]) + span
            k, i = sharing(codes[a:b], weight[a:b], starts[lo:hi] - a, span, total[lo:hi], items, held, least)
            found.append((k + lo, i))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    who, where = items_of[at], np.repeat(places, n)
    share = least / (1 + least)  # of the weights of both sides, what both have
    need = share * (np.array([x.weight for x in items]) + (total.min() if len(total) else 0)) - 1e-6
    kept = np.bincount(who, weights=weight[where], minlength=len(items))[who] >= need[who]
    order = np.argsort(who[kept], kind="stable")
    who, where = who[kept][order], where[kept][order]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    edges = np.r_[0, np.flatnonzero(np.diff(who)) + 1, len(who)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a == b:
            continue
        own, i = where[a:b], int(who[a])
        sums = np.r_[0, np.cumsum(weight[own])]
        both = sums[np.searchsorted(own, starts + span)] - sums[np.searchsorted(own, starts)]
        k = np.flatnonzero(both >= share * (total + items[i].weight) - 1e-6)
        found.append((k, np.full(len(k), i, np.int64)))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def shingle_weights(hashes: np.ndarray, holders: np.ndarray) -> Weights:
    """The weights of shingles by how many items hold each."""
    some = np.flatnonzero(holders > 1)
    order = some[np.argsort(hashes[some])]
    return Weights(hashes[order], np.maximum(1, np.rint(WEIGHT / holders[order])).astype(np.uint8))


def build_index(items: list[tuple[int, str | None]], radius: int, width: int = 5, weights: Weights | None = None) -> Index:
    """The index of *items*; *weights* are the shingle weights over all items if these are but a block of them."""
    found = [(i, words) for i, text in items if len(words := words_of(text)) >= width]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in found for w in words}), 1)}
    hashes = []
    codes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    for _, words in found:
        codes.append(_rolled(np.array([vocabulary[w] for w in words], np.uint64), width))
        hashes.append(_rolled(word_hashes(words), width))
    held, n_held = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, hashes)]), return_counts=True)
    if weights is None:
        weights = shingle_weights(held, n_held)
    floor = int(weights.values[~np.isin(weights.hashes, held)].min(initial=WEIGHT))
    sizes: dict[int, list[Item]] = {}
    for (item_id, words), own in zip(found, hashes, strict=True):
        w = weights.of(own)
        fp = int(simhashes(own, w, np.zeros(1, np.int64), len(own))[0])
        shingles = Counter("\0".join(words[k : k + width]).encode() for k in range(len(own)))
        sizes.setdefault(len(words), []).append(Item(item_id, fp, dict(shingles), int(w.sum())))
    fps = {n: np.array([x.fp for x in own], np.uint64) for n, own in sizes.items()}
    blocks = {n: near_index(own, radius) for n, own in fps.items()}
    gate = np.unique(np.concatenate(codes))
    gate_weight = np.full(len(gate), WEIGHT, np.int64)
    gate_sizes = {n: np.zeros(len(gate), bool) for n in sizes}
    for (_, words), own, plain in zip(found, codes[1:], hashes, strict=True):
        at = np.searchsorted(gate, own)
        gate_weight[at] = weights.of(plain)
        gate_sizes[len(words)][at] = True
    pairs: dict[int, list[np.ndarray]] = {n: [] for n in sizes}
    for (_, words), own in zip(found, codes[1:], strict=True):
        pairs[len(words)].append(np.unique(np.searchsorted(gate, own)))
    holders = {}
    for n, held in pairs.items():
        code = np.concatenate(held)
        order = np.argsort(code, kind="stable")
        holders[n] = np.searchsorted(code[order], np.arange(len(gate) + 1)), np.repeat(np.arange(len(held)), [len(x) for x in held])[order]
    bloom = np.zeros(1 << 20, bool)
    bloom[(gate & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return Index(vocabulary, gate, gate_weight, gate_sizes, bloom, weights, floor, sizes, blocks, fps, holders)


def similarity(item: Item, words: list[str], weights: list[int]) -> float:
    """Exact weighted Jaccard similarity of an item with a window's words, whose shingles have these *weights*."""
    width = len(words) - len(weights) + 1
    own: Counter[bytes] = Counter()
    weight = {}
    for k, w in enumerate(weights):
        s = "\0".join(words[k : k + width]).encode()
        own[s] += 1
        weight[s] = w
    both = sum(weight[s] * min(n, own[s]) for s, n in item.shingles.items() if s in own)
    return both / (sum(weights) + item.weight - both)


def matches(text: str | None, index: Index, radius: int, least: float, width: int = 5) -> list[dict]:
    """The best match of each item in one document."""
    words = words_of(text)
    if len(words) < width or not len(index.gate):
        return []
    get = index.words.get
    codes = _rolled(np.fromiter((get(w, 0) for w in words), np.uint64, len(words)), width)
    maybe = np.flatnonzero(index.bloom[(codes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if not len(maybe):
        return []
    at = np.minimum(np.searchsorted(index.gate, codes[maybe]), len(index.gate) - 1)
    at, hits = at[index.gate[at] == codes[maybe]], maybe[index.gate[at] == codes[maybe]]
    if not len(hits):
        return []
    weight = np.full(len(codes), index.floor, np.int64)
    weight[hits] = index.gate_weight[at]
    whole = np.r_[0, np.cumsum(weight)]
    place = np.full(len(codes), -1, np.int64)
    place[hits] = at
    best: dict[int, dict] = {}
    for size, items in index.sizes.items():
        span = size - width + 1
        own = hits[index.gate_sizes[size][at]]
        if not len(own) or len(codes) < span:
            continue
        part = np.zeros(len(codes) + 1, np.int64)
        part[own + 1] = weight[own]
        seen = np.cumsum(part)
        starts = np.flatnonzero(seen[span:] - seen[:-span] >= least * (whole[span:] - whole[:-span]) - 1e-9)
        for lo in range(0, len(starts), STARTS):
            for run in np.split(part := starts[lo : lo + STARTS], np.flatnonzero(np.diff(part) > span) + 1):
                first, upto = int(run[0]), int(run[-1]) + size
                local = words[first:upto]
                hashes = _rolled(word_hashes(local), width)
                weights = index.weights.of(hashes)
                plain = weights.tolist()
                fps = simhashes(hashes, weights, run - first, span)
                where, which = candidates(fps, index.blocks[size], len(items))
                near = np.flatnonzero(np.bitwise_count(fps[where] ^ index.fps[size][which]) <= radius)
                summed = np.r_[0, np.cumsum(weights, dtype=np.int64)]
                total = summed[run - first + span] - summed[run - first]
                more = sharing(place[first : upto - width + 1], weights, run - first, span, total, items, index.holders[size], least)
                pairs = np.unique(np.r_[where[near] * len(items) + which[near], more[0] * len(items) + more[1]])
                where, which = pairs // len(items), pairs % len(items)
                distance = np.bitwise_count(fps[where] ^ index.fps[size][which])
                for k, i, d in zip(where.tolist(), which.tolist(), distance.tolist(), strict=True):
                    item, a = items[i], int(run[k]) - first
                    s = similarity(item, local[a : a + size], plain[a : a + span])
                    if s >= least and s > best.get(item.item_id, {"similarity": 0.0})["similarity"]:
                        best[item.item_id] = {"item_id": item.item_id, "start_word": first + a, "n_words": size, "distance": d, "similarity": s}
    return [best[i] for i in sorted(best)]


TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())]))


def _matcher(index, radius: int, least: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = index.value
        return released(pa.array([matches(t.as_py(), own, radius, least) for t in texts], TYPE) for texts in batches)

    return F.arrow_udf(run, MATCH)("text")


def shared_weights(items: DataFrame, width: int = 5, most_shared: int = 50_000_000) -> Weights:
    """The weights of shingle hashes over all items, counted in one aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(_rolled(word_hashes(words_of(t.as_py())), width)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["hash"])

    counted = bounded(items).select("text").mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(counted, "shared")
    if (n := shared.count()) > most_shared:
        raise ValueError(f"{n} shingles are shared by several items: more than {most_shared}")
    held = shared.toArrow()
    return shingle_weights(held.column("hash").to_numpy().view(np.uint64), held.column("n").to_numpy())


def each_index(benchmark: DataFrame, radius: int, block_items: int) -> Iterator[tuple[int, Index]]:
    """The number of blocks, and the index of one block of items after another."""
    if not 0 <= radius < 64:
        raise ValueError(f"radius: {radius}")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    n = max(1, -(-items.count() // block_items))
    weights = shared_weights(items)
    for k in range(n):
        # by hash, so a block holds about block_items, whatever the number of items
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, build_index([tuple(r) for r in part.collect()], radius, weights=weights)


def found(docs: DataFrame, benchmark: DataFrame, radius: int, least: float, block_items: int) -> DataFrame:
    """(doc_id, th, matches) of the rows in which items are found: a row for each block of items; th tells texts apart."""
    spark = docs.sparkSession
    parts = []
    for n, index in each_index(benchmark, radius, block_items):
        sent = spark.sparkContext.broadcast(index)
        rows = bounded(docs).select("doc_id", F.xxhash64("text").alias("th"), _matcher(sent, radius, least).alias("matches")).filter(F.size("matches") > 0)
        parts.append(rows if n == 1 else materialize(rows, "matches"))
        if n > 1:
            sent.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, radius: int = 15, least: float = 0.8, block_items: int = 2000) -> DataFrame:
    """*docs* with `matches` added: for each item found in the text its best window."""
    rows = docs.select(packed(docs), "doc_id", "text", F.xxhash64("text").alias("th"))
    held = found(docs, benchmark, radius, least, block_items).groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"))
    held = held.withColumnsRenamed({"doc_id": "d", "th": "t"})
    joined = rows.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return unpacked(joined, docs.columns, {"matches": F.coalesce("matches", F.array().cast(MATCH))})


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 15, least: float = 0.8, block_items: int = 2000) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): one row for each document and item found in it.

    Rows that repeat a doc_id count as one document; the most similar window
    stands, of equal ones the first.
    """
    each = found(docs.select("doc_id", "text"), benchmark, radius, least, block_items).select("doc_id", F.inline("matches"))
    best = F.max_by(F.struct("start_word", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start_word"), -F.col("distance")))
    return each.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = 15, least: float = 0.8, block_items: int = 2000) -> DataFrame:
    """*docs* without the rows in which an item is found; the columns stay as they are.

    One block of items after another: each pass goes over the rows that the ones before have left.
    """
    spark = docs.sparkSession
    left = docs
    for n, index in each_index(benchmark, radius, block_items):
        sent = spark.sparkContext.broadcast(index)
        rows = bounded(left).select(packed(left), "text")
        kept = rows.filter(F.size(_matcher(sent, radius, least)) == 0).select("row.*")
        if n == 1:
            return kept
        before, left = left, materialize(kept, "clean")
        sent.unpersist()
        if before is not docs:
            discard(before)
    return left
