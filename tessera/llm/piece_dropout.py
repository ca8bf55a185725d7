"""SentencePiece (BPE, byte fallback) encoding with seeded merge-dropout, and decoding.

Encoding works off an agenda of merges: of the adjacent pairs whose union is a
piece the one with the best score (then the leftmost) is merged, and again.
With dropout each candidate merge, known by its occurrence and the places where its
two parts begin and end, is skipped if a keyed hash of it falls below `alpha`.
The hash takes a seed, the document and the unit's number in it, so each
occurrence has its own draws and each run gives the same ids. A skip matters only to
merges that are carried out: a task remembers a unit's merges and ids without a skip, and those with
one merge skipped, and uses them for the occurrences whose draws skip no other of these merges.
The rest is worked off for each occurrence. With `alpha` 0 the ids are those of the library's encoder.

A unit is a run of spaces with the word behind it. No piece of the model may
hold a space mark behind another character, so no merge crosses units. Units of
up to 48 symbols are worked off together in matrices, longer ones (a text without
white space) one by one with a heap, in n log n steps; both give the same ids.

Decoding is lossless for every text: characters that are no piece, and the
space mark itself where a text holds it, are bytes.

Defined results: an empty table gives an empty result; a null or empty text has no ids and decodes to ''; a null key
counts as 0; all columns are handed on, but that those named `ids` and `lossless` are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, packed, release_memory, unpacked

MARK = "▁"
UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Symbols of the longest unit that is worked off in a matrix.
WIDE = 48
#: Units that a task remembers, and units it looks at together: they bound its memory.
REMEMBERED, TOGETHER = 200_000, 50_000
#: Units that a worker keeps from one task to the next, those met most often.
KEPT = 30_000
#: How often a unit is met before its ids with one merge skipped are remembered.
OFTEN = 16
NO = np.int32(2**31 - 1)


class Characters(dict):
    """Ids of characters; those without a piece, and the mark itself, are -2 - code point."""

    def __missing__(self, c: str) -> int:
        return -2 - ord(c)


class Vocabulary(NamedTuple):
    char_id: Characters
    char_table: np.ndarray  # the same by code point
    pair_key: np.ndarray  # left * 2^32 + right, sorted
    pair_rank: np.ndarray
    pair_id: np.ndarray
    byte_id: np.ndarray
    raw: pa.Array  # the bytes that each id stands for
    pairs: dict[tuple[int, int], tuple[int, int]]


def vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    of = {p: i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok}
    if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in of):
        raise ValueError("a piece crosses units")
    byte_id = np.zeros(256, np.int32)
    raw = []
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
        raw.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b"")
    score = {i: sp.get_score(i) for i in of.values()}
    rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    pairs = {
        (of[p[:k]], of[p[k:]]): (rank[score[i]], i) for p, i in of.items() for k in range(1, len(p)) if p[:k] in of and p[k:] in of
    }
    keys = np.array([a << 32 | b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    ranks, ids = (np.array([v[j] for v in pairs.values()], np.int32)[order] for j in (0, 1))
    chars = Characters({" " if p == MARK else p: i for p, i in of.items() if len(p) == 1})
    table = -2 - np.arange(0x110000, dtype=np.int32)
    table[[ord(c) for c in chars]] = list(chars.values())
    return Vocabulary(chars, table, keys[order], ranks, ids, byte_id, pa.array(raw, pa.binary()), pairs)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, alpha: float) -> np.ndarray:
    """Whether the candidate merges of the parts [start, mid) and [mid, end) of units of these keys are skipped."""
    place = (start.astype(np.uint64) << np.uint64(42)) ^ (mid.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    with np.errstate(over="ignore"):
        draw = _mix(_mix(key ^ (place * np.uint64(0x9E3779B97F4A7C15))) + place)
    return (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 < alpha


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of *n* numbers for each of *first*, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Encoder:
    """Encodes units; for tasks, which keep one for each model and setting. *variants* limits nothing: it is taken for older callers.

    It remembers *remembered* units, or REMEMBERED: that bounds its memory and changes no result.
    """

    def __init__(self, model: bytes, alpha: float, seed: int, variants: int = 0, remembered: int | None = None):
        self.v = vocabulary(model)
        self.remembered = remembered
        self.alpha, self.seed = alpha, seed
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.met: set[str] = set()  # units met once, which are not remembered yet
        self.units: list[str] = []
        self.hits = np.zeros(1024, np.int64)  # by unit
        self.base = np.zeros(1024, np.int64)  # by unit: its slot without a skip; that with its merge j skipped is 1 + j behind
        self.slots = 0
        self.first = np.full(4096, -1, np.int64)  # by slot: where its ids begin, and its merges
        self.count, self.merge_first, self.merge_count = (np.zeros(4096, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.merge_pool, self.merge_used = np.zeros(1 << 16, np.int64), 0

    @property
    def limit(self) -> int:
        return self.remembered or REMEMBERED

    def make_room(self, most: int | None = None) -> None:
        """Forget all but the *most* units met most often, or all but half of the limit."""
        most = self.limit // 2 if most is None else most
        often = np.argsort(-self.hits[: len(self.units)], kind="stable")[:most]
        kept = np.sort(often[self.hits[often] > 1])
        units, hits, base, first, count, pool = self.units, self.hits, self.base, self.first, self.count, self.pool
        merge_first, merge_count, merge_pool = self.merge_first, self.merge_count, self.merge_pool
        self.forget()
        self.units = [units[i] for i in kept.tolist()]
        self.place = {u: i for i, u in enumerate(self.units)}
        n = 1 + merge_count[base[kept]]
        self.allot(0, n)
        self.hits[: len(kept)] = hits[kept] // 2  # what was met long ago counts less
        slots = ranges(base[kept], n)
        known = np.flatnonzero(first[slots] >= 0)
        old = slots[known]
        self.store(known, count[old], pool[ranges(first[old], count[old])], merge_count[old], merge_pool[ranges(merge_first[old], merge_count[old])])

    def allot(self, start: int, n: np.ndarray) -> None:
        """*n* slots for each of the units from *start* on."""
        while len(self.units) > len(self.base):
            self.base, self.hits = (np.r_[x, np.zeros(len(x), np.int64)] for x in (self.base, self.hits))
        self.base[start : start + len(n)] = self.slots + np.cumsum(n) - n
        self.slots += int(n.sum())
        while self.slots > len(self.first):
            self.first = np.r_[self.first, np.full(len(self.first), -1, np.int64)]
            self.count, self.merge_first, self.merge_count = (np.r_[x, np.zeros(len(x), np.int64)] for x in (self.count, self.merge_first, self.merge_count))

    def symbols(self, unit: str) -> list[int]:
        return list(map(self.v.char_id.__getitem__, unit))

    def flat(self, ids: list[int]) -> list[int]:
        if min(ids, default=0) >= 0:
            return ids
        out: list[int] = []
        for i in ids:
            out += [i] if i >= 0 else self.v.byte_id[list(chr(-2 - i).encode("utf-8", "surrogatepass"))].tolist()
        return out

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the unions of pairs; rank NO where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.v.pair_key, key), len(self.v.pair_key) - 1)
        hit = (self.v.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.v.pair_rank[at], NO), self.v.pair_id[at]

    def encode_long(self, unit: str, key: int) -> list[int]:
        ids = self.symbols(unit)
        n = len(ids)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []
        big = np.array([key], np.uint64)

        def push(i: int, j: int) -> None:
            found = self.v.pairs.get((ids[i], ids[j])) if i >= 0 and j < n else None
            if found and not (self.alpha > 0 and skipped(big, np.array([i]), np.array([j]), np.array([end[j]]), self.alpha)[0]):
                heapq.heappush(heap, (found[0], i, j, end[j], found[1]))

        for i in range(n - 1):
            push(i, i + 1)
        alive = [True] * n
        while heap:
            _, i, j, upto, new = heapq.heappop(heap)
            if not (alive[i] and alive[j] and end[i] == j and end[j] == upto):
                continue
            ids[i], end[i], alive[j] = new, upto, False
            if upto < n:
                before[upto] = i
                push(i, upto)
            push(before[i], i)
        return self.flat([x for x, a in zip(ids, alive, strict=True) if a])

    def encode_matrix(
        self, units: list[str], keys: np.ndarray | None, banned: np.ndarray | None = None, trace: list[tuple[np.ndarray, np.ndarray]] | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Units of at most WIDE symbols, all at once: places in *units*, how many ids each has, and these.

        Skipped are the merges that *keys* draw, or the one of *banned* for each unit. *trace* gets the merges in order.
        """

        def drops(r: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
            return skipped(keys[r], a, b, c, self.alpha) if banned is None else (a << 42 | b << 21 | c) == banned[r]

        draws = banned is not None or keys is not None and self.alpha > 0
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        width = int(sizes.max())
        ids = np.full((len(units), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < sizes[:, None]] = self.v.char_table[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.broadcast_to(np.arange(width + 2, dtype=np.int64), (len(units), width + 2)).copy()
        np.minimum(start, sizes[:, None], out=start)
        who = np.arange(len(units))
        rank, new = self.merges(ids[:, :-1], ids[:, 1:])
        if draws:
            r, c = np.nonzero(rank != NO)
            drop = drops(r, start[r, c], start[r, c + 1], start[r, c + 2])
            rank[r[drop], c[drop]] = NO
        while True:
            best = rank.argmin(axis=1) if width else np.zeros(len(who), np.int64)
            done = rank[np.arange(len(who)), best] == NO
            if done.any():
                mine, n = ids[done], sizes[done]
                whole = mine[np.arange(width + 1) < n[:, None]]
                if (whole < 0).any():  # characters without a piece become bytes
                    flat = [self.flat(row[:k]) for row, k in zip(mine.tolist(), n.tolist(), strict=True)]
                    n, whole = np.array([len(x) for x in flat]), np.array(list(itertools.chain.from_iterable(flat)), np.int32)
                yield who[done], n, whole
            if done.all():
                return
            go = ~done
            who, ids, start, rank, new, sizes, best = who[go], ids[go], start[go], rank[go], new[go], sizes[go], best[go]
            at = np.arange(len(who))
            if trace is not None:
                trace.append((who, start[at, best] << 42 | start[at, best + 1] << 21 | start[at, best + 2]))
            ids[at, best] = new[at, best]
            gone = np.arange(width) > best[:, None]  # what lies right of the merged pair moves one place to the left
            ids[:, :-1] = np.where(gone, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            start[:, :-1] = np.where(np.arange(width + 1) > best[:, None], start[:, 1:], start[:, :-1])
            rank[:, :-1] = np.where(gone[:, :-1], rank[:, 1:], rank[:, :-1])
            new[:, :-1] = np.where(gone[:, :-1], new[:, 1:], new[:, :-1])
            rank[:, -1] = NO
            sizes = sizes - 1
            for c, ok in ((best, np.ones(len(at), bool)), (best - 1, best > 0)):
                r, c = at[ok], c[ok]
                k, i = self.merges(ids[r, c], ids[r, c + 1])
                if draws:
                    k = np.where((k != NO) & drops(who[r], start[r, c], start[r, c + 1], start[r, c + 2]), NO, k)
                rank[r, c], new[r, c] = k, i

    def in_matrices(self, units: list[str], keys: np.ndarray | None = None, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each unit has, all ids, and the same of the merges (none where *keys* are given)."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        n, n_merges = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        who_of, ids_of, merging, merges = ([np.zeros(0, np.int64)] for _ in range(4))
        low = 0
        for width in (6, 10, 16, 24, WIDE):
            pick = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for a in range(0, len(pick), 20_000):
                part = pick[a : a + 20_000]
                trace: list | None = [] if keys is None else None
                for who, count, ids in self.encode_matrix([units[i] for i in part.tolist()], None if keys is None else keys[part], None if banned is None else banned[part], trace):
                    n[part[who]] = count
                    who_of.append(np.repeat(part[who], count))
                    ids_of.append(ids)
                for who, place in trace or ():
                    merging.append(part[who])
                    merges.append(place)
        for i in np.flatnonzero(sizes > WIDE).tolist():
            ids = np.array(self.encode_long(units[i], int(keys[i]) if keys is not None else 0), np.int64)
            n[i] = len(ids)
            who_of.append(np.full(len(ids), i))
            ids_of.append(ids)
        who, merged = np.concatenate(who_of), np.concatenate(merging)
        n_merges += np.bincount(merged, minlength=len(units))
        return n, np.concatenate(ids_of)[np.argsort(who, kind="stable")].astype(np.int32), n_merges, np.concatenate(merges)[np.argsort(merged, kind="stable")]

    def store(self, at: np.ndarray, n: np.ndarray, ids: np.ndarray, n_merges: np.ndarray, merges: np.ndarray) -> None:
        self.write(ids)
        while self.merge_used + len(merges) > len(self.merge_pool):
            self.merge_pool = np.r_[self.merge_pool, np.zeros(len(self.merge_pool), np.int64)]
        self.merge_pool[self.merge_used : self.merge_used + len(merges)] = merges
        self.first[at], self.count[at] = self.used + np.cumsum(n) - n, n
        self.merge_first[at], self.merge_count[at] = self.merge_used + np.cumsum(n_merges) - n_merges, n_merges
        self.used += len(ids)
        self.merge_used += len(merges)

    def write(self, ids: np.ndarray) -> None:
        """Put *ids* behind the pool's end."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), np.int32)]
        self.pool[self.used : self.used + len(ids)] = ids

    def first_skips(self, slot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which occurrences skip a merge of their slot, and the number of the first one."""
        n = self.merge_count[slot]
        place = self.merge_pool[ranges(self.merge_first[slot], n)]
        low = (1 << 21) - 1
        hit = np.flatnonzero(skipped(np.repeat(keys, n), place >> 42, place >> 21 & low, place & low, self.alpha))
        who = np.repeat(np.arange(len(slot)), n)[hit]
        lead = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
        return who[lead], hit[lead] - (np.cumsum(n) - n)[who[lead]]

    def together(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of *units* one after another, and how many each has; *keys* are those of the occurrences' draws."""
        limit = self.limit
        if len(self.place) > limit or len(self.met) > limit or self.used > 32 * limit or self.merge_used > 32 * limit:
            self.make_room()
        index = np.fromiter(map(self.place.get, units, itertools.repeat(-1)), np.int64, len(units))
        known = len(self.units)
        for i in np.flatnonzero(index < 0).tolist():
            u = units[i]
            if len(u) > WIDE:
                continue
            if u not in self.place:
                if u not in self.met:
                    self.met.add(u)
                    continue
                self.met.discard(u)
                self.place[u] = len(self.units)
                self.units.append(u)
            index[i] = self.place[u]
        if len(self.units) > known:
            n, ids, n_merges, merges = self.in_matrices(self.units[known:])
            self.allot(known, 1 + n_merges)
            self.store(self.base[known : len(self.units)], n, ids, n_merges, merges)
        short = np.flatnonzero(index >= 0)
        self.hits += np.bincount(index[short], minlength=len(self.hits))
        slot = np.full(len(units), -1, np.int64)
        slot[short] = self.base[index[short]]
        if self.alpha > 0:
            who, j = self.first_skips(slot[short], keys[short])
            once = short[who]
            often = self.hits[index[once]] >= OFTEN
            slot[once[~often]] = -1
            once, j = once[often], j[often]
            skip = self.merge_pool[self.merge_first[slot[once]] + j]
            slot[once] += 1 + j
            missing, lead = np.unique(slot[once], return_index=True)
            lead = lead[self.first[missing] < 0]
            missing = missing[self.first[missing] < 0]
            if len(missing):
                self.store(missing, *self.in_matrices([units[i] for i in once[lead].tolist()], None, skip[lead]))
            more, _ = self.first_skips(slot[once], keys[once])
            slot[once[more]] = -1
        own = np.flatnonzero(slot < 0)
        first, count = self.first[slot], self.count[slot]
        if len(own):  # for these occurrences alone: behind the pool's end
            n, ids, _, _ = self.in_matrices([units[i] for i in own.tolist()], keys[own])
            self.write(ids)
            first[own], count[own] = self.used + np.cumsum(n) - n, n
        return self.pool[ranges(first, count)], count

    def encode(self, texts: list[str | None], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of *texts* one after another, and how many each text has."""
        ids: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        units: list[str] = []
        spans: list[tuple[int, int, int]] = []  # text, units of it in this go, units of it before

        def go() -> None:
            doc = np.fromiter((docs[t] or 0 for t, _, _ in spans), np.int64, len(spans)).view(np.uint64)
            n = np.array([s[1] for s in spans])
            ordinal = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat([s[2] for s in spans], n)
            with np.errstate(over="ignore"):
                seed = _mix(np.array([self.seed & (2**64 - 1)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                keys = _mix(_mix(np.repeat(_mix(doc + seed), n)) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            got, count = self.together(units, keys)
            np.add.at(sizes, np.repeat([s[0] for s in spans], n), count)
            ids.append(got)
            units.clear()
            spans.clear()

        for t, text in enumerate(texts):
            if not text:
                continue
            found = UNIT.finditer(" " + text) if len(text) > 1 << 20 else None
            before = 0
            while True:
                part = UNIT.findall(" " + text) if found is None else [m.group() for m in itertools.islice(found, TOGETHER)]
                if part:
                    units += part
                    spans.append((t, len(part), before))
                    before += len(part)
                if len(units) >= TOGETHER:
                    go()
                if found is None or not part:
                    break
        if units:
            go()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts, without the space that encoding puts in front."""
        taken = self.v.raw.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = memoryview(taken.buffers()[2] or b"") if len(ids) else memoryview(b"")
        ends = np.cumsum(sizes)
        return [bytes(data[int(offsets[b - n]) + (n > 0) : int(offsets[b])]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: bytes, alpha: float, seed: int, remembered: int | None = None) -> Encoder:
    key = (xxhash.xxh3_64_intdigest(model), alpha, seed, remembered)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, alpha, seed, remembered=remembered)
    return _ENCODERS[key]


ENCODED = "struct<ids: array<int>, lossless: boolean>"


def read_model(df: DataFrame, path: str) -> bytes:
    """The model file, by Spark's reader: it can be in any store. A model is of bounded size (some MB at most)."""
    return bytes(df.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model_path: str, alpha: float = 0.1, seed: int = 1, variants: int = 4, key: str = "doc_id", text: str = "text", remembered: int | None = None) -> DataFrame:
    """*docs* with `ids` and `lossless` (whether they decode to the text) added; *variants* limits nothing: it is taken for older callers.

    A task remembers *remembered* units (REMEMBERED by default, some 300 MB): fewer take less memory and more time, for equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(docs, model_path))

    def batch(own: Encoder, keys: pa.Array, texts: pa.Array) -> pa.Array:
        out, good = [], []
        at = 0
        sizes_of = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        while at < len(texts):  # a few MB of text at a time
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes_of[at:]), 2_000_000, side="right")) + at)
            part = texts[at:upto].to_pylist()
            ids, sizes = own.encode(part, keys[at:upto].to_pylist())
            back = own.decode(ids, sizes)
            good += [b == (p or "").encode("utf-8", "surrogatepass") for b, p in zip(back, part, strict=True)]
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids)))
            at = upto
        lists = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(good, pa.bool_())], ["ids", "lossless"])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = encoder(model.value, alpha, seed, remembered)
        try:
            for keys, texts in batches:
                yield batch(own, keys, texts)
        finally:  # the worker may idle or run other operators next
            own.make_room(min(KEPT, own.limit // 8))
            release_memory()

    done = bounded(docs).select(packed(docs), F.arrow_udf(run, ENCODED)(docs[key].cast("long"), docs[text]).alias("encoded"))
    return unpacked(done, docs.columns, {"ids": F.col("encoded.ids"), "lossless": F.col("encoded.lossless")})


def decoded(ids: Column, df: DataFrame, model_path: str) -> Column:
    """The text of a column of ids; null ids give ''."""
    model = df.sparkSession.sparkContext.broadcast(read_model(df, model_path))

    def run(lists: pa.Array) -> pa.Array:
        own = encoder(model.value, 0.0, 0)
        rows = [np.asarray(x.as_py() or [], np.int32) for x in lists]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.array(own.decode(flat, np.array([len(r) for r in rows], np.int64)), pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string")(ids)
