"""Near copies within lists of texts, by the edit distance of the shorter text to the windows of the longer one."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import discard, indexed, materialize

#: Length of the pieces that are looked up.
PIECE = 3
#: Characters of a segment (a machine word), those of a stretch of the longer text, and how many it shares with the next: no less than twice a segment.
SEGMENT, STRETCH, SHARED = 64, 1024, 128
#: Buckets of characters; segments and stretches that are read together; steps between two looks at the score.
BUCKETS, UNITS, STEP = 64, 8192, 2
#: The share of characters that are compared first: the rare ones.
RARE = 0.5
#: Texts and characters of a block of a list, pairs that a task takes together, and products of characters that make a task.
BLOCK, CHARS, PAIRS, WORK = 256, 1 << 18, 1 << 18, 1 << 36


def errors(m: int) -> int:
    """The most edits at which a text of *m* characters still is a near copy: fewer than a quarter."""
    return -(-m // 4) - 1


def piece_size(m: int) -> int:
    """Length of the pieces of a text of *m* characters: there are more of them than errors()."""
    return 2 if m == 5 else min(PIECE, m)


def codes(text: str, size: int) -> np.ndarray:
    """A number for each stretch of *size* characters, up to PIECE, by place; stretches of different sizes differ."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    n = max(0, len(c) - size + 1)
    out = np.zeros(n, np.int64)
    for k in range(PIECE):
        out = out << 21 | (c[k : k + n] if k < size else 0)
    return out


def pieces(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Pieces of *text* end to end, how often each stands there, and how many of them every near copy holds.

    Each edit changes one piece at most, so all but errors() of them stand unchanged in a near copy.
    """
    size = piece_size(len(text))
    found, n = np.unique(codes(text, size)[::size], return_counts=True) if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return found, n, max(1, int(n.sum()) - errors(len(text)))


def holds(short: str, long: str) -> bool:
    """Whether *long* has as many pieces of *short* as a near copy does."""
    own, n, need = pieces(short)
    return n[np.isin(own, codes(long, piece_size(len(short))))].sum() >= need


class Pattern:
    """A text to be found: bit-parallel columns of the edit distance, one step for each character that is read."""

    def __init__(self, text: str):
        self.m, self.mask, self.high, self.peq = len(text), (1 << len(text)) - 1, 1 << (len(text) - 1), {}
        for i, c in enumerate(text):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def _run(self, text: str, first: int) -> Iterator[int]:
        """The distance to what ends at each character: of some stretch (*first* 0) or of all from the start (1)."""
        vp, vn, score, mask, high, peq = self.mask, 0, self.m, self.mask, self.high, self.peq
        for c in text:
            eq = peq.get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | ~(d0 | vp) & mask, d0 & vp
            score += bool(hp & high) - bool(hn & high)
            hp, hn = (hp << 1 | first) & mask, hn << 1 & mask
            vp, vn = hn | ~(d0 | hp) & mask, hp & d0
            yield score

    def distance(self, text: str) -> int:
        last = self.m
        for last in self._run(text, 1):
            pass
        return last

    def near(self, text: str, most: int) -> bool:
        """Whether some window of *text*, as long as the pattern, is within *most* edits.

        Only windows whose end some stretch within *most* edits has are compared in full, the nearest ends first.
        """
        m = self.m
        ends = sorted((score, j) for j, score in enumerate(self._run(text, 0), 1) if score <= most and j >= m)
        return any(self.distance(text[j - m : j]) <= most for _, j in ends)


@lru_cache(256)
def pattern(text: str) -> Pattern:
    """Pairs of one short text mostly come together."""
    return Pattern(text)


def is_near(a: str, b: str) -> bool:
    """Whether the shorter text is within fewer edits than a quarter of its length of a window of the longer one."""
    short, long = (b, a) if len(a) > len(b) else (a, b)
    return bool(short) and (short in long or pattern(short).near(long, errors(len(short))))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of *counts*, end to end."""
    return np.arange(counts.sum()) - np.repeat(_starts(counts), counts)


class Texts:
    """Texts as their characters' buckets end to end, and where each bucket stands in each segment of 64 characters.

    Characters of one bucket pass for equal, so distances are lower bounds.
    """

    def __init__(self, bucket: np.ndarray, n: np.ndarray):
        self.n, self.at = n, _starts(n)
        self.codes = np.concatenate([bucket, np.zeros(STEP, np.int64)])  # 0 equals nothing
        self.segments = -(-n // SEGMENT)
        self.first = _starts(self.segments)
        self.size = np.minimum(SEGMENT, np.repeat(n, self.segments) - _spread(self.segments) * SEGMENT)
        self.peq = np.zeros(len(self.size) * BUCKETS, np.uint64)
        begin = np.repeat(self.at, self.segments) + _spread(self.segments) * SEGMENT
        row = np.arange(len(self.size)) * BUCKETS
        for k in range(int(self.size.max(initial=0))):
            some = np.flatnonzero(self.size > k)
            self.peq[row[some] + bucket[begin[some] + k]] |= np.uint64(1 << k)

    def least(self, segment: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each pair of a segment and a text: no more than the least distance of the segment to any stretch of the text.

        A stretch that is longer than two segments is no nearer than an empty one, so each part of the text that shares two
        segments with the next is read by itself.
        """
        parts = np.maximum(1, -(-(self.n[text] - SHARED) // (STRETCH - SHARED)))
        pair = np.repeat(np.arange(len(text)), parts)
        offset = _spread(parts) * (STRETCH - SHARED)
        steps = np.minimum(STRETCH, self.n[text][pair] - offset)
        found = np.empty(len(pair), np.int64)
        order = np.argsort(-(steps >> 5), kind="stable")  # units of about one length together
        for k in range(0, len(order), UNITS):
            some = order[k : k + UNITS]
            some = some[np.argsort(-steps[some], kind="stable")]
            found[some] = self._read(segment[pair[some]], self.at[text[pair[some]]] + offset[some], steps[some])
        return np.minimum.reduceat(found, _starts(parts)) if len(found) else found

    def _read(self, segment: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Columns of the edit distance for many segments at once, as in Pattern; the score is the sum of a column's bits, looked at every STEP characters.

        The last of them may be behind the text's end, which only makes the bound smaller.
        """
        one, size = np.uint64(1), self.size[segment]
        mask = np.uint64(2**64 - 1) >> (64 - size).astype(np.uint64)
        vp, vn, best = mask.copy(), np.zeros_like(mask), size.copy()
        at, base = at.copy(), segment * BUCKETS
        code = np.empty_like(at)
        eq, x, d, hp, hn = (np.empty_like(mask) for _ in range(5))
        up, down = np.empty(len(at), np.uint8), np.empty(len(at), np.uint8)
        for j in range(0, int(steps[0]), STEP):
            n = int(np.searchsorted(-steps, -j, "left"))  # those with more than j steps come first
            for _ in range(STEP):
                np.take(self.codes, at[:n], out=code[:n], mode="clip")
                code[:n] += base[:n]
                np.take(self.peq, code[:n], out=eq[:n], mode="clip")
                at[:n] += 1
                VP, VN, E, X, D, HP, HN = vp[:n], vn[:n], eq[:n], x[:n], d[:n], hp[:n], hn[:n]
                np.bitwise_and(E, VP, out=D)
                D += VP
                D ^= VP
                D |= E
                D |= VN
                np.bitwise_and(D, VP, out=HN)
                np.bitwise_or(D, VP, out=HP)
                np.invert(HP, out=HP)
                HP |= VN
                HP <<= one
                HN <<= one
                np.bitwise_and(HP, D, out=VN)
                np.bitwise_or(D, HP, out=X)
                np.invert(X, out=X)
                np.bitwise_or(HN, X, out=VP)
            np.bitwise_and(vp[:n], mask[:n], out=x[:n])
            np.bitwise_count(x[:n], out=up[:n])
            np.bitwise_and(vn[:n], mask[:n], out=x[:n])
            np.bitwise_count(x[:n], out=down[:n])
            np.minimum(best[:n], up[:n].astype(np.int64) - down[:n], out=best[:n])
        return np.maximum(0, best - STEP // 2)  # a character changes the score by one at most

    def above(self, short: np.ndarray, long: np.ndarray, most: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
        """Whether the distances of a text's segments sum up to more than *most*: then no stretch of *long* is that near to *short*.

        Segments are read by *shares*; pairs that are above already are not read on.
        """
        seen, sums, left = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64), np.arange(len(short))
        for share in shares:
            to = np.ceil(self.n[short[left]] * share / SEGMENT).astype(np.int64)
            more = to - seen[left]
            pair = np.repeat(left, more)
            np.add.at(sums, pair, self.least(self.first[short[pair]] + seen[pair] + _spread(more), long[pair]))
            seen[left] = to
            left = left[sums[left] <= most[left]]
        return sums > most


def possible(texts: list[str], group: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The pairs, by number, of a text *short* and one *long*, no shorter, of its group that may be near copies; no near copy is missed.

    First the texts are compared without their group's most frequent characters. To leave characters out of both texts takes no edit
    more, and rare ones tell texts apart by less work: half the characters are a quarter of it.
    """
    n = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bucket = points.astype(np.int64) % (BUCKETS - 1) + 1
    by = np.repeat(group, n)
    counts = np.bincount(by * BUCKETS + bucket, minlength=(int(group.max(initial=0)) + 1) * BUCKETS).reshape(-1, BUCKETS)
    order = np.argsort(-counts, axis=1, kind="stable")
    frequent = np.empty(counts.shape, bool)
    np.put_along_axis(frequent, order, np.cumsum(np.take_along_axis(counts, order, 1), axis=1) <= (1 - RARE) * counts.sum(axis=1, keepdims=True), 1)
    rare = ~frequent[by, bucket]
    few = np.bincount(np.repeat(np.arange(len(n)), n), weights=rare, minlength=len(n)).astype(np.int64)
    most = -(-n // 4) - 1
    left = np.flatnonzero(~Texts(bucket[rare], few).above(short, long, most[short], (0.75, 1.0)))
    return left[~Texts(bucket, n).above(short[left], long[left], most[short[left]], (0.5, 0.75, 1.0))] if len(left) else left


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near copies in groups (_by, _p, _q), which come one after another: texts of block _p and those of block _q, or all of one block."""

    def compared(texts: list[tuple[int, str]], group: list[int], pairs: list[np.ndarray]) -> pa.RecordBatch:
        s, l = np.concatenate(pairs, axis=1)  # noqa: E741
        left = possible([t for _, t in texts], np.array(group), s, l)
        both = (texts[s[k]] + texts[l[k]] for k in left)
        near = [sorted((i, j)) for i, x, j, y in both if holds(x, y) and is_near(x, y)]
        a, b = np.array(near, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("_by", "_p", "_q", "_block", "_i", "_t")), strict=True))
    texts, group, pairs, chars = [], [], [], 0
    for g, ((_, p, q), own) in enumerate(itertools.groupby(rows, lambda r: r[:3])):
        own = sorted((r[3:] for r in own), key=lambda r: len(r[2]))
        s, l = np.triu_indices(len(own), 1)  # noqa: E741
        if p != q:
            block = np.array([r[0] for r in own])
            s, l = s[block[s] != block[l]], l[block[s] != block[l]]  # noqa: E741
        pairs.append(np.stack([s, l]) + len(texts))
        texts += [r[1:] for r in own]
        group += [g] * len(own)
        chars += sum(len(r[2]) for r in own)
        if sum(x.shape[1] for x in pairs) >= PAIRS or chars >= 4 * CHARS:
            yield compared(texts, [x - group[0] for x in group], pairs)
            texts, group, pairs, chars = [], [], [], 0
    if texts:
        yield compared(texts, [x - group[0] for x in group], pairs)


def near_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: the near copies among *texts* (_i, _by, _t) of the same _by.

    A list is dealt in blocks by its number of texts and of characters, and each pair of blocks is a group, so a task holds two blocks however
    long a list is. Nothing but texts is sent: each as often as its list has blocks, mostly once.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("chars") / CHARS)))
    sizes = texts.groupBy("_by").agg(F.count("*").alias("n"), F.sum(F.length("_t")).alias("chars")).filter("n > 1")
    sizes = materialize(sizes.select("_by", "chars", blocks.cast("long").alias("_n")), "sizes")
    # comparing costs far more than reading, so tasks are cut by the work, not by bytes
    work = sizes.agg(F.sum(F.col("chars").cast("double") * F.col("chars"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(work // WORK))
    each = texts.join(sizes.drop("chars"), "_by").withColumn("_block", F.pmod(F.xxhash64("_i"), "_n")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    each = each.select("_by", F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q"), "_block", "_i", "_t")
    key = ["_by", "_p", "_q"]
    near = each.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(_near, "a long, b long")
    out = materialize(near, "near")
    discard(sizes)
    return out


def dropped(pairs: DataFrame) -> DataFrame:
    """(b): the rows that go when, in order, each row stays if no earlier row that stays is its pair (a, b), a < b.

    Each round settles all rows that no open earlier row is paired with: they stay, and their pairs go. Rounds are as many as the longest
    chain of rows that wait for one another.
    """
    gone = []
    left = materialize(pairs, "open")
    while not left.isEmpty():
        stay = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        go = materialize(left.join(stay, "a", "left_semi").select("b").distinct(), "gone")
        gone.append(go)
        rest = left.join(go, "b", "left_anti").join(go.select(F.col("b").alias("a")), "a", "left_anti")
        before, left = left, materialize(rest, "open")
        discard(before)
    out = pairs.select("b").limit(0)
    for go in gone:
        out = out.unionByName(go)
    return out


def fuzzy_distinct(df: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The rows of *df* that stay when each list (*by*) is read in *order* and a row goes if an earlier one that stays is its near copy.

    A near copy: the shorter text is at an edit distance below a quarter of its length from a window, as long as itself, of the longer
    one. Rows without text go, empty texts all stay; of rows that tie in *order* any comes first. The lists
    are meant to be of hundreds of texts: at this distance texts of one language share most of their pieces, so all pairs within a list are compared.
    """
    _by = F.xxhash64(*by) if by else F.lit(0).cast("long")
    rows = indexed(df.filter(F.col(text).isNotNull()).withColumn("_by", _by), [*([] if not by else ["_by"]), *order], "_i")
    firsts = materialize(rows.filter(F.col(text) != "").groupBy("_by", F.col(text).alias("_t")).agg(F.min("_i").alias("_i")), "texts")
    pairs = near_pairs(firsts)
    stay = firsts.select("_i").join(dropped(pairs), F.col("_i") == F.col("b"), "left_anti")
    kept = rows.join(stay.withColumn("_kept", F.lit(True)), "_i", "left").filter(F.col("_kept") | (F.col(text) == ""))
    return kept.select(*df.columns)
