"""Alignment of two tokenizers over the same bytes: common cuts, overlap links, and how often an id pair is linked.

A is a byte-level BPE (a file of the `tokenizers` library) on a space and the text, B a BPE with byte fallback (a file of
`sentencepiece`, which puts the space itself) on the text. Both give tokens that tile the same bytes.

A task encodes whole texts in bounded pieces, cut at a single space between two other characters, where neither tokenizer
can have a token across. Ends of tokens are running sums of their lengths; ends that both have cut the text into groups,
and a repeat of each A token by the number of B tokens that it overlaps makes the links. Pairs are counted in two
exchanges, the first salted by the row. The counts go back to the rows in blocks of bounded size, one pass for each block.

Rows: null and empty texts, and texts whose tokens don't give back their bytes, have no tokens: zeros and ''. Repeated
rows are rows of their own and count each time; null ids stay; ties for a B id's highest count all are best. An empty table
gives an empty result; further columns don't matter. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import bounded, materialize, released
from tessera.llm.piece_dropout import read_model

#: How a byte-level vocabulary splits words before it merges: the fixed pattern of this kind of file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a piece, and bytes of the pieces that are aligned at once.
PIECE, CHUNK = 1 << 16, 1 << 21
#: Salts of the first exchange of the pair counts.
SALTS = 16
#: A link's key is its A id, shifted, and its B id.
SHIFT = 32
CUT = re.compile(r"(?<=\S) (?=\S)")
ROW = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Encoders(NamedTuple):
    #: Texts, each with its space in front, to ids.
    a: Callable[[list[str]], list[list[int]]]
    b: Callable[[list[str]], list[list[int]]]
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    #: Whether no token of B goes across a space between other characters.
    can_cut: bool


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(text: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """The encoder of a byte-level BPE file, and its tokens' bytes by id.

    Where ids rise in the order of the merges, the same merges are done by ranks, which is three times as fast. What that
    way can't do (it gives up on some extreme runs of white space), and other files, go through the file's own library.
    """
    held = json.loads(text)
    vocabulary, alphabet = held["model"]["vocab"], byte_alphabet()
    own = Tokenizer.from_str(text)
    own.encode_special_tokens = True
    special = {t["content"] for t in held.get("added_tokens", ())}
    of = {t: bytes(alphabet[c] for c in t) for t in vocabulary if t not in special}
    names = [b""] * (max(vocabulary.values()) + 1)
    for t, b in of.items():
        names[vocabulary[t]] = b

    def slow(texts: list[str]) -> list[list[int]]:
        return [own.encode(t, add_special_tokens=False).ids for t in texts]

    merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
    ids = [vocabulary[x + y] for x, y in merges]
    plain = held.get("normalizer") is None and held["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or ids != sorted(ids) or len(set(ids)) < len(ids) or held["model"].get("dropout"):
        return slow, names
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: vocabulary[t] for t, b in of.items()}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        found = []
        for t in texts:
            try:
                found.append(fast.encode_ordinary(t))
            except BaseException as e:
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                found += slow([t])
        return found

    return encode, names


def encoders(a_file: bytes, b_file: bytes) -> Encoders:
    a, a_bytes = byte_level(a_file.decode())
    model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Encoders(a, lambda texts: model.encode(texts, num_threads=1), a_bytes, b_bytes, not any("▁" in p.lstrip("▁") for p in pieces))


def pieces_of(text: str, size: int = PIECE) -> list[str]:
    """A space and *text* in pieces of about *size*, each with the space that stands before it."""
    found, at = [], 0
    text = " " + text
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        found.append(text[at : m.start()])
        at = m.start()
    return [*found, text[at:]]


class Aligned(NamedTuple):
    """Tokens of both sides of the texts aligned at once, and what is between them."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    n_groups: int


def align(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Groups and links of the ids *a* and *b*, whose tokens tile the same bytes; sizes are by id."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    first = np.searchsorted(b_end, a_end - a_size[a], side="right")
    n = np.searchsorted(b_end, a_end, side="left") - first + 1
    a_of = np.repeat(np.arange(len(a)), n)
    b_of = np.arange(len(a_of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return Aligned(a, b, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), a_of, b_of, len(cuts))


def spelled(x: Aligned, names: list[bytes]) -> list[bytes]:
    """The ids of both sides with what follows each (`,` `|` `;`), in the order of the groups: A's of a group, then B's."""

    def last(group):
        return np.append(group[1:] != group[:-1], True)

    codes = np.empty(len(x.a) + len(x.b), np.int64)
    codes[np.arange(len(x.a)) + np.searchsorted(x.b_group, x.a_group)] = 3 * x.a + last(x.a_group)
    codes[np.arange(len(x.b)) + np.searchsorted(x.a_group, x.b_group, side="right")] = 3 * x.b + 2 * last(x.b_group)
    return list(map(names.__getitem__, codes.tolist()))


class _Text:
    """What is known of one text so far."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.ok, self.sha, self.any = doc_id, True, hashlib.sha256(), False
        self.counts = np.zeros(4, np.int64)
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, counts: tuple, spelling: bytes, keys: np.ndarray) -> None:
        self.counts += counts
        self.sha.update((b";" if self.any else b"") + spelling[:-1])
        self.any = True
        pairs, times = np.unique(keys, return_counts=True)
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self) -> tuple:
        if not self.ok or not self.any:
            return (self.doc_id, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        pairs, times = self.pairs[0], self.times[0]
        if len(self.pairs) > 1:
            pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
            times = np.bincount(at, np.concatenate(self.times))
        return (self.doc_id, *self.counts.tolist(), self.sha.hexdigest(), pairs, times.astype(np.int32))


def _aligner(a_file, b_file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(a_file.value, b_file.value)
        a_size, b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (e.a_bytes, e.b_bytes))
        names = [b"%d%c" % (i, sep) for i in range(max(len(a_size), len(b_size))) for sep in b",|;"]

        def same_bytes(d: _Text, piece: str, x: list[int], y: list[int]) -> bool:
            d.ok = d.ok and b"".join(map(e.a_bytes.__getitem__, x)) == piece.encode() == b"".join(map(e.b_bytes.__getitem__, y))
            return d.ok

        def work(chunk: list[tuple[_Text, str]]) -> None:
            both = zip(chunk, e.a([p for _, p in chunk]), e.b([p[1:] for _, p in chunk]), strict=True)
            held = [(d, x, y) for (d, p), x, y in both if same_bytes(d, p, x, y)]
            if not held:
                return
            a, b = (np.concatenate([np.array(h[k], np.int64) for h in held]) for k in (1, 2))
            x = align(a, b, a_size, b_size)
            keys, text = (a[x.a_of] << SHIFT) | b[x.b_of], spelled(x, names)
            a_to, b_to = (np.cumsum([len(h[k]) for h in held]) for k in (1, 2))
            groups, links = x.a_group[a_to - 1] + 1, np.searchsorted(x.a_of, a_to)
            before = (0, 0, 0, 0)
            for (d, *_), *here in zip(held, a_to.tolist(), b_to.tolist(), groups.tolist(), links.tolist(), strict=True):
                d.add(tuple(np.subtract(here, before)), b"".join(text[before[0] + before[1] : here[0] + here[1]]), keys[before[3] : here[3]])
                before = here

        for batch in batches:
            texts, chunk, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                texts.append(d := _Text(doc_id))
                if not (text := text.as_py()):
                    continue
                for p in pieces_of(text) if e.can_cut else [" " + text]:
                    chunk.append((d, p))
                    size += len(p)
                    if size > CHUNK:
                        work(chunk)
                        chunk, size = [], 0
            work(chunk)
            rows = list(zip(*[d.row() for d in texts], strict=True))
            if rows:
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows[k])], dtype=np.int32), np.concatenate(rows[k])) for k in (6, 7)]
                ids = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(rows[k], pa.int64()) for k in range(1, 5)], pa.array(rows[5], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return lambda batches: released(run(batches))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ROW: what of each row of *docs* (doc_id, text) doesn't need the other rows; its id pairs with how many links hold each. A written table."""
    spark = docs.sparkSession
    files = [spark.sparkContext.broadcast(read_model(docs, p)) for p in (a_path, b_path)]  # vocabularies, some MB
    own = bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(_aligner(*files), ROW.partition(", ")[2])
    return materialize(own.select(F.monotonically_increasing_id().alias("row_id"), "*"), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best): links by id pair over all *rows* of aligned(), and whether no other pair of the B id has more."""
    each = rows.select(F.pmod("row_id", F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    part = each.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.times").alias("n"))
    counts = materialize(part.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # one row for each id of B's vocabulary
    most = F.broadcast(counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most")))
    return counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", F.shiftright("pair", SHIFT).alias("a_id"), "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _scorer(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = block.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = np.diff(lists.offsets.to_numpy())
            keys, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
            here = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            of = np.repeat(np.arange(batch.num_rows), sizes)[here]
            at, times = at[here], times[here].astype(np.int64)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], of, times * best[at])
            np.add.at(sums[1], of, times * n[at])
            keep = [batch.column(c) for c in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums[0]), pa.array(sums[1])], [x.partition(" ")[0] for x in SCORED.split(", ")])

    return run


SCORED = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def score(rows: DataFrame, counts: DataFrame, block_pairs: int = 2_000_000) -> DataFrame:
    """*rows* of aligned() with n_best (links of a pair that is best for its B id) and count_sum (of all links' counts).

    The counts are sent to the tasks in blocks of about *block_pairs* (17 bytes each); every block is a pass over the rows, of which a
    link's share is in one, and the passes are summed by row.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-counts.count() // block_pairs))
    found = []
    for k in range(blocks):
        t = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).select("pair", "n", "best").sort("pair").toArrow()
        block = spark.sparkContext.broadcast((t["pair"].to_numpy(), t["n"].to_numpy(), t["best"].to_numpy().astype(np.int64)))
        done = bounded(rows).mapInArrow(_scorer(block), SCORED)
        found.append(done if blocks == 1 else materialize(done, "scored"))
    if blocks == 1:
        return found[0].drop("row_id")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    firsts = [F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    return every.groupBy("row_id").agg(*firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row_id")


def best_matches(counts: DataFrame) -> DataFrame:
    """(b_id, a_ids, n): for each id of B the ids of A that it shares most links with: a map from one vocabulary to the other."""
    return counts.filter("best").groupBy("b_id").agg(F.sort_array(F.collect_list("a_id")).alias("a_ids"), F.max("n").alias("n"))


def cross_align(docs: DataFrame, a_path: str, b_path: str, block_pairs: int = 2_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row of *docs* (doc_id, text)."""
    rows = aligned(docs, a_path, b_path)
    return score(rows, materialize(pair_counts(rows), "counts"), block_pairs)
