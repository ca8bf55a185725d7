"""Line deduplication across documents.

Lines are exploded as hashes of their keys (the line stripped of white space at
both ends, A-Z lower-cased), the distinct documents of each hash are counted,
and lines of hashes over the threshold go from all documents but the one with
the least id. The remaining lines are put together again by position.

Only 16-byte hashes and ids are shuffled to count; a document's text is
shuffled once, to meet the hashes that it loses, and not at all where those
are few enough for the planner to broadcast. Counting keeps a minimum, a
maximum and, for thresholds over 2, distinct ids: a line that a third of all
documents share costs a row for each task. The join that finds the losing
documents is an equi-join that adaptive execution splits at such lines.

Defined results: an empty table gives an empty result; a null or empty text is one empty line (kept text: ''); rows
without a doc_id neither count nor lose lines; rows that repeat a doc_id count
as one document and lose the same lines; all columns are handed on, but that dedup_lines
replaces those named `n_lines`, `n_dropped` or `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, discard, materialize, packed, released, unpacked

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # of bytes: A-Z only


def key_length(key: bytes) -> int:
    """In code points."""
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def key_hashes(text: bytes | None, least: int) -> list[bytes | None]:
    """For each line the 128-bit hash of its key, or None where the key is too short."""
    digest = xxhash.xxh3_128_digest
    keys = map(line_key, (text or b"").split(b"\n"))
    return [digest(k) if len(k) >= least and key_length(k) >= least else None for k in keys]


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {h for h in key_hashes(text.as_py(), least) if h}
                ids.extend([doc] * len(own))
                hashes.extend(own)
                if len(ids) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "h"])
                    ids, hashes = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "h"])

    return lambda batches: released(run(batches))


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """(doc_id, lost): for each document that loses lines the hashes of their keys."""
    lines = materialize(
        bounded(docs).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(_explode(min_chars), "doc_id long, h binary"),
        "lines",
    )
    many = F.min("doc_id") < F.max("doc_id") if min_docs == 2 else F.count_distinct("doc_id") >= min_docs
    common = materialize(
        lines.groupBy("h").agg(F.min("doc_id").alias("first"), many.alias("many")).filter("many").select("h", "first"), "common"
    )
    lost = materialize(lines.join(common, "h").filter("doc_id <> first").groupBy("doc_id").agg(F.collect_set("h").alias("lost")), "lost")
    discard(lines, common)
    return lost


KEPT = "struct<n_lines: long, n_dropped: long, kept: string>"


def _reassemble(least: int):
    @F.arrow_udf(KEPT)
    def kept(texts: pa.Array, losts: pa.Array) -> pa.Array:
        n_lines, n_dropped, out = [], [], []
        for text, lost in zip(texts, losts, strict=True):
            whole = text.as_py() or b""
            n = whole.count(b"\n") + 1
            gone = 0
            if lost.is_valid:
                drop = set(lost.as_py())
                pairs = zip(whole.split(b"\n"), key_hashes(whole, least), strict=True)
                stay = [line for line, h in pairs if h is None or h not in drop]
                gone, whole = n - len(stay), b"\n".join(stay)
            n_lines.append(n)
            n_dropped.append(gone)
            out.append(whole)
        columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_lines", "n_dropped", "kept"])

    return kept


def _reassembled(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(row, result): each row of *docs* and the struct KEPT of its text."""
    lost = repeated_lines(docs, min_docs, min_chars).withColumnRenamed("doc_id", "d")
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("key"), F.col("text").cast("binary").alias("data"))
    joined = rows.join(lost, F.col("key") == F.col("d"), "left")
    return joined.select("row", _reassemble(min_chars)(F.col("data"), F.col("lost")).alias("result"))


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """*docs* with `n_lines`, `n_dropped` and `kept` (the remaining text) added."""
    return unpacked(_reassembled(docs, min_docs, min_chars), docs.columns, {x: F.col("result")[x] for x in ("n_lines", "n_dropped", "kept")})


def without_repeats(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """*docs* with the remaining text in place of the text; a column `n_chars` counts its characters, all others stay."""
    done = _reassembled(docs, min_docs, min_chars)
    text = {"text": F.col("result")["kept"], "n_chars": F.length(F.col("result")["kept"])}
    kinds = dict(docs.dtypes)
    return unpacked(done, docs.columns, {c: x.cast(kinds[c]) for c, x in text.items() if c in kinds})
