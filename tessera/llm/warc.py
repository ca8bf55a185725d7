"""WARC archives: writing pages, and reading by boundary-chain verification.

Writing: one uncompressed WARC/1.1 record for each page. Of pages with equal
payloads of at least `least` bytes, the one with the largest page_id is written
as a response and the others as revisits that refer to it.

Reading: Spark splits the archives at the record magic, so that archives of any
size are read in blocks. Each task emits the candidate records of its block with
the offset of their successor (header length + Content-Length). Inside a
block chains are followed at once; across blocks pointer jumping from the start
of the file finds where the true chain enters each block, in as many rounds as
the logarithm of a file's blocks. Only candidates that the chain reaches are
records: the magic inside a payload starts none. Payloads that hold the
magic lie in several fragments; these alone are read again and put together.

Defined results: an empty table gives an empty result; a null html is an empty payload; a null page_id is written
without a number and read back as null, and ranks below all others; pages that
repeat the largest page_id of a payload are all responses; control characters
and spaces in a url are written as %20, and urls may be of any length. A file whose chain doesn't end
at the file's own end is damaged: reading raises ValueError, or, with `resume`, goes on at the next
candidate whose successor is a candidate or the file's end, and leaves out records whose own end is none of these.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded, discard, materialize, scratch_path

MAGIC = "WARC/1."
SEPARATOR = "\r\n\r\n" + MAGIC
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(digest, response_id): payloads of at least *least* bytes that several page_ids share."""
    # text sizes and digests only: the html doesn't leave its task
    return materialize(
        pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
        .filter(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("least_id"))
        .filter(F.col("response_id") != F.col("least_id"))
        .select("digest", "response_id"),
        "revisits",
    )


def write_warc(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write *pages* (page_id, url, html) as WARC files, one for each task, to the folder *path*."""
    shared = revisits(pages, least)
    end = "\r\n"
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("body"), F.sha1(body.cast("binary")).alias("_digest"), F.octet_length(body).alias("n"))
    rows = rows.join(shared, (F.col("_digest") == F.col("digest")) & (F.col("n") >= least), "left")
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("n").cast("string"), F.lit(end * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    record = F.concat(
        F.lit(f"{MAGIC}1{end}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{end}Content-Length: "), F.octet_length(block).cast("string"), F.lit(f"{end}Content-Type: application/http;msgtype=response"),
        F.lit(f"{end}WARC-Record-ID: <{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{end}WARC-Date: {date}{end}WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(again, F.concat(F.lit(f"{end}WARC-Profile: {PROFILE}{end}WARC-Refers-To: <{URN}"), F.col("response_id").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{end}WARC-Target-URI: "), uri, F.lit(end * 2), block, F.lit(end + "\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


CANDIDATE = (
    "file string, block long, rel long, upto long, exit long, total long, type string, page_id long, refers_to long, uri string, "
    "digest string, http_bytes long, payload_bytes long, payload_digest string, complete boolean"
)
NAMES = [x.split(" ")[0] for x in CANDIDATE.split(", ")]


def _number(value: bytes | None) -> int | None:
    """The number of `<urn:page:7>`, or of plain digits."""
    digits = (value or b"").strip(b"<>").removeprefix(URN.encode())
    return int(digits) if digits.lstrip(b"-").isdigit() else None


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """What follows the HTTP headers, and the length that these state."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return block, None
    stated = [line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return payload, _number(stated[0]) if stated else None


def parse(fragment: bytes) -> dict:
    """A candidate record: *fragment* is what follows the magic up to the next one."""
    head, sep, rest = fragment.partition(b"\r\n\r\n")
    out: dict = dict.fromkeys(NAMES[5:])
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    size = _number(fields.get(b"content-length"))
    if size is None or size < 0 or b"warc-type" not in fields:
        return out
    out |= {
        "total": len(MAGIC) + len(head) + 4 + size + 4, "type": fields[b"warc-type"].decode("utf-8", "replace"),
        "page_id": _number(fields.get(b"warc-record-id")), "refers_to": _number(fields.get(b"warc-refers-to")),
        "uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "digest": fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace"),
    }
    if complete := len(rest) >= size and (bool(sep) or not size):
        payload, out["http_bytes"] = payload_of(rest[:size])
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
    return out | {"complete": complete}


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, bytes]]:
    """(file, block), where the record starts in the block, where the next fragment starts, the bytes after the magic."""
    at, key = 0, None
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for file, block, value in zip(files, blocks, batch.column(2), strict=True):
            if (file, block) != key:
                key, at = (file, block), 0
            data = value.as_py()
            upto = at + len(data) + len(SEPARATOR)
            first = block == 0 and at == 0 and data.startswith(MAGIC.encode())
            yield key, (0 if first else at - len(MAGIC)), upto, data[len(MAGIC) :] if first else data
            at = upto


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []

    def done() -> pa.RecordBatch:
        place = {r["rel"]: i for i, r in enumerate(rows)}
        for r in reversed(rows):
            follow = r["rel"] + r["total"] if r["total"] is not None else None
            i = place.get(follow)
            r["exit"] = rows[i]["exit"] if i is not None else follow
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)

    for key, rel, upto, data in _fragments(batches):
        if rows and (rows[0]["file"], rows[0]["block"]) != key:
            yield done()
            rows = []
        rows.append(parse(data) | {"file": key[0], "block": key[1], "rel": rel, "upto": upto})
    if rows:
        yield done()


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
ARROW = pa.schema([(x.split(" ")[0], _TYPES[x.split(" ")[1]]) for x in CANDIDATE.split(", ")])


def _raw(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    return bounded(lines).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))


def entries(placed: DataFrame, begun: DataFrame) -> DataFrame:
    """(file, start): where the chains from *begun* (file, start) enter blocks, these places among them, by pointer jumping.

    *placed* has `file`, `start` and `exit`: the place beyond its block where a candidate's chain goes on.
    """
    step = placed.select("file", "start", "exit")
    goals = step.select("file", F.col("exit").alias("start")).unionByName(begun).distinct()
    jump = materialize(step.join(goals, ["file", "start"], "left_semi"), "jump")
    reached = materialize(jump.join(begun, ["file", "start"], "left_semi").select("file", "start"), "reached")
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        more = ahead.join(jump.select("file", "start"), ["file", "start"], "left_semi")
        before, reached = reached, materialize(reached.unionByName(more).distinct(), "reached")
        now = reached.count()
        discard(before)
        if now == n:
            discard(jump)
            return reached
        n = now
        onward = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond"))
        before, jump = jump, materialize(jump.join(onward, ["file", "exit"], "left").select("file", "start", F.coalesce("beyond", "exit").alias("exit")), "jump")
        discard(before)


def _follow(table: pa.Table) -> pa.Table:
    """The candidates of one block with `reached`, and `owner`: the start of the reached record that holds each."""
    order = np.argsort(table.column("start").to_numpy())
    table = table.take(pa.array(order))
    start = table.column("start").to_numpy()
    total = table.column("total").to_pylist()
    place = {int(s): i for i, s in enumerate(start)}
    reached = np.zeros(len(start), bool)
    for i in [i for i, e in enumerate(table.column("entry").to_pylist()) if e]:
        while i is not None and not reached[i]:
            reached[i] = True
            i = place.get(int(start[i]) + total[i]) if total[i] is not None else None
    at = np.cumsum(reached)
    own = np.r_[-1, start[reached]][at]
    return table.append_column("reached", pa.array(reached)).append_column("owner", pa.array(own, mask=at == 0))


def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "rel", "data"]
    for key, rel, _, data in _fragments(batches):
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([rel]), pa.array([data], pa.binary())], names)


WHOLE = "struct<payload_bytes: long, payload_digest: string, http_bytes: long>"


def _joined(pieces: pa.Array, total: pa.Array) -> pa.Array:
    out = []
    for parts, n in zip(pieces, total, strict=True):
        whole = SEPARATOR.encode().join(p["data"] for p in parts.as_py())
        head, _, rest = whole.partition(b"\r\n\r\n")
        payload, stated = payload_of(rest[: n.as_py() - len(MAGIC) - len(head) - 8])
        out.append({"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "http_bytes": stated})
    return pa.array(out, pa.struct([("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http_bytes", pa.int64())]))


def read_warc(spark: SparkSession, path: str, resume: bool = False) -> DataFrame:
    """One row for each true record of the archives in *path*.

    (file, start, type, page_id, refers_to, uri, digest, http_bytes, payload_bytes, payload_digest);
    digest and http_bytes are what the headers state, payload_* what was read.
    """
    found = materialize(_raw(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("file", "block").agg(F.max("upto").alias("size"))
    bases = materialize(blocks.select("file", "block", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "bases")
    ends = bases.groupBy("file").agg((F.max(F.col("base") + F.col("size")) - len(SEPARATOR)).alias("end"))
    placed = found.join(bases.drop("size"), ["file", "block"]).withColumns({"start": F.col("base") + F.col("rel"), "exit": F.col("base") + F.col("exit")})
    kept = CANDIDATE.replace("upto long, exit long, ", "") + ", start long, entry boolean"

    def chain(begun: DataFrame) -> DataFrame:
        entered = entries(placed, begun).withColumn("entry", F.lit(True))
        flagged = placed.join(entered, ["file", "start"], "left").select([x.split(" ")[0] for x in kept.split(", ")])
        return materialize(flagged.groupBy("file", "block").applyInArrow(_follow, kept + ", reached boolean, owner long"), "chained")

    begun = ends.select("file", F.lit(0).cast("long").alias("start"))
    chained = chain(begun)
    after = F.col("start") + F.col("total")

    def damaged() -> DataFrame:
        whole = chained.filter("reached").select("file", after.alias("end"))
        return ends.join(whole, ["file", "end"], "left_anti")

    records = chained.filter("reached AND total IS NOT NULL")  # a chain can end at what has no length
    if not damaged().isEmpty():
        if not resume:
            raise ValueError(f"{damaged().count()} of {ends.count()} files are damaged, {damaged().first()['file']} among them")
        bounds = materialize(chained.select("file", "start").unionByName(ends.select("file", F.col("end").alias("start"))).distinct(), "bounds")
        sure = materialize(
            chained.filter("total IS NOT NULL").select("file", F.col("start").alias("from"), after.alias("start")).join(bounds, ["file", "start"], "left_semi").select("file", F.col("from").alias("start")),
            "sure",
        )
        while True:
            last = chained.filter("reached").groupBy("file").agg(F.max("start").alias("last"))
            rest = sure.join(damaged().select("file"), "file").join(last, "file", "left").filter(F.col("start") > F.coalesce("last", F.lit(-len(MAGIC) - 1)))
            more = materialize(rest.groupBy("file").agg(F.min("start").alias("start")), "begun")  # one row for each damaged file
            if more.isEmpty():
                break
            begun = begun.unionByName(more)
            chained = chain(begun)
        records = chained.filter("reached AND total IS NOT NULL").join(sure, ["file", "start"], "left_semi")
    fields = ["file", "start", "type", "page_id", "refers_to", "uri", "digest", "http_bytes", "payload_bytes", "payload_digest"]
    split = materialize(records.filter("NOT complete").select("file", "start", "total"), "split")
    if split.isEmpty():
        return records.select(fields)
    # fragments before a block's first record belong to the record that came in from the block before
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    came = chained.groupBy("file", "block").agg(F.max(F.when(F.col("reached"), F.col("start"))).alias("last_start")).select(
        "file", "block", F.last("last_start", ignorenulls=True).over(last).alias("came")
    )
    owned = chained.join(came, ["file", "block"]).select("file", "block", "rel", F.col("start").alias("place"), F.coalesce("owner", "came").alias("start"))
    parts = materialize(owned.join(split, ["file", "start"]), "parts")
    read = _raw(spark, path).mapInArrow(_reread, "file string, block long, rel long, data binary").join(parts, ["file", "block", "rel"])
    whole = (
        read.filter(F.col("place") < F.col("start") + F.col("total"))
        .groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("pieces"), F.first("total").alias("total"))
        .select("file", "start", F.arrow_udf(_joined, WHOLE)("pieces", "total").alias("_whole"))
    )
    mended = records.join(materialize(whole, "whole"), ["file", "start"], "left")
    for name in ("payload_bytes", "payload_digest", "http_bytes"):
        mended = mended.withColumn(name, F.coalesce(F.col(name), F.col(f"_whole.{name}")))
    return mended.select(fields)


def roundtrip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write *pages* to the shared folder as WARC files and read them back: what op3 returns."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, least)
    again = F.col("type") == "revisit"
    return read_warc(spark, path).select(
        "page_id",
        F.when(again, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, F.col("refers_to")).alias("refers_to"),
    )
