"""Texts of guides to typed rows: one file gives many."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A place's id and name over a rule of dashes; lengths of titles, of the shortest body, of the shortest file that is one text, of the shortest sentence.
HEADER = re.compile(r'"([^"]+)":\s*"([^"]+)",?\s*\n-{30}\n\n?')
RULE = "\n" + "-" * 30 + "\n"
TITLE, BODY, WHOLE, SENTENCE = range(2, 21), 50, 100, 10
ROW = pa.struct([(c, pa.string()) for c in ("chunk_id", "text", "doc_id", "title", "doc_type")])


def _row(doc: str, title: str, text: str, kind: str, chunk: str | None = None) -> dict:
    return {"chunk_id": chunk or doc, "text": text, "doc_id": doc, "title": title, "doc_type": kind}


def ruled(content: str) -> list[tuple[str, str, str]]:
    """(id, name, body) of places that stand under a header, up to the next rule."""
    found, at = [], 0
    while m := HEADER.search(content, at):
        end = content.find(RULE, m.end())
        found.append((m[1], m[2], content[m.end() : end if end >= 0 else len(content)]))
        if end < 0:
            break
        at = end + len(RULE)
    return found


def titled(content: str) -> list[tuple[str, str]]:
    """(title, body): a short line over one that isn't empty, up to the next short line that another line follows."""
    lines, found, i = content.split("\n"), [], 0
    while i + 1 < len(lines):
        if len(lines[i]) not in TITLE or not lines[i + 1]:
            i += 1
            continue
        end = next((k for k in range(i + 2, len(lines) - 1) if len(lines[k]) in TITLE), len(lines))
        found.append((lines[i], "\n".join(lines[i + 1 : end])))
        i = end
    return found


def introduction(content: str, area: str) -> list[dict]:
    """Places of an area: under headers; else under titles, if their bodies are long enough; else the whole text as one."""
    kind = "introduction"
    if places := ruled(content):
        return [_row(f"{area}_{i}", name.strip(), f"【{name}】\n{body.strip()}", kind) for i, name, body in places]
    rows = [_row(f"{area}_POI_{k:03d}", t.strip(), f"【{t.strip()}】\n{b.strip()}", kind) for k, (t, b) in enumerate(titled(content)) if len(b.strip()) > BODY]
    if not rows and len(content.strip()) > WHOLE:
        rows = [_row(f"{area}_intro", f"{area}景区介绍", content.strip(), kind)]
    return rows


def operation(content: str, area: str) -> list[dict]:
    """Sentences that say how an area is run, numbered among all."""
    doc = f"{area}_operation"
    parts = re.split('(?<=。)(?!["」])', content)
    return [_row(doc, f"{area}运营信息", s.strip(), "operation", f"{doc}_{k:04d}") for k, s in enumerate(parts) if len(s.strip()) > SENTENCE]


KINDS = {"introduction": introduction, "operation": operation}


def rows(files: DataFrame, kind: str) -> DataFrame:
    """(chunk_id, text, doc_id, title, doc_type, source_file, area) of *files* (path, content); an area is the folder that a file is in."""
    parse = KINDS[kind]

    def run(contents: pa.Array, areas: pa.Array) -> pa.Array:
        return pa.array([parse(c or "", a or "") for c, a in zip(contents.to_pylist(), areas.to_pylist(), strict=True)], pa.list_(ROW))

    parts = F.split("path", "/")
    named = files.select("content", F.element_at(parts, -1).alias("source_file"), F.try_element_at(parts, F.lit(-2)).alias("area"))
    inner = ", ".join(f"{x.name}: string" for x in ROW)
    each = named.select("source_file", "area", F.explode(F.arrow_udf(run, f"array<struct<{inner}>>")("content", "area")).alias("r"))
    return each.select("r.*", "source_file", "area")
