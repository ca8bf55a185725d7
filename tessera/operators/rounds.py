"""The integrated chunker: structure, then perplexity against the whole corpus, then merging from a heap.

All are functions on one text, or on the sentences of one section, that Arrow UDFs apply; the model of the perplexities counts the whole corpus,
in the tasks first, and goes back to the sections (pairs.py).
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import pairs
from tessera.scratch import materialize

#: Lines that begin a section: a title between equals signs, a heading, a rule.
SECTION = re.compile(r"\s*={3,}.+$|\s*#{1,6}\s+.+$|\s*-{20,}\s*$|\s*-{3}\s*$")
SENTENCE = re.compile("[^。！？；!?;\n“”]+[。！？；!?;“”]?")
#: Sentences before one that are its context; steps of the median deviation that are noise.
CONTEXT, NOISE = 3, 3.5
HIGHEST = 1e6


def sections(text: str) -> list[str]:
    """*text* cut before each line that begins a section; blank ones are left out."""
    found: list[list[str]] = [[]]
    for line in text.split("\n"):
        if found[-1] and SECTION.match(line):
            found.append([])
        found[-1].append(line)
    return [s for lines in found if (s := "\n".join(lines).strip())]


def sentences(text: str) -> list[str]:
    return [s for m in SENTENCE.findall(text) if (s := m.strip())]


def spread(docs: DataFrame) -> DataFrame:
    """(doc_id, section, head, s): the sentences of every section of *docs* (doc_id, text), and its first characters. Sections without any are left out."""

    def run(texts: pa.Array) -> pa.Array:
        out = [[{"section": k, "head": sec[:400], "s": s} for k, sec in enumerate(sections(t or "")) if (s := sentences(sec))] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("section", pa.int32()), ("head", pa.string()), ("s", pa.list_(pa.string()))])))

    found = F.explode(F.arrow_udf(run, "array<struct<section: int, head: string, s: array<string>>>")("text"))
    return docs.select("doc_id", found.alias("x")).select("doc_id", "x.*")


def perplexities(s: list[str], losses: pairs.Losses, context: int = CONTEXT) -> np.ndarray:
    """Of each sentence of a section and the *context* sentences before it, taken together."""
    if not s:
        return np.zeros(0)
    sizes = np.fromiter(map(len, s), np.int64, len(s))
    starts = np.cumsum(sizes) - sizes
    # a sentence's own pairs begin with the one that leads into it, which none does into the first
    loss = np.concatenate([[0.0], losses.of(pairs.text_pairs("".join(s)))])
    own, first = np.add.reduceat(loss, starts), loss[starts]
    total, n = np.zeros(len(s)), np.zeros(len(s), np.int64)
    for back in range(min(context, len(s) - 1), -1, -1):
        total[back:] += own[: len(s) - back]
        n[back:] += sizes[: len(s) - back]
    total -= first[np.maximum(np.arange(len(s)) - context, 0)]  # the pair that leads into the context isn't part of it
    n -= 1
    with np.errstate(over="ignore"):
        return np.round(np.where(n > 0, np.minimum(np.exp(total / np.maximum(n, 1)), HIGHEST), 100.0), 9)


def without_noise(s: list[str], ppl: np.ndarray, steps: float = NOISE) -> list[str]:
    """The sentences not more than *steps* median deviations over the section's median; a single one stays."""
    if len(s) < 2:
        return s
    mid = np.median(ppl)
    mad = np.median(np.abs(ppl - mid))
    bar = mid + (steps * 1e-3 if mad < 1e-9 else mad * (steps * 1.4826))
    return [x for x, p in zip(s, ppl.tolist(), strict=True) if p <= bar]


def cut(s: list[str], ppl: np.ndarray) -> list[str]:
    """Chunks of a section: a new one begins where the perplexity is over mean and deviation."""
    bar = ppl.mean() + (ppl.std(ddof=1) if len(s) > 1 else 0.0) if len(s) else 0.0
    out: list[list[str]] = []
    for x, p in zip(s, ppl.tolist(), strict=True):
        if not out or p > bar:
            out.append([])
        out[-1].append(x)
    return ["".join(x) for x in out]


def _chunked(docs: DataFrame, least: Column, most: Column, most_sent: int, chunks: Callable[[list[str], pairs.Losses, int, int], list[str]], clean: Callable[[list[str], pairs.Losses], list[str]] | None = None) -> DataFrame:
    """(doc_id, section, place, chunk_text, chunk_len): what *chunks* makes of each section, by the pairs of characters counted over all sections.

    *clean* says which sentences stay before that. A section is a row from the start, so that only the counts of pairs go through an exchange.
    """
    rows = materialize(spread(docs), "sections")
    whole = F.array_join("s", "")
    model = pairs.count(rows, whole.alias("t"), most_sent)
    rows = rows.select(*_section(), "s", least.cast("int").alias("least"), most.cast("int").alias("most"))
    if clean and model.sent is None:  # what stays brings new pairs together, whose counts are joined then
        held, first = pairs.with_losses(rows, _section(), whole, model)
        names, stays = rows.columns, clean

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = pa.array([stays(s, own) for s, own in zip(batch.column("s").to_pylist(), first(batch), strict=True)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([s if c == "s" else batch.column(c) for c in names], names)

        rows = materialize(held.mapInArrow(cleaned, rows.schema), "cleaned")
        clean = None
    held, maker = pairs.with_losses(rows, _section(), whole, model)
    kinds = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in _section()], "chunks array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunks(clean(s, own) if clean else s, own, a, b) for s, own, a, b in zip(batch.column("s").to_pylist(), maker(batch), batch.column("least").to_pylist(), batch.column("most").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in _section()], pa.array(found, pa.list_(pa.string()))], [*_section(), "chunks"])

    done = held.mapInArrow(run, kinds).select(*_section(), F.posexplode("chunks").alias("place", "chunk_text"))
    return done.withColumn("chunk_len", F.length("chunk_text").cast("long"))


def _section() -> list[str]:
    return ["doc_id", "section"]


class _Unit:
    def __init__(self, text: str):
        self.text = text
        self.counts = Counter(text)
        self.square = sum(n * n for n in self.counts.values())

    def absorb(self, other: _Unit) -> None:
        self.text += other.text
        self.counts.update(other.counts)
        self.square = sum(n * n for n in self.counts.values())


def gain(a: _Unit, b: _Unit) -> float:
    """1 / (2 - cosine of the character counts)."""
    few, many = (a.counts, b.counts) if len(a.counts) < len(b.counts) else (b.counts, a.counts)
    dot = sum(n * many[c] for c, n in few.items())
    return 1 / (2 - max(-1.0, min(1.0, dot / (math.sqrt(a.square) * math.sqrt(b.square) or 1.0))))


def merge_by_gain(text: str, most: int) -> list[str]:
    """The sentences of a chunk that is too long, neighbours merged from the highest gain on while they fit in *most*.

    A pair that waits in the heap keeps the gain it came with; it is passed over if its second part is gone, and if both still
    are there it is merged even if they have grown since. What is too long then is cut, and its rest is put behind the next part or, where it
    doesn't fit there, stands alone: no text is lost.
    """
    units: list[_Unit | None] = [_Unit(s) for s in sentences(text)]
    if not units:
        return [text]
    after = list(range(1, len(units) + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(units) and len(units[i].text) + len(units[j].text) <= most:
            heapq.heappush(heap, (-gain(units[i], units[j]), i, j))

    for i in range(len(units) - 1):
        offer(i)
    while heap:
        _, i, j = heapq.heappop(heap)
        if units[i] is None or units[j] is None:
            continue
        units[i].absorb(units[j])
        units[j] = None
        after[i] = after[j]
        offer(i)
    out, rest = [], ""
    for u in filter(None, units):
        if len(u.text) > most:
            out.append(u.text[:most])
            rest += u.text[most:]
            continue
        fits = len(u.text) + len(rest) <= most
        out += [u.text + rest] if fits else [rest, u.text]
        rest = ""
    if rest:
        if out and len(out[-1]) + len(rest) <= most * 1.1:
            out[-1] += rest
        else:
            out.append(rest)
    return out


def merge_rest(chunks: list[str], least: int, most: int, small: float = 0.8, slack: float = 1.1) -> list[str]:
    """The chunks of a section: too long ones by merge_by_gain(), then small ones put behind the one before where they fit."""
    out: list[str] = []
    for c in (part for chunk in chunks for part in ([chunk] if len(chunk) <= most else merge_by_gain(chunk, most))):
        if out and len(c) < least * small and len(out[-1]) + len(c) <= most * slack:
            out[-1] += c
        else:
            out.append(c)
    return out


def integrated(docs: DataFrame, least: Column | int = 300, most: Column | int = 600, denoise: bool = True, steps: float = NOISE, most_sent: int = pairs.SENT) -> DataFrame:
    """(doc_id, section, place, chunk_text, chunk_len): *docs* (doc_id, text) by all three rounds.

    *least* and *most* may be columns of `head`, the first characters of a section. The character model counts all sections once;
    both perplexities, with and without noise, come from it. Null and blank texts have no chunk.
    """
    def clean(s: list[str], losses: pairs.Losses) -> list[str]:
        return without_noise(s, perplexities(s, losses), steps)

    def chunks(s: list[str], losses: pairs.Losses, least: int, most: int) -> list[str]:
        return merge_rest(cut(s, perplexities(s, losses)), least, most)

    return _chunked(docs, *[c if isinstance(c, Column) else F.lit(c) for c in (least, most)], most_sent, chunks, clean if denoise else None)


def adaptive_cut(sizes: list[int], ppl: list[float], least: int, most: int, ratio: float = 0.75) -> list[int]:
    """The places where chunks begin, of sentences of some *sizes* and perplexities.

    A chunk under *least* goes on, one from *most* on ends. Between, it ends where the perplexity is over mean and deviation, times 0.7
    while the section so far, with this sentence, is shorter than half of the aim, and times 1.3 once it is 1.2 times as long.
    """
    fine = [p for p in ppl if math.isfinite(p)]
    mean = sum(fine) / len(fine) if fine else 100.0
    bar = mean + (math.sqrt(sum((p - mean) ** 2 for p in fine) / (len(fine) - 1)) if len(fine) > 1 else 0.0 if fine else 50.0)
    aim = int((least + most) * ratio / 2)
    begins, held, total = [0], 0, 0
    for k, (n, p) in enumerate(zip(sizes, ppl, strict=True)):
        total += n
        factor = 0.7 if total < aim * 0.5 else 1.3 if total > aim * 1.2 else 1.0
        if k and held >= least and (held >= most or p > bar * factor):
            begins.append(k)
            held = 0
        held += n
    return begins


def merge_best(text: str, most: int) -> list[str]:
    """The sentences of a chunk that is too long: each time the best pair of neighbours that fits is merged, of equal ones the first.

    Gains are those of the texts as they are: a pair in the heap is passed over once one of its parts has changed. A sentence over *most* is cut into pieces.
    """
    units: list[_Unit | None] = [_Unit(s) for s in sentences(text)]
    if not units:
        return [text]
    after, before, version = list(range(1, len(units) + 1)), list(range(-1, len(units) - 1)), [0] * len(units)
    heap: list[tuple] = []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < len(units) and len(units[i].text) + len(units[j].text) <= most:
            heapq.heappush(heap, (-gain(units[i], units[j]), i, j, version[i], version[j]))

    for i in range(len(units) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if units[i] is None or units[j] is None or (a, b) != (version[i], version[j]):
            continue
        units[i].absorb(units[j])
        units[j], after[i] = None, after[j]
        version[i] += 1
        if after[i] < len(units):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [u.text[k : k + most] for u in units if u for k in range(0, len(u.text), most)]


def enhanced(docs: DataFrame, least: int = 300, most: int = 600, ratio: float = 0.75, most_sent: int = pairs.SENT) -> DataFrame:
    """(doc_id, section, place, chunk_text, chunk_len): as integrated(), with adaptive_cut() and merge_best(). Noise stays, whatever its length."""
    def chunks(s: list[str], losses: pairs.Losses, least: int, most: int) -> list[str]:
        begins = [*adaptive_cut(list(map(len, s)), perplexities(s, losses).tolist(), least, most, ratio), len(s)]
        parts = ["".join(s[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
        return merge_rest([part for c in parts for part in ([c] if len(c) <= most else merge_best(c, most))], least, most)

    return _chunked(docs, F.lit(least), F.lit(most), most_sent, chunks)
