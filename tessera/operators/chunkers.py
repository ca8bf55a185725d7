"""Segmentation whose state runs through a document: greedy packers and the three-round chunker.

They are Python functions on one text, applied by an Arrow UDF to whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Chunker = Callable[[str], list[str]]
#: Characters of text whose chunks a worker gives back together.
CHARS = 1 << 20


def split_sentences(text: str, ends: str = ".!?;") -> list[str]:
    found = re.findall(f"[^{re.escape(ends)}\n]+[{re.escape(ends)}]?", text)
    return [s.strip() for s in found if s.strip()]


def metric_sentences(text: str, least: int = 5) -> list[str]:
    """Sentences with their end mark, of *least* characters or more; a Latin mark ends one only before white space or the end."""
    found, held = [], ""
    for part in re.split(r"([。！？\n]|[.!?](?=\s|$))", text):
        if part in tuple("。！？.!?"):
            found.append(held + part)
            held = ""
            continue
        found.append(held)
        held = "" if part == "\n" else part
    return [s.strip() for s in [*found, held] if len(s.strip()) >= least]


def pack(parts: list[str], limit: int, joiner: str = "\n") -> list[str]:
    """Parts in turn while they fit; a part over the limit stands alone."""
    out, held, size = [], [], 0
    for p in parts:
        more = len(p) + (len(joiner) if held else 0)
        if held and size + more > limit:
            out.append(joiner.join(held))
            held, size, more = [], 0, len(p)
        held.append(p)
        size += more
    return [*out, joiner.join(held)] if held else out


def paragraph_pack(text: str, limit: int = 600) -> list[str]:
    """Paragraphs packed up to the limit; those over it by their sentences."""
    out: list[str] = []
    run: list[str] = []
    for p in filter(None, (p.strip() for p in text.split("\n"))):
        if len(p) > limit:
            out += pack(run, limit) + pack(split_sentences(p), limit, " ")
            run = []
        else:
            run.append(p)
    return out + pack(run, limit)


def stepped_pack(text: str, limit: int = 500, overlap: int = 80) -> list[str]:
    """As paragraph_pack, but what is over the limit is cut in steps of limit - overlap."""
    out: list[str] = []
    for chunk in paragraph_pack_lines(text, limit):
        step = max(1, limit - overlap)
        out += [chunk] if len(chunk) <= limit else [chunk[i : i + limit] for i in range(0, max(1, len(chunk) - overlap), step)]
    return out


def paragraph_pack_lines(text: str, limit: int) -> list[str]:
    return pack([p.strip() for p in text.split("\n") if p.strip()], limit)


def sentence_window(text: str, limit: int = 400, overlap: int = 60) -> list[str]:
    """Sentences packed by characters; each chunk begins with the last sentences of the one before, up to *overlap*."""
    out: list[str] = []
    held: list[str] = []
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if held and sum(map(len, held)) + len(s) > limit:
            out.append(" ".join(held))
            tail: list[str] = []
            for t in reversed(held):
                if sum(map(len, tail)) + len(t) > overlap:
                    break
                tail.insert(0, t)
            held = tail
        held.append(s)
    return [*out, " ".join(held)] if any(held) else out


def boundary_window(text: str, size: int = 500, overlap: int = 50, marks: str = "\n.!?;,") -> list[str]:
    """Windows cut at the last mark behind their middle; always moves on, and ends with the text."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(m, at + size // 2, end) for m in marks)
            end = cut + 1 if cut >= 0 else end
        out.append(text[at:end])
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def word_halves(text: str, target: int = 100) -> list[str]:
    """Two parts, the first of *target* words at most."""
    words = text.split()
    return [" ".join(w) for w in (words[:target], words[target:]) if w]


def dynamic_combination(text: str, target: int = 300) -> list[str]:
    """Consecutive sentences up to the target size; no empty piece in front."""
    return pack(split_sentences(text), target, " ")


def bigram_perplexities(sentences: list[str], kinds: int | None = None) -> list[float]:
    """Each sentence under an add-one character-bigram model of all of them; *kinds* characters are possible, or those that occur."""
    data = np.frombuffer("".join(sentences).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(data):
        return [1.0] * len(sentences)
    sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
    ends = np.cumsum(sizes)
    values, code = np.unique(data, return_inverse=True)
    kinds = kinds or len(values)
    inside = np.ones(len(data), bool)
    inside[ends[sizes > 0] - 1] = False  # a pair doesn't go from one sentence to the next
    first = np.flatnonzero(inside)
    pairs = code[first].astype(np.int64) * len(values) + code[first + 1]
    _, which, n_pair = np.unique(pairs, return_inverse=True, return_counts=True)
    n_first = np.bincount(code[first], minlength=len(values))
    loss = np.zeros(len(data) + 1)
    loss[first + 1] = np.log((n_first[code[first]] + kinds) / (n_pair[which] + 1))
    total = np.cumsum(loss)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        out.append(math.exp((total[end] - total[end - n]) / (n - 1)) if n > 1 else 1.0)
    return out


def char_cosine(a: str, b: str) -> float:
    x, y = Counter(a), Counter(b)
    dot = sum(n * y[c] for c, n in x.items())
    return dot / (math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values())) or 1.0)


def three_rounds(text: str, least: int = 300, most: int = 600, sigma: float = 3.0) -> list[str]:
    """Structure, then perplexity, then merging: blocks by line marks; in each, sentences over mean + 3 sigma go and cuts fall over mean + sigma; last, small neighbours merge by their gain."""
    out: list[str] = []
    blocks = re.split(r"\n(?=#|={3}|-{3})", text)
    for block in blocks:
        s = split_sentences(block)
        if not s:
            continue
        ppl = bigram_perplexities(s)
        mean = sum(ppl) / len(ppl)
        sd = math.sqrt(sum((p - mean) ** 2 for p in ppl) / len(ppl))
        pieces: list[list[str]] = [[]]
        for one, p in zip(s, ppl, strict=True):
            if p > mean + sigma * sd:
                continue
            if pieces[-1] and p > mean + sd:
                pieces.append([])
            pieces[-1].append(one)
        out += merge_small([" ".join(p) for p in pieces if p], least, most)
    return out


def merge_small(pieces: list[str], least: int, most: int, beta_small: float = 0.8, beta: float = 1.1) -> list[str]:
    """Greedy merging from the left while the gain 1 / (2 - similarity), over a threshold by size, allows it and the length fits."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + 1 + len(p) <= most:
            gain = 1 / (1 + (1 - char_cosine(out[-1], p)))
            small = len(out[-1]) < least or len(p) < least
            if gain * (1 / beta_small if small else 1 / beta) > 0.8:
                out[-1] += " " + p
                continue
        out.append(p)
    return out


def tail_overlap(text: str, size: int = 800, overlap: int = 50) -> list[str]:
    """Paragraphs; those over *size* by sentences joined with a full stop, each new chunk behind the last *overlap* characters of the one before.

    The end marks of sentences are not kept, and a chunk that holds no more than *overlap* characters leaves no tail.
    """
    out: list[str] = []
    for p in filter(None, (p.strip() for p in re.split(r"\n\n+|\r\n\r\n+", text))):
        if len(p) <= size:
            out.append(p)
            continue
        held = ""
        for s in filter(None, (s.strip() for s in re.split("[。！？；!?;]", p))):
            if len(held) + len(s) + 1 > size:
                out += [held] if held else []
                held = held[-overlap:] + s if 0 < overlap < len(held) else s
            else:
                held = f"{held}。{s}" if held else s
        out += [held] if held else []
    return out


def model_pack(text: str, size: int = 2000) -> list[str]:
    """Sentences with all that stands between them, packed up to *size*; a sentence over it is cut into pieces, the last of which goes on."""
    out: list[str] = []
    held = ""
    for s in re.findall(r"[^。！？\.!\?\n]+[。！？\.!\?\n]*", text):
        if len(held) + len(s) <= size:
            held += s
        elif held:
            out.append(held)
            held = s
        else:
            *whole, held = [s[i : i + size] for i in range(0, len(s), size)]
            out += whole
    return [*out, held] if held else out


def sentence_budget(text: str, target: int = 200) -> list[str]:
    """Windows of one sentence or more of *target* characters at most, so that long chunks don't hold more sentences by nature."""
    out, held, size = [], [], 0
    for s in split_sentences(text):
        if held and size + len(s) > target:
            out.append(" ".join(held))
            held, size = [], 0
        held.append(s)
        size += len(s)
        if len(s) >= target:
            out.append(" ".join(held))
            held, size = [], 0
    return [*out, " ".join(held)] if held else out


def minima(values: list[float], threshold: float) -> list[int]:
    """Places below both neighbours by *threshold* on one side, or below the one before by it and equal to the next."""
    out = []
    for i in range(1, len(values) - 1):
        left, right = values[i - 1] - values[i], values[i + 1] - values[i]
        if left > 0 and (right > 0 and max(left, right) >= threshold or right == 0 and left >= threshold):
            out.append(i)
    return out


def overlapping_minima(text: str, threshold: float = 1.0) -> list[str]:
    """Sentences cut at minima of perplexity; the sentence at a cut ends one chunk and begins the next."""
    s = split_sentences(text)
    if not s:
        return []
    cuts = [0, *minima(bigram_perplexities(s), threshold), len(s) - 1]
    return [" ".join(s[a : b + 1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def likeness_margin(held: str, sentence: str) -> float:
    """The offline margin: positive where two texts' characters are alike."""
    return 2 * char_cosine(held, sentence) - 1


def margin_chunks(text: str, margin: Callable[[str, str], float] = likeness_margin, size: int = 0) -> list[str]:
    """A sentence joins the chunk before while the margin for it is over a threshold: 0, then the mean of the last five margins.

    A model can give the margin, as the probability of joining less that of cutting. With *size*, neighbouring chunks of so many words at most are put together.
    """
    out: list[str] = []
    seen: list[float] = []
    for s in split_sentences(text):
        if not out:
            out.append(s)
            continue
        threshold = sum(seen[-5:]) / 5 if len(seen) >= 5 else 0.0
        seen.append(margin(out[-1], s))
        if seen[-1] > threshold:
            out[-1] += " " + s
        else:
            out.append(s)
    if not size:
        return out
    packed: list[str] = []
    for c in out:
        if packed and len(packed[-1].split()) + len(c.split()) <= size:
            packed[-1] += " " + c
        else:
            packed.append(c)
    return packed


CHUNKERS: dict[str, Chunker] = {
    "paragraph_pack": paragraph_pack, "stepped_pack": stepped_pack, "sentence_window": sentence_window, "boundary_window": boundary_window,
    "word_halves": word_halves, "dynamic_combination": dynamic_combination, "three_round_chunker": three_rounds,
    "tail_overlap": tail_overlap, "model_pack": model_pack, "sentence_budget": sentence_budget, "overlapping_minima": overlapping_minima, "margin_chunks": margin_chunks,
}


def chunk(docs: DataFrame, how: str, **options) -> DataFrame:
    """(doc_id, place, chunk) of every text by the chunker *how*; null and blank texts have no chunk.

    Chunks are given back CHARS characters of text at a time, so what a worker holds doesn't follow the number of rows in a batch.
    """
    f = CHUNKERS[how]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size, found = batch.column(1), 0, 0, []
            for k, value in enumerate(texts, 1):
                t = value.as_py() or ""
                found.append(f(t, **options) if t.strip() else [])
                size += len(t)
                if size >= CHARS or k == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k - first), pa.array(found, pa.list_(pa.string()))], ["doc_id", "chunks"])
                    first, size, found = k, 0, []

    # texts are wide: a batch is bounded by bytes, not by rows alone
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    done = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunks array<string>")
    return done.select("doc_id", F.posexplode("chunks").alias("place", "chunk"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each word of *a*, a few operations on all of them for each word of *b*."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for w in b:
        held = row & at.get(w, 0)
        row = (row + held | row - held) & whole
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """*df* with `rouge_p`, `rouge_r` and `rouge_f` of two token arrays added, at four places."""

    def run(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        out = []
        for r, h in zip(refs.to_pylist(), hyps.to_pylist(), strict=True):
            n = lcs(r or [], h or [])
            p, c = (n / len(h) if h else 0.0), (n / len(r) if r else 0.0)
            out.append({"p": round(p, 4), "r": round(c, 4), "f": round(2 * p * c / (p + c), 4) if n else 0.0})
        return pa.array(out, pa.struct([("p", pa.float64()), ("r", pa.float64()), ("f", pa.float64())]))

    done = df.withColumn("_r", F.arrow_udf(run, "struct<p: double, r: double, f: double>")(F.col(reference), F.col(hypothesis)))
    return done.withColumns({f"rouge_{k}": F.col(f"_r.{k}") for k in "prf"}).drop("_r")
