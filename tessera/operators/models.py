"""Hooks for models. Each is a function on a list of texts; the defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunkers import bigram_perplexities

Embedder = Callable[[list[str]], np.ndarray]
Completer = Callable[[list[str]], list[str]]
Scorer = Callable[[list[str], list[str]], list[float]]


def hashing_embedder(width: int = 64) -> Embedder:
    """Signed word hashes, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for k, t in enumerate(texts):
            for word in (t or "").lower().split():
                h = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                out[k, int.from_bytes(h[:4], "big") % width] += 1.0 if h[4] & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)

    return embed


def stub_completer(prompts: list[str]) -> list[str]:
    """A fixed answer in the shape that callers parse: a JSON object with a digest and a score."""
    return [json.dumps({"answer": (p or "")[:80], "score": hashlib.md5((p or "").encode()).digest()[0] % 101}) for p in prompts]


def context_perplexity(contexts: list[str], targets: list[str]) -> list[float]:
    """The target under a character-bigram model of context and target."""
    return [bigram_perplexities([c or "", t or ""])[1] for c, t in zip(contexts, targets, strict=True)]


def with_embedding(df: DataFrame, text: str, embedder: Embedder | None = None, clip: int | None = None, name: str = "embedding") -> DataFrame:
    """*df* with the vectors of a text column; a model of bounded input can be given the first *clip* characters only."""
    embed = embedder or hashing_embedder()

    def run(texts: pa.Array) -> pa.Array:
        found = embed([(t or "")[:clip] for t in texts.to_pylist()])
        return pa.array(list(np.asarray(found, np.float32)), pa.list_(pa.float32()))

    return df.withColumn(name, F.arrow_udf(run, "array<float>")(F.col(text)))


def with_completion(df: DataFrame, prompt: str, completer: Completer = stub_completer, retries: int = 3, name: str = "completion") -> DataFrame:
    """*df* with a completion of a prompt column, and in *name*_error what went wrong: a batch that fails *retries* times is asked prompt by prompt.

    A prompt whose own call fails as well has a null completion and the last error's text.
    """

    def tried(asked: list[str]) -> tuple[list[str | None], str | None]:
        said = None
        for _ in range(retries):
            try:
                return list(completer(asked)), None
            except Exception as e:  # noqa: BLE001  whatever a client raises
                said = f"{type(e).__name__}: {e}"
        return [None] * len(asked), said

    def run(prompts: pa.Array) -> pa.Array:
        asked = prompts.to_pylist()
        done, error = tried(asked)
        rows = [(d, error) for d in done]
        if error and len(asked) > 1:
            rows = [(d[0], e) for d, e in (tried([p]) for p in asked)]
        return pa.array([{"text": d, "error": e} for d, e in rows], pa.struct([("text", pa.string()), ("error", pa.string())]))

    asked = df.withColumn("_c", F.arrow_udf(run, "struct<text: string, error: string>")(F.col(prompt)))
    return asked.withColumns({name: F.col("_c.text"), f"{name}_error": F.col("_c.error")}).drop("_c")


def with_perplexity(df: DataFrame, context: str, target: str, scorer: Scorer = context_perplexity, name: str = "ppl") -> DataFrame:
    def run(contexts: pa.Array, targets: pa.Array) -> pa.Array:
        return pa.array(scorer(contexts.to_pylist(), targets.to_pylist()), pa.float64())

    return df.withColumn(name, F.arrow_udf(run, "double")(F.col(context), F.col(target)))


def iterate(score: Callable[[str], float], refine: Callable[[str, float], str], start: str, threshold: float = 85.0, window: int = 2, min_delta: float = 0.5, most: int = 5, retries: int = 3) -> list[dict]:
    """Refine a prompt until its score reaches the threshold or *window* steps in a row bring less than *min_delta*.

    A refinement that scores lower is drawn again up to *retries* times, then the step keeps the old prompt.
    """
    best, value, still = start, score(start), 0
    trace = [{"round": 0, "prompt": best, "score": value, "accepted": True}]
    for k in range(1, most + 1):
        if value >= threshold or still >= window:
            break
        new, got = best, value
        for _ in range(retries):
            tried = refine(best, value)
            if (s := score(tried)) >= value:
                new, got = tried, s
                break
        still = still + 1 if got - value < min_delta else 0
        trace.append({"round": k, "prompt": new, "score": got, "accepted": new != best})
        best, value = new, got
    return trace


def with_iterations(df: DataFrame, prompt: str, score: Callable[[str], float], refine: Callable[[str, float], str], **how) -> DataFrame:
    """A row for each row of *df* and round of iterate() on its prompt: `round`, `prompt`, `score`, `accepted` and `n_chars`; none for a null prompt."""
    kind = pa.list_(pa.struct([("round", pa.int32()), ("prompt", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())]))

    def run(prompts: pa.Array) -> pa.Array:
        return pa.array([[] if p is None else iterate(score, refine, p, **how) for p in prompts.to_pylist()], kind)

    traced = F.arrow_udf(run, "array<struct<round: int, prompt: string, score: double, accepted: boolean>>")(F.col(prompt))
    rows = df.select(*[c for c in df.columns if c != prompt], F.explode(traced).alias("_t"))
    return rows.select(*[c for c in rows.columns if c != "_t"], "_t.*").withColumn("n_chars", F.length("prompt"))
