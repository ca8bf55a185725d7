"""Dimensions that are checked and rewritten until nothing changes: decisions are a small table, applied to all tags by a join."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import diagnostics, jaccard_pairs
from tessera.scratch import discard, materialize

#: Least share of chunks, least normalised entropy, least difference of two dimensions.
COVERAGE, ENTROPY, DIFFERENCE = 0.20, 0.30, 0.3
ACTIONS = ("DELETE", "KEEP", "RENAME", "SPLIT", "MERGE")


class Issue(NamedTuple):
    """Why a dimension must be decided on: `coverage`, `entropy`, or `redundant` with its partner."""

    dim: str
    kind: str
    coverage: float
    entropy: float
    partner: str | None
    #: What it may be merged into: dimensions without an issue.
    targets: tuple[str, ...]


class Decision(NamedTuple):
    dim: str
    action: str
    #: RENAME, MERGE: the dimension that takes its tags.
    target: str | None = None
    #: SPLIT: the dimension of each value; values that aren't named go.
    parts: dict[str, str] = {}  # noqa: RUF012


Decider = Callable[[list[Issue]], list[Decision]]


def name_likeness(a: str, b: str) -> float:
    """Shared pairs of characters of two names: twice the shared ones over all."""
    x, y = ({n.lower()[i : i + 2] for i in range(len(n) - 1)} or {n.lower()} for n in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def by_likeness(issues: list[Issue], least: float = 0.5) -> list[Decision]:
    """The default: redundant dimensions are merged into their partner, others into the target whose name is most alike, or they go."""
    found = []
    for i in issues:
        if i.kind == "redundant":
            found.append(Decision(i.dim, "MERGE", i.partner))
            continue
        near = max(i.targets, key=lambda t: (name_likeness(i.dim, t), t), default=None)
        found.append(Decision(i.dim, "MERGE", near) if near is not None and name_likeness(i.dim, near) >= least else Decision(i.dim, "DELETE"))
    return found


def resolved(decisions: list[Decision]) -> dict[str, str | None]:
    """Where each renamed, merged or deleted dimension ends, chains followed to their end; a circle ends at its least name."""
    step = {d.dim: None if d.action == "DELETE" else d.target for d in decisions if d.action in ("DELETE", "RENAME", "MERGE")}
    out = {}
    for dim in step:
        seen, at = [dim], step[dim]
        while at in step and at not in seen:
            seen.append(at)
            at = step[at]
        out[dim] = min(seen[seen.index(at) :]) if at in seen else at
    return {k: v for k, v in out.items() if v != k}


def rewrite(tags: DataFrame, decisions: list[Decision]) -> DataFrame:
    """*tags* (chunk_id, dim, tag) after the decisions: a broadcast of as many rows as there are decisions and split values."""
    for d in decisions:
        if d.action not in ACTIONS or d.action in ("RENAME", "MERGE") and not d.target:
            raise ValueError(f"no such decision: {d}")
    spark = tags.sparkSession
    split = [(d.dim, v, p) for d in decisions if d.action == "SPLIT" for v, p in d.parts.items()]
    gone = [d.dim for d in decisions if d.action == "SPLIT"]
    ends = resolved(decisions)
    parts = F.broadcast(spark.createDataFrame(split, "dim string, tag string, part string"))
    whole = F.broadcast(spark.createDataFrame([(k, v, True) for k, v in ends.items()] + [(k, None, True) for k in gone], "dim string, into string, moved boolean"))
    new = F.coalesce("part", F.when(F.col("moved"), F.col("into")).otherwise(F.col("dim")))
    out = tags.join(parts, ["dim", "tag"], "left").join(whole, "dim", "left").select("chunk_id", new.alias("dim"), "tag")
    # a split's part may itself be merged or renamed
    out = out.join(whole, "dim", "left").select("chunk_id", F.when(F.col("moved") & F.col("into").isNotNull(), F.col("into")).otherwise(F.col("dim")).alias("dim"), "tag")
    return out.filter("dim IS NOT NULL").distinct()


class Outcome(NamedTuple):
    tags: DataFrame
    #: What was decided in each round.
    rounds: list[list[Decision]]
    converged: bool


def optimize(
    tags: DataFrame, n_chunks: int, decide: Decider = by_likeness, likeness: Callable[[str, str], float] = name_likeness, most_rounds: int = 5,
    coverage: float = COVERAGE, entropy: float = ENTROPY, difference: float = DIFFERENCE,
) -> Outcome:
    """*tags* (chunk_id, dim, tag) rewritten until no dimension is removed or added.

    A round measures the dimensions that aren't verified yet over all tags. Those that cover few of *n_chunks* or say little are put to *decide*,
    as are pairs that are alike in name and in values; the others are verified. New names must pass the same measures, or go. What comes to
    the driver is a row for each dimension and each pair that shares values. An own *decide* may ask a model.
    """
    tags = materialize(tags.select("chunk_id", "dim", "tag").filter("dim IS NOT NULL AND tag IS NOT NULL").distinct(), "tags")
    verified: set[str] = set()
    rounds: list[list[Decision]] = []
    for _ in range(most_rounds):
        measured = {r.dim: (r.coverage, r.entropy) for r in diagnostics(tags, F.lit(n_chunks)).select("dim", "coverage", "entropy").collect()}
        passes = lambda d: measured[d][0] >= coverage and measured[d][1] >= entropy  # noqa: B023, E731
        active = sorted(d for d in measured if d not in verified)
        if not active:
            return Outcome(tags, rounds, True)
        good = [d for d in active if passes(d)]
        targets = tuple(sorted({*good, *verified}))
        issues = [Issue(d, "coverage" if measured[d][0] < coverage else "entropy", *measured[d], None, targets) for d in active if not passes(d)]
        merged: set[str] = set()
        for r in sorted(jaccard_pairs(tags.filter(F.col("dim").isin(good))).collect(), key=lambda r: (r.a, r.b)):
            if r.a not in merged and r.b not in merged and 1 - min(r.jaccard, likeness(r.a, r.b)) < difference:
                issues.append(Issue(r.b, "redundant", *measured[r.b], r.a, targets))
                merged.add(r.b)
        decisions = decide(issues) if issues else []
        rounds.append(decisions)
        kept = {d.dim for d in decisions if d.action == "KEEP"}
        moved = {d.dim for d in decisions if d.action != "KEEP"}
        verified |= (set(good) | kept) - moved
        if not moved:
            return Outcome(tags, rounds, True)
        after = materialize(rewrite(tags, decisions), "tags")
        fresh = {r.dim: r.coverage >= coverage and r.entropy >= entropy for r in diagnostics(after, F.lit(n_chunks)).collect() if r.dim not in measured}
        if failed := [d for d, ok in fresh.items() if not ok]:
            before, after = after, materialize(after.filter(~F.col("dim").isin(failed)), "tags")
            discard(before)
        discard(tags)
        tags = after
    return Outcome(tags, rounds, False)
