"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Linked documents begin in shards dealt
in turn; then rounds move them towards the shard where most of
their neighbours are. The documents of one group in one
shard (a cohort) have the same neighbours, so rounds work on counts by group and
shard, not on documents or links: a group of n documents is n rows at most, and
as many rows as there are shards however large it is. A cohort moves only to one of its
group that is at least as large, so every move lowers the number of cut links, and
the rounds end. Which of its equal cohorts a group gathers at changes from round to round; after PATIENCE rounds
that moved nothing, or less than the part `least` of the linked documents (a parameter; the quotas hold all the same), there is an end.

Quotas: a shard never gets more linked documents than its exact share of rows, neither at the
start nor after any round. Wishes are summed by pair of shards, a table whose size the number of shards
bounds, and cut down until no shard receives more than it gives and has room for; of each pair's
wishes as many documents go as are admitted, those with the largest gains first, counted by
running sums over the whole table. Unlinked documents cost no link anywhere; they fill the shards at
the end, so that counts are at most one apart (law `rows`) and slots have no gaps.

Defined results: a null text has no bytes and is equal to an empty one; repeated
rows are documents of their own; the order of rows with equal doc_id and text
is free, as they are the same; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import logging
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, indexed, materialize, running

log = logging.getLogger(__name__)
#: Rounds without an effect after which no more are tried, and a prime above the number of shards that deals ties.
PATIENCE, PRIME = 4, 1_000_003


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def first_cohorts(groups: DataFrame, shards: int) -> DataFrame:
    """(g, s, n): the documents of group g (linked documents number `first` to first + members) that begin in shard s, dealt in turn."""
    turn = F.explode(F.sequence(F.lit(0), F.least(F.col("members"), F.lit(shards)).cast("int") - 1)).alias("t")
    return groups.select(F.col("first").alias("g"), "members", turn).select(
        "g", F.pmod(F.col("g") + F.col("t"), F.lit(shards)).cast("int").alias("s"), (F.floor((F.col("members") - 1 - F.col("t")) / shards) + 1).cast("long").alias("n")
    )


def cut_links(cohorts: DataFrame) -> int:
    """How many pairs of equal documents lie in different shards."""
    n = F.col("n").cast("decimal(38,0)")
    by = cohorts.groupBy("g").agg(F.sum("n").cast("decimal(19,0)").alias("z"), F.sum(n * n).cast("decimal(38,0)").alias("q"))
    return int(by.agg(F.sum((F.col("z") * F.col("z") - F.col("q")) / 2).cast("decimal(38,0)")).first()[0] or 0)


def tie_factor(number: int) -> int:
    """By which a round's ties are dealt."""
    return 1 + 7919 * number % (PRIME - 1)


def admitted(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from a to b, so that no shard receives more than it gives and has room for.

    What is too much for a shard is taken off all who wish to go there, by proportion. That
    leaves less to go from theirs, so it is done again until all shards hold. It ends, since the sum falls each time.
    """
    may = {p: n for p, n in wishes.items() if n > 0}
    while True:
        net = [-free for free in room]
        into: list[list[tuple[int, int]]] = [[] for _ in room]
        for (a, b), n in may.items():
            net[a] -= n
            net[b] += n
            into[b].append((a, b))
        if max(net, default=0) <= 0:
            return may
        for b, excess in enumerate(net):
            if excess <= 0:
                continue
            pairs = sorted(into[b], key=lambda p: (-may[p], p))
            total = sum(may[p] for p in pairs)
            off = {p: excess * may[p] // total for p in pairs}
            left = excess - sum(off.values())
            for p in pairs:  # what rounding down has left
                more = min(left, may[p] - off[p])
                left -= more
                may[p] -= off[p] + more
                if not may[p]:
                    del may[p]


def propagate(cohorts: DataFrame, quota: list[int], least: float = 0.001) -> DataFrame:
    """The cohorts (g, s, n) after the rounds; of the sums by shard none is ever above its quota."""
    spark = cohorts.sparkSession
    now = materialize(cohorts, "cohorts")
    before = cut_links(now)
    number, idle = 0, 0
    while idle < PATIENCE:
        load = dict(now.groupBy("s").agg(F.sum("n")).collect())  # a row for each shard
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        if min(room, default=0) < 0:
            raise RuntimeError("a shard is above its quota")
        # a shard that is full but for a fiftieth no longer draws, so a group larger than a shard goes on to the next
        open_ = F.col("s").isin([s for s, r in enumerate(room) if 50 * r > quota[s]])
        rank = F.struct(open_, F.col("n"), F.pmod((F.pmod(F.col("g"), F.lit(PRIME)) + F.col("s")) * tie_factor(number), F.lit(PRIME)))
        goals = now.groupBy("g").agg(F.max_by("s", rank).alias("b"), F.max_by("n", rank).alias("at_b"))
        gain = F.col("at_b") - F.col("n") + 1
        moves = running(
            now.join(goals, "g").filter((F.col("s") != F.col("b")) & (gain > 0)).select("g", "s", "b", "n", (-F.length(F.bin(gain))).alias("turn")),
            ["s", "b", "turn", "g"],
            "n",
        )
        wishes = {(r["s"], r["b"]): r["n"] for r in moves.groupBy("s", "b").agg(F.sum("n").alias("n")).collect()}  # by pair of shards
        may = admitted(wishes, room)
        number += 1
        idle = idle + 1 if sum(may.values()) <= least * sum(load.values()) else 0
        if not may:
            discard(moves)
            continue
        starts = dict(zip(sorted(wishes), accumulate([0, *(wishes[p] for p in sorted(wishes))]), strict=False))
        upto = spark.createDataFrame([(*p, starts[p] + n) for p, n in may.items()], "s int, b int, upto long")  # at most shards * shards rows
        go = moves.join(F.broadcast(upto), ["s", "b"]).select("g", "s", "b", F.least("n", F.col("upto") - F.col("before")).alias("n")).filter("n > 0")
        changed = now.unionByName(go.select("g", "s", (-F.col("n")).alias("n"))).unionByName(go.select("g", F.col("b").alias("s"), "n"))
        after = materialize(changed.groupBy("g", "s").agg(F.sum("n").alias("n")).filter("n > 0"), "cohorts")
        discard(now, moves)
        now = after
    log.info("cut links: %d at the start, %d at the end", before, cut_links(now))
    return now


def _by_bounds(place: Column, counts: list[int]) -> Column:
    """The number of the run of *counts* rows that *place* lies in."""
    out = F.lit(len(counts) - 1)
    for s, upto in reversed(list(enumerate(accumulate(counts)))[:-1]):
        out = F.when(place < upto, F.lit(s)).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = 40, least: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, h1, h2) of every row of *docs*; h1 and h2 tell texts apart."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("h1"), F.xxhash64(F.lit(7), data).alias("h2"),
    )
    narrow = materialize(rows, "rows")
    placed = materialize(indexed(narrow, ["h1", "h2", "doc_id"], "i"), "placed")
    discard(narrow)
    equal = placed.groupBy("h1", "h2").agg(F.min("i").alias("start"), F.count("*").alias("members")).filter("members > 1")
    groups = materialize(running(equal, ["start"], "members", "first"), "groups")
    quota = quotas(placed.count(), shards)
    cohorts = propagate(first_cohorts(groups, shards), quota, least)
    load = dict(cohorts.groupBy("s").agg(F.sum("n")).collect())  # a row for each shard
    # a group's cohorts, at most one for each shard: where its members' ranks end in each
    run = cohorts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("c"))
    ends = F.expr("transform(c, (x, j) -> struct(x.s AS s, aggregate(slice(c, 1, j + 1), 0L, (t, y) -> t + y.n) AS upto))")
    homes = materialize(groups.join(run.select(F.col("g").alias("first"), ends.alias("ends")), "first").select("h1", "h2", "start", "ends"), "homes")
    own = ["doc_id", "size", "text_crc32", "h1", "h2"]
    linked = placed.join(homes, ["h1", "h2"]).select(*own, F.expr("filter(ends, e -> i - start < e.upto)[0].s").alias("shard"))
    alone = indexed(placed.join(groups, ["h1", "h2"], "left_anti").drop("i"), ["h1", "h2", "doc_id"], "k")
    free = [q - load.get(s, 0) for s, q in enumerate(quota)]
    filled = alone.select(*own, _by_bounds(F.col("k"), free).cast("int").alias("shard"))
    dealt = indexed(linked.unionByName(filled), ["shard", "doc_id", "h1", "h2"], "slot")
    begins = F.array(*[F.lit(n).cast("long") for n in accumulate([0, *quota[:-1]])])
    return dealt.withColumn("slot", F.col("slot") - F.element_at(begins, F.col("shard") + 1))
