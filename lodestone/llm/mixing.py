"""Mixing sources to target shares of the total size."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Documents of a source that one window orders.
SHARD_ROWS = 20_000
#: Shards, or groups of shards, among which one task apportions blocks.
FAN = 1_000
#: Blocks that the whole mix consists of, about.
BLOCKS = 20_000


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """Seats by highest quotients weight / (2 * got + 1); nobody gets more than
    ``most``.  Equal quotients: the lower key.  Seats that nobody may take stay free.

    The quotient that the last seat has is found by halving, which leaves at most a few
    seats per key to hand out one by one.
    """
    most = most or {}
    keys = sorted(k for k, w in weights.items() if w and w > 0)
    cap = {k: most.get(k, seats) for k in keys}
    got = dict.fromkeys(weights, 0)
    if not keys or seats <= 0:
        return got
    least = lambda q: {k: min(cap[k], max(0, int((weights[k] / q + 1) / 2))) for k in keys}
    low, high = 0.0, 2.0 * max(weights[k] for k in keys) + 1
    for _ in range(80):
        q = (low + high) / 2
        low, high = (low, q) if sum(least(q).values()) <= seats else (q, high)
    got |= least(high)
    queue = [(-weights[k] / (2 * got[k] + 1), k) for k in keys if got[k] < cap[k]]
    heapq.heapify(queue)
    for _ in range(seats - sum(got.values())):
        if not queue:
            break
        _, k = heapq.heappop(queue)
        got[k] += 1
        if got[k] < cap[k]:
            heapq.heappush(queue, (-weights[k] / (2 * got[k] + 1), k))
    return got


def _apportioned(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(map(int, group["child"]), map(int, group["tokens"])))
        most = {k: n * int(group["most"].iloc[0]) // size + 1 for k, n in own.items()}
        got = sainte_lague(own, int(group["seats"].iloc[0]), most)
        return pd.DataFrame({"source": group["source"].iloc[0], "child": list(got), "seats": list(got.values())})

    return run


def shard_seats(held: DataFrame, facts: DataFrame, size: int, shards: int, fan: int = FAN) -> DataFrame:
    """source, shard, tokens, seats: the seats of each source apportioned to its shards by
    the tokens they hold.  With more than ``fan`` shards, seats go to groups of shards
    first, then within each group, so that no task sees more than ``fan`` of them and
    none of them is sent to the driver."""
    held = cut(held)
    levels = 1
    while fan**levels < shards:
        levels += 1
    seats = facts.select("source", F.lit(0).cast("bigint").alias("parent"), "seats")
    for level in range(levels - 1, -1, -1):
        child = F.floor(F.col("shard") / fan**level).cast("bigint")
        groups = held.groupBy("source", child.alias("child")).agg(F.sum("tokens").alias("tokens")).withColumn("parent", F.floor(F.col("child") / fan).cast("bigint"))
        asked = groups.join(seats, ["source", "parent"]).join(facts.select("source", "most"), "source")
        seats = asked.groupBy("source", "parent").applyInPandas(_apportioned(size), "source string, child bigint, seats bigint").withColumnRenamed("child", "parent")
    return held.join(seats.withColumnRenamed("parent", "shard"), ["source", "shard"])


def mixed(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) and its report (source, target_share,
    max_repeats, available_tokens, chosen_tokens, reached_share, documents).

    ``total_tokens``: the size wanted; without it the largest at which every source
    that has documents meets its share, given how often it may be repeated.  The total
    is a number of equal-token blocks.  Sainte-Laguë apportionment gives each source a
    whole number of blocks by its target, never more than its documents repeated
    max_repeats times have; then, likewise, each shard of a source by what it holds.
    In a shard documents stand in a seeded order and fall into blocks by the tokens
    before them; a quota of q blocks of b takes every block q // b times and the first
    q % b once more.  So totals are off by less than a document per shard.

    Targets without documents reach 0 and leave their share to the others in
    proportion; documents whose source has no target, or of no tokens, are not chosen.
    Targets of null source or share count as none; a null or negative max_repeats is 0;
    of several targets for a source the largest counts.  All that is sent to the driver
    is one row per source with a target.
    """
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))).alias("g"))
    goal = goal.select("source", "g.target_share", "g.max_repeats")
    rows = cut(sizes.where("tokens > 0").select("doc_id", "source", "tokens").join(goal.select("source", "max_repeats"), "source"))
    have = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("longest")).collect()}
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in goal.collect()}
    present = {s: w for s, (w, most) in wanted.items() if s in have and most > 0}
    share_sum = sum(present.values()) or 1.0
    room = {s: have[s]["tokens"] * wanted[s][1] for s in present}
    total = total_tokens or int(min((room[s] * share_sum / present[s] for s in present), default=0))
    size = max(1, total // blocks)
    quota = sainte_lague(present, round(total / size) if total else 0, {s: room[s] // size for s in present})

    spark = sizes.sparkSession
    facts = spark.createDataFrame([(s, max(1, -(-have[s]["n"] // SHARD_ROWS)), wanted[s][1], quota[s]) for s in present], "source string, shards bigint, most bigint, seats bigint")
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = rows.join(facts.select("source", "shards"), "source").withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards"))).drop("shards")
    seats = shard_seats(placed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")), facts, size, max((-(-have[s]["n"] // SHARD_ROWS) for s in present), default=1))
    # q blocks of size tokens, out of the shard's tokens: whole rounds, then the first of the seeded order
    whole = F.floor(F.col("seats") * size / F.col("tokens"))
    full = whole >= F.col("most")
    quotas = seats.join(facts.select("source", "most"), "source").select(
        "source", "shard", F.when(full, F.col("most")).otherwise(whole).cast("int").alias("rounds"), F.when(full, 0).otherwise(F.col("seats") * size - whole * F.col("tokens")).alias("rest")
    )
    before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    ordered = placed.withColumn("before", F.coalesce(before, F.lit(0))).join(quotas, ["source", "shard"])
    # a document belongs to the block in which its middle lies
    once_more = F.when(F.col("before") + F.col("tokens") / 2 < F.col("rest"), 1).otherwise(0)
    mix = ordered.select("doc_id", "source", "tokens", (F.col("rounds") + once_more).alias("copies")).where("copies > 0")
    chosen = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"), F.count(F.lit(1)).alias("documents"))
    available = rows.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = (
        goal.join(available, "source", "left")
        .join(chosen, "source", "left")
        .select("source", "target_share", "max_repeats", zero("available_tokens"), zero("chosen_tokens"), zero("documents"))
    )
    sums = Window.partitionBy()  # one row per source
    return mix, report.withColumn("reached_share", F.coalesce(F.try_divide(F.col("chosen_tokens"), F.sum("chosen_tokens").over(sums)), F.lit(0.0)))
