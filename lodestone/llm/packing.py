"""Filling fixed-capacity containers with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Items that one task packs.  A larger group packs tighter, a smaller one sooner.
SHARD_ITEMS = 40_000
#: Partly filled containers whose items one task packs in the second round.
OPEN_CONTAINERS = 20_000


class SumOfSquares:
    """Online packing: an item goes where the sum of the squared numbers of partly
    filled containers per fill level grows least (a new container included); of equal
    places the fullest is taken.  ``open[level]`` lists the containers of a level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """Container of an item of 1 to capacity tokens."""
        c = self.capacity
        low = self.count[1 : c - size + 1]
        used = np.flatnonzero(low) + 1
        best, gain = 0, (2 * self.count[size] + 1 if size < c else 0)
        if len(used):
            # from level h to h + size; a full container is counted no more
            grow = 2 * self.count[used + size] + 1
            grow[used + size == c] = 0
            delta = grow - 2 * self.count[used] + 1
            k = len(delta) - 1 - int(np.argmin(delta[::-1]))
            if delta[k] <= gain:
                best = int(used[k])
        if best:
            box = self.open[best].pop()
            self.count[best] -= 1
        else:
            box, self.made = self.made, self.made + 1
        if best + size < c:
            self.open[best + size].append(box)
            self.count[best + size] += 1
        return box


def _pack(sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item, and fill of each container."""
    ss = SumOfSquares(capacity)
    boxes = [ss.place(int(s)) for s in sizes]
    fill = [capacity] * ss.made
    for level, held in enumerate(ss.open):
        for b in held:
            fill[b] = level
    return boxes, fill


def _first_round(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values(["order", "doc_id", "piece"])
    boxes, fill = _pack(shard["size"].to_numpy(), int(shard["capacity"].iloc[0]))
    return pd.DataFrame(
        {
            "container_kind": shard["container_kind"], "capacity": shard["capacity"], "shard": shard["shard"], "doc_id": shard["doc_id"],
            "piece": shard["piece"], "size": shard["size"], "box": boxes, "fill": [fill[b] for b in boxes],
        }
    )


def best_fit(sizes: np.ndarray, capacity: int) -> list[int]:
    """Container of each item: in the order given, where the least room is left over."""
    rooms: list[int] = []  # different amounts of room, in order
    boxes: dict[int, list[int]] = {}
    out, made = [], 0
    for s in map(int, sizes):
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            box = boxes[room].pop()
            if not boxes[room]:
                del boxes[room], rooms[k]
        else:
            room, box, made = capacity, made, made + 1
        if room > s:
            if room - s not in boxes:
                insort(rooms, room - s)
                boxes[room - s] = []
            boxes[room - s].append(box)
        out.append(box)
    return out


def _second_round(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
    before = group.drop_duplicates(["shard", "box"])
    boxes = best_fit(group["size"].to_numpy(), int(group["capacity"].iloc[0]))
    if len(group) and max(boxes) + 1 > len(before):  # no better: as they were
        number = {k: n for n, k in enumerate(zip(before["shard"], before["box"]))}
        boxes = [number[k] for k in zip(group["shard"], group["box"])]
    return pd.DataFrame({"container_kind": group["container_kind"], "doc_id": group["doc_id"], "piece": group["piece"], "tokens": group["size"], "to_part": group["part"], "to_box": boxes})


def packed(sizes: DataFrame, capacities: DataFrame, seed: int = 7) -> DataFrame:
    """container_kind, doc_id, piece, tokens, container_id: where each document, or
    each piece of one longer than the capacity, is put.

    A longer document is divided into full pieces and a rest; full pieces and items as
    large as the capacity have a container for themselves.  The others are packed
    online by sum of squares, in shards drawn by a hash of the document, so that any
    number of documents is packed by tasks of like size.  What a shard leaves are the
    partly filled containers, as many as its level array holds at its end, however many
    documents there are; their items are packed again, the largest first, each where the
    least room is left over, so that little is lost at the borders of shards and none of
    a small table.

    Documents of no tokens are in no container, kinds without a positive capacity give
    no rows; of equal kinds the least capacity counts.  The same input and seed give
    the same containers.
    """
    kinds = capacities.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").cast("bigint").alias("capacity"))
    # kinds: as many rows as there are container sizes; one row per document after this
    every = kinds.agg(F.collect_list(F.struct("container_kind", "capacity")).alias("kinds"))
    listed = [r.asDict() for r in every.first()["kinds"]]
    items = cut(sizes.where("doc_id is not null and tokens > 0").select("doc_id", "tokens"))
    if not listed:
        listed = [{"container_kind": None, "capacity": 1}]
        items = items.where("false")
    kind = F.explode(F.array(*[F.struct(F.lit(k["container_kind"]).cast("string").alias("container_kind"), F.lit(k["capacity"]).alias("capacity")) for k in listed]))
    by_kind = items.select("doc_id", "tokens", kind.alias("k")).select("doc_id", "tokens", "k.*")
    full = by_kind.where("tokens >= capacity").select(
        "container_kind", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("tokens") / F.col("capacity")) - 1)).alias("piece"), F.col("capacity").alias("tokens")
    )
    rest = by_kind.withColumn("size", F.col("tokens") % F.col("capacity")).where("size > 0").withColumn("piece", F.floor(F.col("tokens") / F.col("capacity")))
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    order = F.xxhash64(F.lit(seed), "doc_id")
    sharded = rest.select("container_kind", "capacity", "doc_id", "piece", "size", order.alias("order"), F.pmod(F.xxhash64(order), F.lit(shards)).alias("shard"))
    first = cut(
        sharded.groupBy("container_kind", "shard").applyInPandas(
            _first_round, "container_kind string, capacity bigint, shard bigint, doc_id bigint, piece bigint, size bigint, box bigint, fill bigint"
        )
    )
    left = first.where("fill < capacity")
    parts = max(1, -(-left.select("container_kind", "shard", "box").distinct().count() // OPEN_CONTAINERS))
    again = left.withColumn("part", F.pmod(F.xxhash64("shard", "box"), F.lit(parts))).groupBy("container_kind", "part").applyInPandas(
        _second_round, "container_kind string, doc_id bigint, piece bigint, tokens bigint, to_part bigint, to_box bigint"
    )
    out = lambda df, tokens, *name: df.select("container_kind", "doc_id", "piece", F.col(tokens).alias("tokens"), F.concat_ws("-", *name).alias("container_id"))
    return (
        out(first.where("fill = capacity"), "size", F.lit("s"), "shard", "box")
        .unionByName(out(again, "tokens", F.lit("m"), "to_part", "to_box"))
        .unionByName(out(full, "tokens", F.lit("f"), "doc_id", "piece"))
    )


def packing_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """container_kind, capacity_tokens, containers, tokens, items, fill (share of room used)."""
    kinds = capacities.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    boxes = placed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    sums = boxes.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"))
    return sums.join(kinds, "container_kind").select("container_kind", "capacity_tokens", "containers", "tokens", "items", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
