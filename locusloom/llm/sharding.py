"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns many arcs of a ring; a row lies where the hash of its text falls, so equal texts
lie together. Loads are bounded: what overflows a full shard continues clockwise to the next arc
whose shard has room. Rows of one arc are ordered, so that an overflow is a range of places: the
number of rows of each arc (a table of ``shards * nodes`` rows, whatever the input) gives the ranges,
and rows find their shard and slot by one join with them. Arcs are dealt over range partitions
by (arc, position, id), so one text that a third of all rows have is spread over many tasks.

With law ``rows`` a load is the number of rows and shards differ by one at most; with law ``bytes`` it is
their bytes and shards differ by about one document.

Defined results: a null text is empty (its hash and crc32 are those of the empty string, its size 8);
repeated rows and null ids have slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.ordering import prefix_totals

#: The ring is divided into so many cells; a virtual node owns the cells up to it.
CELLS = 1 << 14


def arcs(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(end cell, shard) of each virtual node in ring order; nodes that share a cell count once."""
    ends: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % CELLS
            ends.setdefault(cell, shard)
    return sorted(ends.items())


def spread(loads: Sequence[int], owners: Sequence[int], capacity: Sequence[int]) -> list[list[tuple[int, int, int, int]]]:
    """Ranges (from, to, shard, first place in the shard) of each arc's load under the shards' capacities.

    Every arc first fills its own shard; the rest goes clockwise. Nothing is left where the capacities hold it all.
    """
    room, used = list(capacity), [0] * len(capacity)
    ranges: list[list[tuple[int, int, int, int]]] = [[] for _ in loads]

    def place(arc: int, low: int, high: int, shard: int) -> int:
        take = min(high - low, room[shard])
        if take > 0:
            ranges[arc].append((low, low + take, shard, used[shard]))
            used[shard] += take
            room[shard] -= take
        return low + max(0, take)

    rest = [(arc, place(arc, 0, load, owners[arc]), load) for arc, load in enumerate(loads)]
    for arc, low, high in rest:
        step = arc
        while low < high:
            step = (step + 1) % len(loads)
            if step == arc and not any(room):
                raise ValueError("capacities are smaller than the load")
            low = place(arc, low, high, owners[step])
    return ranges


def shard(docs: DataFrame, shards: int = 24, nodes: int = 64, law: str = "rows") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of each row of ``docs``."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    ring = arcs(shards, nodes)
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("position"))
    cells, k = [], 0
    for cell in range(CELLS):
        while k < len(ring) and ring[k][0] < cell:
            k += 1
        cells.append((cell, k % len(ring)))
    of_cell = spark.createDataFrame(cells, "cell int, arc int")  # CELLS rows
    placed = narrow.withColumn("cell", F.shiftrightunsigned("position", 50).cast("int")).join(F.broadcast(of_cell), "cell").drop("cell")
    load = "row" if law == "rows" else "size"
    placed = cut(placed.withColumn("row", F.lit(1).cast("long")))
    total = {r["arc"]: r["load"] for r in placed.groupBy("arc").agg(F.sum(load).alias("load")).collect()}  # at most shards * nodes rows
    loads = [total.get(a, 0) for a in range(len(ring))]
    everything = sum(loads)
    capacity = [everything // shards + (s < everything % shards) for s in range(shards)]
    found = spread(loads, [s for _, s in ring], capacity)
    ranges = spark.createDataFrame([(a, *r) for a, some in enumerate(found) for r in some], "arc int, low long, high long, shard int, base long")  # at most arcs * (1 + shards) rows

    ordered = prefix_totals(placed, ["arc"], ["position", "doc_id", "size", "text_crc32"], sums={"before": load}, rows=None)
    inside = (F.col("before") >= F.col("low")) & (F.col("before") < F.col("high"))
    joined = ordered.join(F.broadcast(ranges), "arc").where(inside)
    if law == "rows":
        slotted = joined.withColumn("slot", F.col("base") + F.col("before") - F.col("low"))
    else:
        slotted = prefix_totals(joined, ["shard"], ["base", "before", "doc_id"], rows="slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
