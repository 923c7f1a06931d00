"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` virtual nodes on a ring of 2^60 positions, and a key lies
on the arc that ends at the next virtual node clockwise. No shard takes more than its
load bound: keys that find a shard full go on clockwise to the next shard with room.

Only the number of keys of each arc decides how far keys go on, so the walk around the
ring is done on one count per arc; a bounded table of ``shards * replicas`` rows. Rows
are then ranked within their arc and looked up in the list of segments that the walk
left. Arcs hold about ``rows / (shards * replicas)`` rows each, so raise ``replicas``
with the table; no step sees a whole shard.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 60
CELL_BITS = 12


def _point(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """Virtual nodes as (position, shard), clockwise."""
    return sorted((_point(f"{shard}:{replica}"), shard) for shard in range(shards) for replica in range(replicas))


def position(*key: Column) -> Column:
    """Where a key lies on the ring: the first 60 bits of the MD5 of its columns' texts; null counts as ''."""
    text = F.concat_ws("\x1f", *(F.coalesce(column.cast("string"), F.lit("")) for column in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """The most rows each shard takes. Without slack they add up to ``rows``, at most one apart."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Send the keys of every arc clockwise until each has a shard.

    ``counts``: keys by arc, which has the index of the virtual node at its end.
    Returns segments (arc, first rank, end rank, shard, first slot): the keys of the arc
    with these ranks go to the shard, where they take the slots from the given one on.
    At each step, all waiting arcs look at their next virtual node at once, in ring
    order; an arc is cut only where a shard becomes full.
    """
    room, used, segments = list(room), [0] * len(room), []
    waiting = [(arc, 0, counts[arc]) for arc in sorted(counts) if counts[arc]]
    step = 0
    while waiting:
        left = []
        for arc, begin, end in waiting:
            shard = nodes[(arc + step) % len(nodes)][1]
            taken = min(end - begin, room[shard])
            if taken:
                segments.append((arc, begin, begin + taken, shard, used[shard]))
                room[shard] -= taken
                used[shard] += taken
            if begin + taken < end:
                left.append((arc, begin + taken, end))
        waiting, step = left, step + 1
        if step > len(nodes):
            raise ValueError("the shards have less room than there are keys")
    return segments


def shard(df: DataFrame, key: list[str], shards: int, replicas: int = 128, slack: float = 0.05) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    With ``slack`` 0 the counts of any two shards are at most one apart; with more, no
    shard gets more than (1 + slack) times the mean and fewer keys move when shards are
    added. Keys keep their arcs whatever the number of rows.

    Rows with equal keys share a position and are ranked by all columns, so the result
    is settled but for rows equal in every column, which are interchangeable. Name enough
    columns as the key that no key holds a large part of the rows. Columns of ``df`` named like a new column are replaced. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    nodes = ring(shards, replicas)
    arcs = spark.createDataFrame(_cells(nodes), "cell int, low long, high long, arc int")
    kept = df.drop(*(c for c in ("shard", "slot") if c not in key))
    names = [c for c in kept.columns if c not in ("shard", "slot")]
    # The rows are kept whole in one column, so that none of their names meets one used here.
    rows = kept.select(F.struct(*names).alias("row"), position(*map(F.col, key)).alias("at"))
    rows = rows.withColumn("cell", F.shiftright("at", 60 - CELL_BITS).cast("int"))
    # Both tables that are broadcast are bounded by the ring: arcs and cells, and one segment an arc and full shard.
    rows = rows.join(F.broadcast(arcs), "cell").filter("at >= low and at < high").select("row", "at", "arc")
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    segments = walk(counts, nodes, bounds(sum(counts.values()), shards, slack))
    table = spark.createDataFrame(segments, "arc int, first long, end long, shard int, slot long")
    order = Window.partitionBy("arc").orderBy("at", *[f"row.{c}" for c in sorted(names)])
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    placed = ranked.join(F.broadcast(table), "arc").filter("rank >= first and rank < end")
    return placed.select("row.*", "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))


def _cells(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """For each cell of an even grid over the ring, the parts (low, high) of arcs in it."""
    ends = [*(at + 1 for at, _ in nodes), RING]  # the last part belongs to the first arc
    size, rows, low, arc = RING >> CELL_BITS, [], 0, 0
    while low < RING:
        cell = low // size
        high = min(ends[arc], (cell + 1) * size)
        if low < high:
            rows.append((cell, low, high, arc % len(nodes)))
        low, arc = high, arc + (high == ends[arc])
    return rows
