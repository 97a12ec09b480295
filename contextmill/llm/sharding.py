"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of the ring, and a key belongs to the first point clockwise of
its hash. A shard takes keys up to its capacity; what overflows goes on clockwise to the next
point whose shard has room. The capacities add up to the number of rows, so row counts differ
by at most one, and a new shard moves few rows. DataFrame functions only: rows are sorted once
along the ring, and everything else is arithmetic on counts per virtual node, whose number is
a parameter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.session import materialise

#: Places on the ring; virtual nodes of a shard.
PLACES, VIRTUAL = 1 << 16, 128


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise."""
    if shards < 1 or shards * virtual > PLACES:
        raise ValueError(f"1 to {PLACES // virtual} shards")
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % PLACES
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual))


def capacities(rows: int, shards: int) -> list[int]:
    """Rows that each shard takes: all of them together, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def bounded_segments(owners: Sequence[int], counts: Sequence[int], shards: int) -> list[list[tuple[int, int, int, int]]]:
    """Where the keys of each arc go: per arc, (from, to, shard, first slot) over ranks in it.

    First each shard takes its own keys, arc by arc, up to its capacity; then the overflow of
    each arc, in ring order, walks clockwise over shards with room.
    """
    room, filled = capacities(sum(counts), shards), [0] * shards
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in owners]

    def put(arc: int, start: int, shard: int, left: int) -> int:
        n = min(left, room[shard] - filled[shard])
        if n:
            out[arc].append((start, start + n, shard, filled[shard]))
            filled[shard] += n
        return n

    over = [n - put(a, 0, owners[a], n) for a, n in enumerate(counts)]
    for arc, left in enumerate(over):
        at = arc
        while left:
            at = (at + 1) % len(owners)
            left -= put(arc, counts[arc] - left, owners[at], left)
    return out


def _literal(values: object, kind: str):
    """A constant of any size, folded once by the planner."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def assign_shards(df: DataFrame, key: str, shards: int, order: Sequence[str] = (), virtual: int = VIRTUAL) -> DataFrame:
    """``df`` with shard, slot (gapless from 0 in each shard) and home_shard (without overflow).

    Rows of one ring place are ordered by hash, key and the columns of ``order``; rows equal in
    all of these are interchangeable and may be as many as they like, since the range shuffle
    also splits on a row number. A NULL key is a key like any other. An empty table stays
    empty. Columns of ``df`` named like the three new ones are replaced.
    """
    spark = df.sparkSession
    nodes = ring(shards, virtual)
    arc_of, at = [], 0
    for place in range(PLACES):
        while at < len(nodes) and nodes[at][0] < place:
            at += 1
        arc_of.append(at % len(nodes))
    hashed = F.xxhash64(F.lit("ring"), F.col(key))
    columns = [c for c in df.columns if c not in ("shard", "slot", "home_shard")]
    place = F.shiftrightunsigned(hashed, 48).cast("int")
    rows = df.select(
        *columns,
        F.element_at(_literal(arc_of, "array<int>"), place + 1).alias("__arc"),
        hashed.alias("__hash"),
        F.monotonically_increasing_id().alias("__row"),
    )
    # Ring order: hashes compare as unsigned numbers, like places; the arc after the last node wraps.
    along = ["__arc", "__hash", key, *order, "__row"]
    ranged = rows.repartitionByRange(*along).sortWithinPartitions(*along)
    placed = materialise(ranged.drop("__hash", "__row").withColumn("__at", F.monotonically_increasing_id()), "ring")

    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())  # one row per partition
    starts, total = [0] * (max(sizes, default=0) + 1), 0
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    per_arc = dict(placed.groupBy("__arc").count().collect())  # one row per virtual node
    counts = [per_arc.get(a, 0) for a in range(len(nodes))]
    first = [0]
    for n in counts:
        first.append(first[-1] + n)
    owners = [s for _, s in nodes]
    segments = [[{"f": f, "t": t, "s": s, "b": b} for f, t, s, b in x] for x in bounded_segments(owners, counts, shards)]

    here = F.col("__arc") + 1
    rank = (
        F.element_at(_literal(starts, "array<bigint>"), (part + 1).cast("int")) + within
        - F.element_at(_literal(first, "array<bigint>"), here)
    )
    mine = F.element_at(_literal(segments, "array<array<struct<f:bigint,t:bigint,s:int,b:bigint>>>"), here)
    ranked = placed.withColumn("__rank", rank).withColumn(
        "__segment", F.filter(mine, lambda x: (x.f <= F.col("__rank")) & (F.col("__rank") < x.t))[0]
    )
    return ranked.select(
        *columns,
        F.col("__segment.s").alias("shard"),
        (F.col("__segment.b") + F.col("__rank") - F.col("__segment.f")).alias("slot"),
        F.element_at(_literal(owners, "array<int>"), here).alias("home_shard"),
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, rows as they were ranked along the ring."""
    assigned.write.partitionBy("shard").parquet(path)
