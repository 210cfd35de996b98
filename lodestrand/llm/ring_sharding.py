"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 2**60 positions; a row goes to the first point clockwise from the
hash of its key.  No shard takes more than its bound; rows that meet a full shard go on clockwise to the
next point whose shard has room.  With ``slack=0`` the bounds add up to the number of rows, so the counts
of any two shards differ by one at most, and only the overflow leaves its place.

Who overflows is a fixed rule: all points are served in rounds.  In round 0 each point, in ring order,
offers its own rows, in order of hashes of their payload; in round r it offers what is left to the point r places
clockwise.  That depends just on how many rows each point has, so the rounds are played over the table of
points (shards x virtual nodes rows, however large the data), and each row then finds its shard from its
rank among the rows of its point.  Ranks are taken in small hash ranges and offset by the counts of the
ranges before, so no task sorts a whole shard.

Rows are grouped by key first, which is where equal rows meet with a map-side combine: a key that holds a
third of all rows is one line with a count until its places are given out.

Defined results: a null key is a key of its own (as if it were empty text), a null text counts 0 bytes; equal
rows are spread like others; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import stored

RING_BITS = 60
#: Ranks within a point stay below 2**RANK_BITS.
RANK_BITS = 46
#: Points of the ring that each shard owns.
VIRTUAL_NODES = 64
#: Rows that share a hash range, about; a task numbers such a range at once.
RANGE_ROWS = 20_000
#: Copies of a row given out at once.
COPIES = 4096


def position(key: Column) -> Column:
    """Place of a text on the ring: the first 60 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Positions of all points, ascending, and the shard of each."""
    points = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[: RING_BITS // 4], 16), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in points], [s for _, s in points]


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: (1 + slack) times the even share; without slack the first ones take the remainder."""
    if slack:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def flows(counts: Sequence[int], owners: Sequence[int], most: Sequence[int]) -> list[tuple[int, int, int]]:
    """(point, rank from which, shard): where the rows of each point go, in order of rank."""
    room, left, out = list(most), list(counts), []
    n, live, step = len(counts), [p for p, c in enumerate(counts) if c], 0
    while live and step < n:
        for p in live:
            shard = owners[(p + step) % n]
            if take := min(left[p], room[shard]):
                out.append((p, counts[p] - left[p], shard))
                left[p] -= take
                room[shard] -= take
        live = [p for p in live if left[p]]
        step += 1
    return sorted(out)


def assign(rows: DataFrame, key: str, shards: int, payload: list[str], virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """``payload`` columns of each row with its ``shard`` and its ``slot`` (gapless from 0 in the shard).

    rows are placed by the hash of ``key``; payload: the columns that the result needs, the narrower the better.
    """
    points, owners = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def point(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, places.to_numpy(np.int64)) % len(points)).astype("int32")

    narrow = rows.select(*payload, position(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("__place"))
    once = narrow.groupBy(*payload, "__place").agg(F.count(F.lit(1)).alias("__n"))
    placed = stored(once.withColumn("__point", point("__place")))

    per_point = placed.groupBy("__point").agg(F.sum("__n").alias("n"))
    counts = [0] * len(points)
    for p, n in per_point.collect():  # a line for each point of the ring
        counts[p] = n
    total = sum(counts)
    parts = 1 << (total // (RANGE_ROWS * len(points))).bit_length()
    # Rows of a point are ranked by the hash of all of the payload, which even rows of one hot key don't share.
    text = F.concat_ws("\x1f", *[F.col(f"`{c}`").cast("string") for c in payload])
    fine = placed.withColumn("__order", position(text)).withColumn("__range", F.shiftright("__order", RING_BITS - (parts.bit_length() - 1)))
    by_range = fine.groupBy("__point", "__range").agg(F.sum("__n").alias("__in_range"))
    before = by_range.selectExpr("__point", "__range", "sum(__in_range) over (partition by __point order by __range rows between unbounded preceding and 1 preceding) as __before")
    inside = Window.partitionBy("__point", "__range").orderBy("__order", *payload)
    ranked = (
        fine.withColumn("__run", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
        .join(before, ["__point", "__range"])
        .withColumn("__rank", F.col("__run") + F.coalesce("__before", F.lit(0)))
    )

    # Pieces of (point, ranks) that go to one shard, and the slot at which each begins: a few lines for each point.
    pieces, taken = [], [0] * shards
    steps = flows(counts, owners, bounds(total, shards, slack))
    for i, (p, low, shard) in enumerate(steps):
        high = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == p else counts[p]
        pieces.append((p, low, high, shard, taken[shard]))
        taken[shard] += high - low
    data = rows.sparkSession.sparkContext.broadcast(np.array(pieces, np.int64).reshape(-1, 5))

    copies = ranked.select(*payload, "__point", "__rank", "__n").withColumn("__first", F.explode(F.expr(f"sequence(0L, __n - 1, {COPIES}L)")))
    copies = copies.withColumn("__i", F.explode(F.expr(f"sequence(__first, least(__first + {COPIES - 1}, __n - 1))")))

    @F.pandas_udf("shard int, slot long")
    def place(at: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = data.value
        line = np.searchsorted((found[:, 0] << RANK_BITS) + found[:, 1], (at.to_numpy(np.int64) << RANK_BITS) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"shard": found[line, 3].astype(np.int32), "slot": found[line, 4] - found[line, 1] + rank.to_numpy(np.int64)})

    return copies.withColumn("__to", place("__point", F.col("__rank") + F.col("__i"))).select(*payload, F.col("__to.shard").alias("shard"), F.col("__to.slot").alias("slot"))


def size_of(text: str | Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 16."""
    col = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(col), F.lit(0)) + 16).cast("long")
