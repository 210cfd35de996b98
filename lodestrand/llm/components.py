"""Connected components of an edge table by alternating star contraction, with no graph in one place.

Each round shrinks the edges to stars around smaller nodes (large-star, then small-star); the number of
rounds grows with the logarithm of the graph.  Before each round every partition replaces its own edges by
a spanning forest, which keeps what is connected and drops the rest.  Once few enough edges are left
(``LOCAL_EDGES``, a fixed bound), one task ends the work.  Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import stored

#: At most so many edges (16 bytes each) are finished in one task; more go through further rounds.
LOCAL_EDGES = 250_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of a small graph and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that connect what a partition's edges connect; works in pieces of bounded size."""
    us, vs, n = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if us:
            nodes, low = roots(np.concatenate(us), np.concatenate(vs))
            off = nodes != low
            yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(low[off])], names=["u", "v"])

    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        n += len(us[-1])
        if n > 1_000_000:
            yield from out()
            us, vs, n = [], [], 0
    yield from out()


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; root: the smallest node reachable.

    Nodes are bigints without nulls; repeated edges and loops do no harm; no edges give no rows.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = stored(now.mapInArrow(_forest, "u long, v long"))
    seen = None
    while (n := now.count()) > LOCAL_EDGES:
        now = stored(_stars(now).mapInArrow(_forest, "u long, v long"))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        if n:
            now = stored(now.coalesce(1).mapInArrow(_forest, "u long, v long"))
    # now: stars, each node with the smallest one
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
