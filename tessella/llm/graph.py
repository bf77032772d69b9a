"""Connected components by joins: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import BROADCAST_ROWS, discard, stash


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each neighbour (of larger id, or else of smaller) to the smallest id around its node."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(low, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _united(batches):
    """Union-find over all edges (u, v): (node, root) with the smallest node of each component as its root."""
    import numpy as np
    import pyarrow as pa

    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
    node, at = np.unique(ends, return_inverse=True)
    one, two = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(node))
    while True:  # hang the larger root of each edge below the smaller one, then shorten all paths
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])


def components(edges: DataFrame, u: str, v: str, rounds: int = 40) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node reachable. Nodes are longs; null ends are ignored.

    Both star operations aggregate before they shuffle, so a hub costs one row a map task. The smallest neighbours
    are joined by plain equi-joins that adaptive execution can split.
    Links stay distributed; the driver sees one checksum a round. A graph that is counted to be small is united in one
    task instead of in rounds of joins.
    """
    now = stash(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct(), "edges")
    if now.count() * 2 <= BROADCAST_ROWS:  # so many nodes at most
        return now.coalesce(1).mapInArrow(_united, "node long, root long")
    mark = None
    for _ in range(rounds):
        new = stash(_stars(_stars(now, True), False), "edges")
        discard(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    root = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return root.unionAll(root.select(F.col("root").alias("node"), "root").distinct())
