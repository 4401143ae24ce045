"""Connected components of an edge table, without gathering it anywhere.

Edges are first contracted: each of a bounded number of partitions, of at most about
``CHUNK`` edges, replaces its edges by a spanning star per part it sees (every node to the
smallest). If one partition held them all this is the answer; else alternating large-star
and small-star rounds link the forests, each round cut by a checkpoint, until nothing moves.
Nodes are longs; the component is its smallest node. Nodes without edges are not returned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut

CHUNK = 1_000_000
#: Edges of a node from which on it is not a join key, but broadcast; there are at most edges / HOT such nodes.
HOT = 100_000
MAX_BROADCAST = 1_000_000


def _stars(batches):
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(part, np.int64)), pa.array(np.array([find(x) for x in part], np.int64))], names=["u", "v"]
        )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round; edges (u, v) have u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))).withColumn("m", F.least("u", "m"))
    # The edges of a giant component's root would all be one key's.
    hot = low.filter(F.col("n") > HOT).select("u", "m")
    few = 0 < hot.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    if few:
        hub = F.broadcast(hot)
        joined = both.join(hub, "u").unionByName(both.join(F.broadcast(hot.select("u")), "u", "left_anti").join(low.select("u", "m"), "u"))
    else:
        joined = both.join(low.select("u", "m"), "u")
    if large:
        made = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return made.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of an edge."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes_alone = e.filter("u = v").select("u", "v")
    e = cut(e.filter("u <> v"))
    n = e.count()
    parts = max(1, -(-n // chunk))
    forest = cut((e.coalesce(1) if parts == 1 else e.repartition(parts)).mapInArrow(_stars, "u long, v long"))
    if parts > 1:
        while True:
            nxt = cut(_star(_star(forest, True), False))
            moved = nxt.exceptAll(forest).limit(1).count() + forest.exceptAll(nxt).limit(1).count()
            forest = nxt
            if not moved:
                break
    found = forest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    alone = nodes_alone.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found, "node", "left_anti")
    return found.unionByName(roots).unionByName(alone).distinct()
