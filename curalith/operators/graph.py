"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from curalith.storage import materialise


#: A node with at least this share of all edges is a hub; there are at most 2 / HUB of them.
HUB = 1 / 1000
#: Edges that no node needs to be a hub for.
FEW = 1000


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Rows ``(u, v)`` with ``m``, the least v of their u. Least ones are formed before the shuffle; those of hubs, whose
    number is bounded, are broadcast, so that no task gets all edges of a hub, and the others meet by a shuffle."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    bound = max(FEW, math.ceil(total * HUB))
    if total < bound:  # no node can have so many edges
        return rows.join(low.drop("c"), "u")
    low = materialise(low, "least")
    hot = low.where(F.col("c") >= bound).select("u", "m")
    cold = low.where(F.col("c") < bound).select("u", "m")
    if hot.isEmpty():
        return rows.join(cold, "u")
    return rows.join(F.broadcast(hot), "u").unionByName(rows.join(F.broadcast(hot.select("u")), "u", "left_anti").join(cold.hint("merge"), "u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)``: the smallest node that is reachable, for each node of an edge.

    Alternates large-star and small-star steps until no edge changes; each round is two shuffles of the edge table, each
    with map-side minima, and neither gathers the neighbours of a hub. Self-loops and repeated edges are harmless; edges
    with a null end are left out; an empty table gives an empty one.
    """
    a, b = F.col(src), F.col(dst)
    cur = materialise(
        edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    before, total = None, cur.count()
    for _ in range(max_rounds):
        # large-star: neighbours above a node move to the least of its neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * total).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "edges")  # read twice below
        # small-star: a node's lower neighbours, and itself, move to the least of them
        small = _with_least(large, total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        cur = materialise(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
