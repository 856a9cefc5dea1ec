"""Connected components of an edge table of any size, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its partners. The minimum is combined before the shuffle, so a hub costs no more than others."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches.

    Alternates two steps until nothing changes: link each node's larger partners to the least node of its
    neighbourhood, then link each node and its smaller partners to the least of these. Both keep the
    components and shorten paths, so the number of rounds grows with the logarithm of the longest path.
    Edges with a null end are no edges; self loops give a component of one node; an empty table gives none.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = now.where("u = v").select("u").distinct()
    links = now.where("u > v")
    before = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        joined = large.join(_least(large), "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        links = cut(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    linked = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node")).distinct()
    alone = nodes.select(F.col("u").alias("node")).join(linked.select("node"), "node", "left_anti").join(roots, "node", "left_anti")
    return linked.unionByName(roots.select("node", F.col("node").alias("root"))).unionByName(alone.select("node", F.col("node").alias("root")))
