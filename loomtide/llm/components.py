"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.shared import drop, save


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key).agg(F.least(F.min(other), F.first(key)).alias("m"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node that occurs in an edge; label is the component's smallest node.

    Edges are written to the shared folder after each round, so that the plan
    stays short and a lost executor costs one round.  A node with many edges is
    reduced by a partial minimum before the shuffle; minima are written too, so
    that the joins read plain exchanges, whose large partitions can be split.  Null ends are ignored.
    """
    cur = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    cur = save(cur.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "cc")
    before = None
    while True:
        # large star: every larger neighbour of a node hangs on the least of its neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(_least(both, "u", "v"), "cc")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        large = large.where("u < v").distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        large = save(large, "cc")
        low = save(large.groupBy("v").agg(F.min("u").alias("m")), "cc")
        small = large.join(low, "v")
        small = small.select(F.col("m").alias("u"), "v").unionByName(small.where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v")))
        nxt = save(small.distinct(), "cc")
        drop(cur, least, large, low)
        cur = nxt
        state = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = cur.select(F.col("u").alias("node")).distinct()
    return cur.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
