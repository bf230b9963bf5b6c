"""Groups tied by an edge table, by propagating the least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.operators.shared import cut


def groups(edges: DataFrame) -> DataFrame:
    """(node, merge_group): the smallest node reachable.

    A round takes the least label among the neighbours, then the label of that
    label, so that long chains need few rounds; it ends when no label moves.
    """
    edges = cut(edges.select("u", "v"))  # read twice, made once
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        low = cut(label.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l")))
        jump = low.select(F.col("u").alias("l"), F.col("l").alias("far"))
        label = cut(low.join(jump, "l").select("u", "was", F.least("l", "far").alias("l")))
        if label.where("l < was").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("merge_group"))
        label = label.drop("was")
