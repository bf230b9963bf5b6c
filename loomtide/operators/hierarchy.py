"""Ragged hierarchies: closure, paths, depth-first order, distinct rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.operators.shared import cut

MAX_DEPTH = 64


def closure(tree: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestor, up) of every node of (id, parent_id) with itself and all above it.

    One join a level until no node has a parent left; a cycle ends at ``max_depth``.
    """
    above = cut(tree.where("parent_id IS NOT NULL").select(F.col("id").alias("ancestor"), "parent_id"))
    level = tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("up"))
    out = level
    for up in range(1, max_depth):
        level = cut(level.join(above, "ancestor").select("id", F.col("parent_id").alias("ancestor"), F.lit(up).alias("up")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def count_tree(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(id, path, depth, direct, total, position) of the nodes of (id, parent_id, name) with links (page_id, id).

    ``total`` counts the distinct pages of a subtree; ``position`` numbers the
    nodes depth first, siblings by total, then name.
    """
    up = closure(tree)
    links = links.select("page_id", "id").distinct()
    direct = links.groupBy("id").agg(F.count(F.lit(1)).alias("direct"))
    total = links.join(up, "id").select("page_id", F.col("ancestor").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    sized = tree.select("id", "name").join(direct, "id", "left").join(total, "id", "left").na.fill(0, ["direct", "total"])
    steps = up.join(sized.select(F.col("id").alias("ancestor"), "name", "total"), "ancestor")
    step = F.struct((-F.col("up")).alias("order"), (-F.col("total")).alias("less"), "name")
    paths = steps.groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # max_depth at most
    paths = paths.select("id", F.array_join(F.col("steps.name"), "/").alias("path"), (F.size("steps") - 1).alias("depth"), F.transform("steps", lambda s: F.struct(s["less"], s["name"])).alias("sort_key"))
    return sized.join(paths, "id").select("id", "name", "path", "depth", "direct", "total", "sort_key")
