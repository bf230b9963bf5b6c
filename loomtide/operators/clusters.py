"""Two groups of unit vectors within each tag, by rounds of DataFrame aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.functions import vectors as V
from loomtide.operators.shared import bounded, cut

ROUNDS = 10


def _means(rows: DataFrame) -> DataFrame:
    """(tag, part, centre): normalised sums, one partial sum for each task and dimension."""
    parts = rows.select("tag", "part", F.posexplode("vector").alias("i", "x"))
    sums = parts.groupBy("tag", "part", "i").agg(F.round(F.sum("x"), 9).alias("s"))
    flat = sums.groupBy("tag", "part").agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("s"))  # one entry a dimension
    return flat.select("tag", "part", V.normalized(F.col("s")).alias("centre"))


def _wide(centres: DataFrame) -> DataFrame:
    """(tag, c0, c1); tags with one group only are left out."""
    at = lambda k: F.max_by("centre", F.when(F.col("part") == k, 1))
    wide = centres.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), at(0).alias("c0"), at(1).alias("c1"))
    return wide.where("n = 2").drop("n")


def _assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Group 1 only where its centre is strictly nearer."""
    near = lambda c: F.round(V.dot(F.col("vector"), F.col(c)), 12)
    return rows.join(bounded(centres), "tag").select("tag", "id", "vector", F.when(near("c1") > near("c0"), 1).otherwise(0).alias("part"))


def two_groups(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tag, id, part, similarity) of (tag, id, vector): part 0 or 1, and how alike the two centres are.

    The seeds are the vector of the smallest id and the one least like it.  A
    tag of two vectors gets one in each part; a tag of one vector, or whose
    vectors fall into one group, has part 0 and a null similarity.  No task
    holds a tag's vectors together.  Null vectors are left out.
    """
    rows = vectors.where("vector IS NOT NULL").select("tag", "id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    first = rows.groupBy("tag").agg(F.min_by("vector", "id").alias("c0"))
    far = rows.join(bounded(first), "tag").groupBy("tag").agg(F.first("c0").alias("c0"), F.min_by("vector", F.struct(F.round(V.dot(F.col("vector"), F.col("c0")), 12), "id")).alias("c1"), F.count(F.lit(1)).alias("n"))
    far = cut(far)
    pairs = far.where("n = 2").drop("n")
    centres = far.where("n > 2").drop("n")
    for _ in range(rounds):
        after = cut(_wide(_means(_assign(rows, centres))))
        old = centres.select("tag", F.col("c0").alias("b0"), F.col("c1").alias("b1"))
        moved = after.join(old, "tag").where("c0 != b0 OR c1 != b1")
        settled = moved.isEmpty() and after.count() == centres.count()
        centres = after
        if settled:
            break
    centres = centres.unionByName(pairs)
    out = _assign(rows, centres).join(bounded(centres.select("tag", F.round(V.dot(F.col("c0"), F.col("c1")), 6).alias("similarity"))), "tag").drop("vector")
    rest = rows.join(bounded(centres.select("tag")), "tag", "left_anti").select("tag", "id", F.lit(0).alias("part"), F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(rest)


def split_candidates(vectors: DataFrame, pages: DataFrame, decided: DataFrame, min_pages: int = 2, similarity: float = 0.75, sample: int = 20) -> DataFrame:
    """(tag, id, part, similarity) of the tags whose pages fall into two unlike groups, ``sample`` pages of each.

    ``pages`` is (tag, pages, locked); ``decided`` is (key, decision).  A tag
    remembered as having a single meaning is asked again once it has twice the
    pages, and three more, of the time it was asked.
    """
    past = decided.where(F.col("key").startswith("split:")).select(F.substring("key", 7, 1 << 30).alias("name"), F.regexp_extract("decision", ":([0-9]+)$", 1).alias("asked"))
    asked = F.expr("try_cast(asked AS BIGINT)")
    ready = pages.where(~F.col("locked") & (F.col("pages") >= min_pages)).join(past, F.col("name") == F.col("tag").cast("string"), "left")
    ready = ready.where(F.col("name").isNull() | ((F.col("asked") != "") & (F.col("pages") >= F.greatest(2 * asked, asked + 3)))).select("tag")
    groups = two_groups(vectors.join(ready, "tag", "left_semi")).where(F.col("similarity") <= similarity)
    nth = F.row_number().over(Window.partitionBy("tag", "part").orderBy("id"))
    return groups.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth")
