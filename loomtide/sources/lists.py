"""URL lists: one address a line, with an optional title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtide.functions import urls as U


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, url, title) of (line_no, value): blank lines and those that start with # are dropped."""
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    rows = lines.select("line_no", value.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", r"(?U)^(\S+)\s*(.*)$", i)
    return rows.select("line_no", part(1).alias("url"), F.nullif(part(2), F.lit("")).alias("title"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url, title) of a text file or folder; numbers follow the order of the files and of their lines."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_lines(lines)


def classify(lines: DataFrame, archive: DataFrame, allow: list[str] = (), deny: list[str] = ()) -> DataFrame:
    """(line_no, url, original_url, title, outcome) of each line against (url, status) of the archive.

    Outcomes: ``invalid``, ``not_web``, ``duplicate`` of an earlier line (told
    before the rules are asked), ``filtered``, ``known``, ``new``.
    """
    rows = lines.select("line_no", F.col("url").alias("original_url"), "title", U.normalize_url(F.col("url")).alias("url"), U.rejection(F.col("url")).alias("rejected"))
    web, other = rows.where("rejected IS NULL"), rows.where("rejected IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("url").orderBy("line_no"))
    seen = web.withColumn("nth", nth).join(archive.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
    outcome = F.when(F.col("nth") > 1, "duplicate").when(~U.allowed(F.col("url"), list(allow), list(deny)), "filtered").when(F.col("known"), "known").otherwise("new")
    columns = ["line_no", "url", "original_url", "title"]
    return seen.select(*columns, outcome.alias("outcome")).unionByName(other.select(*columns, F.col("rejected").alias("outcome")))
