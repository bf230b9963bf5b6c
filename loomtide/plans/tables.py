"""The archive's relations, derived from the example tables, and the same in SQL.

pages gives the fetched pages; the texts of a page's links are its raw tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions import text as T

LINK = '<a href="[^"]*">([^<]*)</a>'


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status(page_id):
    """Page states of the example: most are done."""
    n = page_id % 10
    return F.when(n == 7, "failed").when(n == 8, "unreachable").when(n == 9, "pending").otherwise("done")


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, raw) of every link text."""
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("pos", "raw"))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, raw, name, status) of link texts that make tags."""
    tags = raw_tags(spark, sf_dir).withColumn("name", T.normalize_name(F.col("raw")))
    return tags.where(F.col("name").isNotNull()).withColumn("status", status(F.col("page_id")))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, pages): pages of each tag, pending ones aside."""
    links = page_tags(spark, sf_dir).where("status != 'pending'").select("page_id", "name").distinct()
    return links.groupBy("name").agg(F.count(F.lit(1)).alias("pages"))


#: The same relations for SQL, as common table expressions.
SQL = f"""
raw_tags AS (
    SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS raw
    FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS t FROM pages)),
kebab AS (
    SELECT *, list_filter(list_transform(string_split(bare, '/'), lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')), lambda x: x <> '') AS parts
    FROM (SELECT *, trim(regexp_replace(trim(raw), '^#+', '')) AS bare FROM raw_tags)),
page_tags AS (
    SELECT page_id, pos, raw, name,
        CASE page_id % 10 WHEN 7 THEN 'failed' WHEN 8 THEN 'unreachable' WHEN 9 THEN 'pending' ELSE 'done' END AS status
    FROM (SELECT *, CASE WHEN NOT starts_with(lower(bare), 'status/') THEN parts[-1] END AS name FROM kebab)
    WHERE name IS NOT NULL AND NOT regexp_full_match(name, '[0-9-]+')),
tag_counts AS (
    SELECT name, count(DISTINCT page_id) AS pages FROM page_tags WHERE status <> 'pending' GROUP BY name)"""
