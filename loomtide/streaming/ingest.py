"""Pages as a stream: a landing folder of lists or results, committed once a batch to the state directory.

The files of a batch are committed together with its rows, so that a restart
neither loses nor repeats a page, also with a lost checkpoint or another number
of files a batch: a file is known by path, size and time.  Each batch sees the
tags of those before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.functions import urls as U
from loomtide.operators.resolution import BATCH_PAGES, known_names, resolve
from loomtide.operators.shared import bounded, collect_bounded, cut
from loomtide.sources.state import State, insert_or_ignore, save_results

RESULTS = "url string, status string, error string, error_kind string, title string, summary string, lang string, page_title string, tags array<string>, new_tags array<struct<name:string,description:string>>"


_FILE = ["path", "size", "modified"]

#: What a reserved tag says.
_STUBS = {"unreachable": "Pages that didn't load", "failed": "Pages that loaded and couldn't be summarized"}


def stubbed(rows: DataFrame) -> DataFrame:
    """Rows with (url, browser_title, page_title, status, error, error_kind): those that aren't done get a title, that of the link before the page's own before the address, and a sentence with the cause."""
    missed = F.col("status") != "done"
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    saved, own = given("browser_title"), given("page_title")
    what = F.when(F.col("status") == "unreachable", "loaded").otherwise("summarized")
    whence = F.when(saved.isNotNull(), "was saved with the link").when(own.isNotNull(), "is the page's own").otherwise("is its address")
    cause = F.coalesce(given("error"), F.replace("error_kind", F.lit("_"), F.lit(" ")), F.lit("cause unknown"))
    sentence = F.concat(F.lit("No summary: this page couldn't be "), what, F.lit(" ("), cause, F.lit("). The title "), whence, F.lit("."))
    title = F.coalesce(saved, own, F.regexp_replace("url", "^[^:/]+://", ""))
    either = lambda stub, c: F.when(missed, stub).otherwise(F.col(c))
    return rows.withColumns({"title": either(title, "title"), "summary": either(sentence, "summary"), "page_title": either(F.coalesce(saved, own), "page_title")})


def save_batch(state: State, rows: DataFrame, name: str, max_per_page: int = 5, max_new: int = 3, files: DataFrame | None = None) -> None:
    """Commits a batch, and the ``files`` that it came from, of RESULTS rows for known pages; several rows of a url count as one, the last by title and summary.

    Pages that couldn't be read or summarised get one reserved tag that tells so, a title and a sentence (:func:`stubbed`).
    """
    pages = state.table("pages").select("id", "url", "browser_title")
    stub = F.when(F.col("status") == "done", F.col("tags")).otherwise(F.array(F.concat(F.lit(T.RESERVED), "status")))
    one = rows.groupBy("url").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "url")), F.struct("status", "title", "summary")).alias("r")).select("url", "r.*")
    rows = stubbed(one.join(pages, "url")).withColumn("tags", stub).drop("browser_title")
    folder = state.root + "/incoming/" + name
    rows.write.mode("overwrite").parquet(folder)  # read several times below
    rows = state.spark.read.parquet(folder)
    done = collect_bounded(rows.select("id", "title", "tags", "new_tags", "status").orderBy("id"), "pages in a batch", 10 * BATCH_PAGES)
    names = rows.select(F.explode("tags").alias("raw")).select(T.normalize_name(F.col("raw")).alias("name"))
    reserved = rows.where("status != 'done'").select(F.concat(F.lit(T.RESERVED), "status").alias("name")).distinct()
    known = known_names(state.table("tags"), state.table("tag_aliases"), names)
    got = resolve([r.asDict(recursive=True) for r in done if r["status"] == "done"], known, state.next_id("tags"), max_per_page, max_new)
    ids = {r["name"]: r["id"] for r in state.table("tags").join(reserved, "name", "left_semi").collect()}  # two names at most
    for r in done:
        if r["status"] != "done":
            tag = T.RESERVED + r["status"]
            if tag not in ids:
                ids[tag], got.next_id = got.next_id, got.next_id + 1
                got.tags.append((ids[tag], tag, _STUBS.get(r["status"])))
            got.links.append((r["id"], tag, ids[tag]))
    spark, now = state.spark, F.current_timestamp()
    links = spark.createDataFrame(got.links, "page_id long, raw_tag string, resolved_tag_id long")
    tags = spark.createDataFrame(got.tags, "id long, name string, description string").withColumns({"locked": F.lit(False), "placed": F.lit(False), "created_at": now})
    aliases = spark.createDataFrame(got.aliases, "alias string, tag_id long").withColumns({"source": F.lit("rule"), "locked": F.lit(False), "created_at": now})
    results = rows.select("id", "status", "error", "error_kind", "title", "summary", F.nullif(F.lower(F.trim("lang")), F.lit("")).alias("lang"), "page_title").withColumn("processed_at", now)
    known = {} if files is None else {"files": state.table("files").unionByName(files)}
    state.commit(
        batch=name,
        **known,
        next_id={"tags": got.next_id},
        tags=state.table("tags").unionByName(tags, allowMissingColumns=True),
        tag_aliases=insert_or_ignore(state.table("tag_aliases"), aliases, ["alias"]),
        **save_results(state, results, links),
    )


def _run(stream, checkpoint: str, each: Callable) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_urls(spark: SparkSession, landing: str, root: str, checkpoint: str, allow: list[str] = (), deny: list[str] = (), files: int = 100) -> None:
    """Adds the addresses of (url, title) JSON files in a landing folder as pending pages, each once."""
    stream = spark.readStream.schema("url string, title string").option("maxFilesPerTrigger", files).json(landing)

    def each(batch: DataFrame, number: int) -> None:
        url = U.normalize_url(F.col("url"))
        rows = batch.select(F.monotonically_increasing_id().alias("line_no"), url.alias("url"), F.col("url").alias("original_url"), "title").where("url IS NOT NULL")
        State(batch.sparkSession, root).add_pages(rows.where(U.allowed(F.col("url"), list(allow), list(deny))))

    _run(stream, checkpoint, each)


def ingest_results(spark: SparkSession, landing: str, root: str, checkpoint: str, files: int = 1, max_per_page: int = 5, max_new: int = 3) -> None:
    """Saves RESULTS rows of JSON files in a landing folder, a batch at a time; one batch holds at most 20,000 pages."""
    stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files).json(landing)
    source = [F.col(f"_metadata.file_{c}").alias(f"_{n}") for c, n in (("path", "path"), ("size", "size"), ("modification_time", "modified"))]
    stream = stream.select("*", *source)

    def each(batch: DataFrame, number: int) -> None:
        state = State(batch.sparkSession, root)
        found = batch.select(*(F.col(f"_{n}").alias(n) for n in _FILE)).distinct()
        new = cut(found.join(state.table("files"), _FILE, "left_anti"))
        if new.isEmpty():
            return
        rows = batch.join(bounded(new), [F.col(f"_{n}") == new[n] for n in _FILE], "left_semi").drop(*(f"_{n}" for n in _FILE))
        save_batch(state, rows, f"results-{uuid.uuid4().hex}", max_per_page, max_new, files=new)

    _run(stream, checkpoint, each)
