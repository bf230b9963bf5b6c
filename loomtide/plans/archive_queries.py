"""Queries over the archive: tags, links, runs, budgets and changes of tags."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtide.functions import replies as R
from loomtide.functions import text as T
from loomtide.functions import urls as U
from loomtide.operators.changes import apply_changes, undo_last
from loomtide.operators.shared import checkpoint_folder, collect_bounded
from loomtide.plans import report, tables
from loomtide.plans.registry import registry
from loomtide.plans.scalar_queries import _DECODED, HOST_SQL
from loomtide.plans.tables import read
from loomtide.sources.state import State

QUERIES, ORACLE_SQL, query = registry()
def _rows(f, **kinds):
    """A function of one row of an aggregated table, given as dicts, over Arrow batches."""
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([f(r) for r in b.to_pylist()], schema)

    return run


WITH = f"WITH {tables.SQL}"
RECURSIVE = f"WITH RECURSIVE {tables.SQL}"


@query(f"{WITH} SELECT name, CAST(pages AS BIGINT) AS pages FROM tag_counts")
def page_tag_counts(spark, sf_dir):
    return tables.tag_counts(spark, sf_dir)


@query(f"{WITH} SELECT DISTINCT page_id, name FROM page_tags WHERE status <> 'pending'")
def tag_links(spark, sf_dir):
    return tables.page_tags(spark, sf_dir).where("status != 'pending'").select("page_id", "name").distinct()


@query(f"{WITH} SELECT name, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM page_tags WHERE status = 'done' GROUP BY name ORDER BY pages DESC, name")
def topic_tags(spark, sf_dir):
    done = tables.page_tags(spark, sf_dir).where("status = 'done'").select("page_id", "name").distinct()
    return done.groupBy("name").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "name")


@query(f"{WITH} SELECT name, CAST(pages AS BIGINT) AS pages FROM tag_counts ORDER BY pages DESC, name LIMIT 50")
def most_used_tags(spark, sf_dir):
    return tables.tag_counts(spark, sf_dir).orderBy(F.desc("pages"), "name").limit(50)


@query(f"""{WITH}, top AS (SELECT name, pages FROM tag_counts ORDER BY pages DESC, name LIMIT 50)
    SELECT string_agg(name || ' (' || CAST(pages AS VARCHAR) || ')', chr(10) ORDER BY name) AS vocabulary FROM top""")
def vocabulary_text(spark, sf_dir):
    """The 50 most used tags as prompt lines, by name."""
    top = most_used_tags(spark, sf_dir).select(F.concat("name", F.lit(" ("), F.col("pages").cast("string"), F.lit(")")).alias("line"), "name")
    return top.agg(F.array_join(F.array_sort(F.collect_list(F.struct("name", "line")))["line"], "\n").alias("vocabulary"))


@query(f"{WITH} SELECT page_id FROM pages WHERE page_id % 10 < 7 AND page_id NOT IN (SELECT page_id FROM page_tags WHERE pos > 5)")
def untagged_pages(spark, sf_dir):
    """Done pages without a tag from the seventh link on."""
    pages = read(spark, sf_dir, "pages").where(tables.status(F.col("page_id")) == "done").select("page_id")
    return pages.join(tables.page_tags(spark, sf_dir).where("pos > 5"), "page_id", "left_anti")


@query(f"""{WITH}, f AS (SELECT name, min(page_id) AS born FROM page_tags GROUP BY name)
    SELECT CAST(count(*) AS BIGINT) AS new_tags FROM f WHERE born >= 100 AND NOT starts_with(name, 'status/')""")
def new_tags_since(spark, sf_dir):
    born = tables.page_tags(spark, sf_dir).groupBy("name").agg(F.min("page_id").alias("born"))
    return born.where((F.col("born") >= 100) & ~F.col("name").startswith(T.RESERVED)).agg(F.count(F.lit(1)).alias("new_tags"))


@query(f"""{WITH}, k AS (SELECT *, replace(name, '-', '') AS key FROM page_tags),
    o AS (SELECT key, name AS tag, row_number() OVER (PARTITION BY key ORDER BY page_id, pos) AS n FROM k)
    SELECT DISTINCT k.page_id, o.tag, k.name <> o.tag AS by_alias FROM k JOIN o ON o.key = k.key AND o.n = 1""")
def tag_resolution(spark, sf_dir):
    """Set form: spellings that differ in hyphens are one tag, named by the first page that uses it."""
    tags = tables.page_tags(spark, sf_dir).withColumn("key", T.squash(F.col("name")))
    owner = tags.groupBy("key").agg(F.min_by("name", F.struct("page_id", "pos")).alias("tag"))
    return tags.join(owner, "key").select("page_id", "tag", (F.col("name") != F.col("tag")).alias("by_alias")).distinct()


@query("""SELECT CAST(count(*) FILTER (WHERE s = 0) AS BIGINT) AS done, CAST(count(*) FILTER (WHERE s = 1) AS BIGINT) AS failed,
    CAST(count(*) FILTER (WHERE s = 2) AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE s = 3) AS BIGINT) AS unreachable
    FROM (SELECT CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS s FROM events)""")
def status_counts(spark, sf_dir):
    e = F.col("event_type")
    s = F.when(e == "error", "failed").when(e == "signup", "pending").when(e == "purchase", "unreachable").otherwise("done")
    counts = read(spark, sf_dir, "events").select(s.alias("s"))
    return counts.agg(*(F.count_if(F.col("s") == k).alias(k) for k in ("done", "failed", "pending", "unreachable")))


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN code IN (404, 410) THEN 'not_found' WHEN code IN (401, 403, 429) THEN 'blocked'
    WHEN code >= 400 THEN 'http_error' ELSE 'unknown' END AS kind
    FROM (SELECT 400 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 35 AS code FROM events WHERE event_type = 'error')) GROUP BY kind ORDER BY kind""")
def failure_kinds(spark, sf_dir):
    code = (400 + F.get_json_object("props", "$.k").cast("int") % 35).alias("code")
    counts = read(spark, sf_dir, "events").where("event_type = 'error'").groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.mapInArrow(_rows(lambda r: {"kind": R.fetch_error(r["code"]) if r["code"] is not None else "unknown", "n": r["n"]}, kind=pa.string(), n=pa.int64()), "kind string, n long")
    return kinds.groupBy("kind").agg(F.sum("n").alias("n")).orderBy("kind")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END AS ok FROM events),
    g AS (SELECT *, sum(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
    n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM g WHERE ok = 0)
    SELECT user_id, event_id FROM n WHERE streak = 5""")
def failure_streak(spark, sf_dir):
    """Where the fifth failure in a row stops a run; a success starts the count again."""
    bad = F.col("event_type").isin("error", "view")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("island", F.sum((~bad).cast("int")).over(order))
    nth = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return e.where(bad).withColumn("streak", nth).where("streak = 5").select("user_id", "event_id")


@query("""SELECT doc_id, CAST(before AS BIGINT) AS spent FROM (SELECT doc_id, source, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT doc_id, source, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens FROM documents)) WHERE before < 20000""")
def budget_admission(spark, sf_dir):
    """Pages of each run, in order, that start while less than the budget is spent."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return docs.withColumn("spent", F.coalesce(before, F.lit(0).cast("long"))).where("spent < 20000").select("doc_id", "spent")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS requests, CAST(sum(coalesce(k, 0)) AS BIGINT) AS input_tokens, CAST(count(*) FILTER (WHERE k IS NULL) AS BIGINT) AS without_usage,
    CAST(sum(coalesce(k, 0)) // nullif(count(k), 0) AS BIGINT) AS per_reply FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY event_type""")
def usage_rollup(spark, sf_dir):
    k = F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("long"))
    rows = read(spark, sf_dir, "events").select("event_type", k.alias("k"))
    per = F.expr("coalesce(sum(k), 0) div nullif(count(k), 0)")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("input_tokens"), F.count_if(F.col("k").isNull()).alias("without_usage"), per.alias("per_reply"))


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 0.0 WHEN user_id % 3 = 1 THEN round((i * 0.15 + o * 0.6) / 1000000, 9) END AS cost FROM (
    SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS i, CAST(count(*) * 20 AS DOUBLE) AS o FROM events GROUP BY user_id)""")
def run_cost(spark, sf_dir):
    """A local server costs nothing; a server without prices has no cost."""
    k = F.get_json_object("props", "$.k").cast("long")
    sums = read(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.sum(k), F.lit(0)).alias("input_tokens"), (F.count(F.lit(1)) * 20).alias("output_tokens"))

    def one(r):
        found = report.cost(r, ((0.0, 0.0), (0.15, 0.6), None)[r["user_id"] % 3])
        return {"user_id": r["user_id"], "cost": None if found is None else round(found, 9)}

    return sums.mapInArrow(_rows(one, user_id=pa.int64(), cost=pa.float64()), "user_id long, cost double")


@query(f"""{WITH}, d AS (SELECT name, pages, 3 + (length(name) % 5) AS asked FROM tag_counts)
    SELECT name, CAST(pages AS BIGINT) AS pages FROM d WHERE pages >= greatest(2 * asked, asked + 3)""")
def decision_filter(spark, sf_dir):
    """Tags asked before are asked again once they have grown enough; the answer holds the pages it was given for."""
    key = F.concat(F.lit("single-meaning:"), (3 + F.char_length("name") % 5).cast("string"))
    asked = F.regexp_extract(key, ":([0-9]+)$", 1).cast("long")
    return tables.tag_counts(spark, sf_dir).where(F.col("pages") >= F.greatest(2 * asked, asked + 3)).select("name", "pages")


@query(f"""{WITH}, l AS (SELECT DISTINCT page_id, name FROM page_tags WHERE status <> 'pending'),
    r AS (SELECT l.page_id, l.name, row_number() OVER (PARTITION BY l.page_id ORDER BY c.pages DESC, l.name) AS n FROM l JOIN tag_counts c USING (name))
    SELECT p.page_id, coalesce(r.name, 'Untagged') AS section FROM pages p LEFT JOIN r ON r.page_id = p.page_id AND r.n = 1 WHERE p.page_id % 10 <> 9""")
def page_to_section(spark, sf_dir):
    """A page stands under its most used tag."""
    links = tag_links(spark, sf_dir).join(tables.tag_counts(spark, sf_dir), "name")
    main = links.groupBy("page_id").agg(F.min_by("name", F.struct(-F.col("pages"), "name")).alias("section"))
    pages = read(spark, sf_dir, "pages").where(tables.status(F.col("page_id")) != "pending").select("page_id")
    return pages.join(main, "page_id", "left").select("page_id", F.coalesce("section", F.lit("Untagged")).alias("section"))


@query(f"""{WITH}, t AS (SELECT page_id, url, {_DECODED} AS title FROM pages WHERE page_id % 10 < 7),
    g AS (SELECT page_id, string_agg('  - "' || name || '"', chr(10) ORDER BY name) AS tags, string_agg('#' || name, ' ' ORDER BY name) AS hash
        FROM (SELECT DISTINCT page_id, name FROM page_tags) GROUP BY page_id)
    SELECT t.page_id, md5('---' || chr(10) || 'url: ' || CAST(to_json(url) AS VARCHAR) || chr(10) || 'title: ' || CAST(to_json(title) AS VARCHAR) || chr(10) || 'source: list' || chr(10) ||
        CASE WHEN tags IS NULL THEN 'tags: []' ELSE 'tags:' || chr(10) || tags END || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
        || '**URL:** <' || url || '>' || chr(10) || CASE WHEN hash IS NULL THEN '' ELSE chr(10) || hash || chr(10) END) AS digest
    FROM t LEFT JOIN g USING (page_id)""")
def note_text(spark, sf_dir):
    """Notes of done pages: front matter, heading, address and hashtags; shown by digest."""
    pages = read(spark, sf_dir, "pages").where(tables.status(F.col("page_id")) == "done").select("page_id", "url", T.html_title(F.col("html")).alias("title"))
    names = tables.page_tags(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    tags = F.coalesce(F.concat(F.lit("tags:\n"), F.array_join(F.transform("names", lambda t: F.concat(F.lit('  - "'), t, F.lit('"'))), "\n")), F.lit("tags: []"))
    hashes = F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("names", lambda t: F.concat(F.lit("#"), t)), " "), F.lit("\n")), F.lit(""))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("url: "), T.json_string(F.col("url"))), F.concat(F.lit("title: "), T.json_string(F.col("title"))), F.lit("source: list"), tags, F.lit("---"), F.lit(""))
    body = F.concat(F.lit("\n# "), "title", F.lit("\n\n**URL:** <"), "url", F.lit(">\n"))
    return pages.join(names, "page_id", "left").select("page_id", F.md5(F.concat(head, body, hashes).cast("binary")).alias("digest"))


@query(f"""SELECT page_id, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS VARCHAR) END || '.md' AS file FROM (
    SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM (
    SELECT page_id, left(regexp_replace({HOST_SQL}, '[^a-z0-9]+', '-', 'g'), 80) AS base FROM pages))""")
def note_files(spark, sf_dir):
    """Unique file names: the second page of a base gets -2, and so on."""
    pages = read(spark, sf_dir, "pages").select("page_id", T.slug(U.host(F.col("url"))).alias("base"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("page_id"))
    pages = pages.withColumn("n", nth)
    return pages.select("page_id", F.concat("base", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("-"), F.col("n").cast("string"))), F.lit(".md")).alias("file"))


@query("""SELECT run_id, CAST(len(list_filter([out_tokens > 1500, in_tokens > 0.8 * 4000, gpu < 0.95, done >= 10 AND cut * 10 >= done * 3, done >= 10 AND invalid * 10 > done, errors > 0], lambda x: x)) AS INTEGER) AS warnings FROM (
    SELECT user_id AS run_id, sum(k) * 40 // count(*) AS out_tokens, sum(k) * 70 // count(*) AS in_tokens, avg(k) / 50.0 AS gpu, count(*) AS done,
        count(*) FILTER (WHERE event_type = 'view') AS cut, count(*) FILTER (WHERE event_type = 'error') AS invalid, count(*) FILTER (WHERE event_type = 'signup' AND k > 95) AS errors
    FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id)""")
def run_warnings(spark, sf_dir):
    """How many of the six threshold rules a run breaks."""
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    runs = read(spark, sf_dir, "events").withColumn("k", k).groupBy("user_id").agg(
        (F.sum("k") * 40).alias("output_tokens"), (F.sum("k") * 70).alias("input_tokens"), (F.avg("k") / 50).alias("gpu_share"), F.count(F.lit(1)).alias("done"), F.count(F.lit(1)).alias("requests"),
        F.count_if(kind == "view").alias("pages_cut"), F.count_if(kind == "error").alias("invalid"), F.count_if((kind == "signup") & (F.col("k") > 95)).alias("embedding_errors"), F.lit(4000).alias("context"),
    )
    return runs.mapInArrow(_rows(lambda r: {"run_id": r["user_id"], "warnings": len(report.warnings(r))}, run_id=pa.int64(), warnings=pa.int32()), "run_id long, warnings int")


_MERGED = f"""{WITH}, m AS (SELECT a.name AS old, min(b.name) AS new FROM tag_counts a JOIN tag_counts b ON b.name = a.name || 's' GROUP BY a.name)"""


def _plural_merges(spark, sf_dir):
    names = tables.tag_counts(spark, sf_dir).select("name")
    return names.select(F.col("name").alias("old"), F.concat("name", F.lit("s")).alias("new")).join(names.select(F.col("name").alias("new")), "new")


def _archive(spark, sf_dir) -> State:
    """An archive directory of its own with the tags and links of the example."""
    state = State(spark, f"{checkpoint_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}")
    used = tables.page_tags(spark, sf_dir).select("page_id", F.col("raw").alias("raw_tag"), "name").distinct()
    tags, following = state.numbered("tags", used.select("name").distinct(), ["name"])
    plain = {"parent_id": F.lit(None), "description": F.lit(None), "locked": F.lit(False), "created_at": F.current_timestamp(), "placed": F.lit(False)}
    links = used.join(tags.select("name", F.col("id").alias("resolved_tag_id")), "name")
    state.commit(tags=tags.withColumns(plain), page_tags=links, next_id={"tags": following})
    return state


def _tagged(state: State):
    names = state.table("tags").select(F.col("id").alias("resolved_tag_id"), F.col("name").alias("tag"))
    return state.table("page_tags").join(names, "resolved_tag_id").select("page_id", F.col("raw_tag").alias("raw"), "tag")


def _merged(spark, sf_dir) -> State:
    state = _archive(spark, sf_dir)
    pairs = collect_bounded(_plural_merges(spark, sf_dir).orderBy("old"), "merges")
    failed = apply_changes(state, [{"op": "merge", "from": r["old"], "into": r["new"]} for r in pairs])
    if failed:
        raise ValueError(f"merges failed: {failed[:3]}")
    return state


@query(f"{_MERGED} SELECT DISTINCT page_id, raw, coalesce(m.new, name) AS tag FROM page_tags LEFT JOIN m ON m.old = name")
def merge_apply(spark, sf_dir):
    """Singular tags merged into their plurals in an archive: rows change their tag, never their raw text."""
    return _tagged(_merged(spark, sf_dir))


@query(f"{WITH} SELECT DISTINCT page_id, raw, name AS tag FROM page_tags")
def undo_merge(spark, sf_dir):
    """The same merges, undone from the revision that the archive recorded: the state before them."""
    state = _merged(spark, sf_dir)
    undo_last(state)
    return _tagged(state)


@query(f"""{WITH}, big AS (SELECT name FROM tag_counts ORDER BY pages DESC, name LIMIT 1)
    SELECT DISTINCT page_id, CASE WHEN name IN (SELECT name FROM big) THEN name || CASE WHEN page_id % 2 = 0 THEN '-even' ELSE '-odd' END ELSE name END AS tag FROM page_tags""")
def split_apply(spark, sf_dir):
    """The most used tag of an archive divided in two; every page of it goes to a part."""
    state = _archive(spark, sf_dir)
    big = tables.tag_counts(spark, sf_dir).orderBy(F.desc("pages"), "name").first()
    if big is not None:
        pages = [r["page_id"] for r in collect_bounded(_tagged(state).where(F.col("tag") == big["name"]).select("page_id").distinct(), "pages of a tag")]
        parts = [{"name": f"{big['name']}-{kind}", "pages": [p for p in pages if p % 2 == n]} for n, kind in enumerate(("even", "odd"))]
        failed = apply_changes(state, [{"op": "split", "tag": big["name"], "parts": [p for p in parts if p["pages"]]}])
        if failed:
            raise ValueError(f"the split failed: {failed}")
    return _tagged(state).select("page_id", "tag").distinct()


@query(f"""{WITH}, l AS (SELECT DISTINCT page_id, name FROM page_tags WHERE status = 'done'), c AS (SELECT name, count(*) AS n FROM l GROUP BY name)
    SELECT CAST(count(*) AS BIGINT) AS tags, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS used_once, CAST(sum(n) AS BIGINT) AS links FROM c""")
def reuse_metrics(spark, sf_dir):
    """How many tags done pages have, how many of them stand on one page only, and the links in all."""
    n = F.col("pages")
    return topic_tags(spark, sf_dir).agg(F.count(F.lit(1)).alias("tags"), F.count_if(n == 1).alias("used_once"), F.sum(n).alias("links"))


@query(f"""{WITH}, l AS (SELECT DISTINCT page_id, name FROM page_tags WHERE status = 'done'),
    r AS (SELECT name, page_id, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n, count(*) OVER (PARTITION BY name) AS pages FROM l)
    SELECT name || ' (' || CAST(any_value(pages) AS VARCHAR) || CASE WHEN any_value(pages) = 1 THEN ' page' ELSE ' pages' END || ', e.g. ' || string_agg(CAST(page_id AS VARCHAR), ', ' ORDER BY page_id) || ')' AS about FROM r WHERE n <= 2 GROUP BY name""")
def tag_examples(spark, sf_dir):
    """A tag with its number of pages and the first two of them."""
    links = tables.page_tags(spark, sf_dir).where("status = 'done'").select("page_id", "name").distinct()
    nth = F.row_number().over(Window.partitionBy("name").orderBy("page_id"))
    first = links.withColumn("n", nth).where("n <= 2").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), ", ").alias("eg"))
    rows = first.join(links.groupBy("name").agg(F.count(F.lit(1)).alias("pages")), "name")
    return rows.select(F.concat("name", F.lit(" ("), T.noun(F.col("pages"), "page", "pages"), F.lit(", e.g. "), "eg", F.lit(")")).alias("about"))
