"""Queries over URLs, page text, tag names and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.functions import urls as U
from loomtide.plans import tables
from loomtide.plans.registry import registry
from loomtide.plans.tables import read

QUERIES, ORACLE_SQL, query = registry()

_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
NORM_SQL = f"""
    SELECT page_id, url, CASE
        WHEN q = '' OR len(kept) = 0 THEN base
        WHEN len(kept) < len(params) THEN base || '?' || replace(array_to_string(kept, '&'), '%20', '+')
        ELSE base || '?' || q END AS norm
    FROM (SELECT *, list_filter(params, lambda p: NOT starts_with(p, 'utm_') AND string_split(p, '=')[1] NOT IN ({_TRACK})) AS kept
        FROM (SELECT page_id, url, string_split(q, '&') AS params, q,
            lower(regexp_extract(u, '^([^:]+://[^/?#]+)', 1)) || CASE WHEN path = '' THEN '/' ELSE path END AS base
            FROM (SELECT page_id, url, trim(url) AS u, regexp_extract(trim(url), '^[^:]+://[^/?#]+([^?#]*)', 1) AS path,
                regexp_extract(trim(url), '\\?([^#]*)', 1) AS q FROM pages)))"""
HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"


@query(f"SELECT page_id, norm FROM ({NORM_SQL})")
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm"))


@query(f"""SELECT page_id, url_key, n = 1 AS kept FROM (
    SELECT page_id, url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS n
    FROM (SELECT page_id, regexp_extract(norm, '^([^:]+://[^/]+/[a-z]*)', 1) AS url_key FROM ({NORM_SQL})))""")
def url_dedupe(spark, sf_dir):
    key = F.regexp_extract(U.normalize_url(F.col("url")), "^([^:]+://[^/]+/[a-z]*)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", key.alias("url_key"))
    first = pages.groupBy("url_key").agg(F.min("page_id").alias("first_id"))
    return pages.join(first, "url_key").select("page_id", "url_key", (F.col("page_id") == F.col("first_id")).alias("kept"))


def _filtered(spark, sf_dir, allow, deny):
    pages = read(spark, sf_dir, "pages")
    return pages.where(U.allowed(F.col("url"), allow, deny)).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE {HOST_SQL} = 'example.com' OR {HOST_SQL} LIKE '%.example.com'")
def url_filter_domain(spark, sf_dir):
    return _filtered(spark, sf_dir, ["domain:*.example.com"], [])


@query("SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://.*/en/.*')")
def url_filter_glob(spark, sf_dir):
    return _filtered(spark, sf_dir, ["glob:https://*/en/*"], [])


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, 'blog\\.[a-z]+\\.example')")
def url_filter_regex(spark, sf_dir):
    return _filtered(spark, sf_dir, [r"regex:blog\.[a-z]+\.example"], [])


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')")
def url_filter_prefix(spark, sf_dir):
    return _filtered(spark, sf_dir, ["prefix:https://m."], [])


@query(f"""SELECT page_id, url FROM pages WHERE ({HOST_SQL} LIKE '%.example.com' OR {HOST_SQL} = 'example.com' OR starts_with(url, 'https://'))
    AND NOT (regexp_full_match(url, '.*/de/.*') OR regexp_matches(url, 'utm_source'))""")
def url_filter_combined(spark, sf_dir):
    return _filtered(spark, sf_dir, ["domain:example.com", "prefix:https://"], ["glob:*/de/*", "regex:utm_source"])


@query(f"""WITH l AS (SELECT page_id, regexp_extract(norm, '^([^:]+://[^/]+/[a-z]*)', 1) AS k FROM ({NORM_SQL})),
    c AS (SELECT k, page_id, row_number() OVER (PARTITION BY k ORDER BY page_id) AS n FROM l),
    s AS (SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN regexp_matches(k, '/de$') THEN 'filtered'
        WHEN k IN (SELECT k FROM l WHERE page_id % 2 = 0 AND page_id < 100) THEN 'known' ELSE 'added' END AS outcome FROM c)
    SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY outcome""")
def import_stats(spark, sf_dir):
    """Every line in order: a repeat counts as one before any filter is asked."""
    lines = url_dedupe(spark, sf_dir)
    archive = lines.where((F.col("page_id") % 2 == 0) & (F.col("page_id") < 100)).select("url_key").distinct().withColumn("known", F.lit(True))
    outcome = F.when(~F.col("kept"), "duplicate").when(~U.allowed(F.col("url_key"), [], ["regex:/de$"]), "filtered").when(F.col("known"), "known").otherwise("added")
    return lines.join(archive, "url_key", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(count(*) FILTER (WHERE s IS NULL) AS BIGINT) AS new_pages, CAST(count(*) FILTER (WHERE s = 'done') AS BIGINT) AS already_done,
    CAST(count(*) FILTER (WHERE s IN ('failed', 'unreachable', 'pending')) AS BIGINT) AS from_archive,
    CAST(least(count(*) FILTER (WHERE s IS NULL OR s <> 'done'), 100) AS BIGINT) AS to_process
    FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' END AS s FROM pages)""")
def dry_run_plan(spark, sf_dir):
    n = F.col("page_id") % 4
    s = read(spark, sf_dir, "pages").select(F.when(n == 0, "done").when(n == 1, "failed").when(n == 2, "pending").alias("s"))
    waits = F.count_if(F.col("s").isin("failed", "unreachable", "pending"))
    todo = F.count_if(F.col("s").isNull() | (F.col("s") != "done"))
    return s.agg(F.count_if(F.col("s").isNull()).alias("new_pages"), F.count_if(F.col("s") == "done").alias("already_done"), waits.alias("from_archive"), F.least(todo, F.lit(100).cast("long")).alias("to_process"))


@query(f"""SELECT regexp_replace({HOST_SQL}, '^(www\\.)+', '') AS domain, CAST(count(*) AS BIGINT) AS pages FROM pages
    GROUP BY 1 ORDER BY pages DESC, domain LIMIT 8""")
def top_domains(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("domain")).where("domain != ''")
    return hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "domain").limit(8)


@query(f"""SELECT page_id, host, CAST((row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) // 2 AS BIGINT) AS wave
    FROM (SELECT page_id, {HOST_SQL} AS host FROM pages)""")
def host_throttle_plan(spark, sf_dir):
    """At most two pages of a host at a time."""
    pages = read(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    nth = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return pages.withColumn("wave", F.floor((nth - 1) / 2))


_TITLE_SQL = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
_DECODED = f"replace(replace(replace(replace(replace({_TITLE_SQL}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&')"


@query(f"SELECT page_id, nullif({_DECODED}, '') AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)),
    lambda l: trim(regexp_replace(l, '[\\s\\p{Z}]+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS digest FROM documents""")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(left(text, 12000)) AS digest, length(text) > 12000 AS cut FROM documents")
def truncate_text(spark, sf_dir):
    part, cut = T.truncated(F.col("text"), 12_000)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(part.cast("binary")).alias("digest"), cut.alias("cut"))


@query("SELECT CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE length(text) > 12000) AS BIGINT) AS pages_cut FROM documents")
def pages_cut(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.char_length("text") > 12_000).alias("pages_cut"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def language_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


@query(f"WITH {tables.SQL} SELECT page_id, pos, raw, name FROM page_tags")
def tag_normalize(spark, sf_dir):
    return tables.page_tags(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "raw", "name")


@query(f"""SELECT page_id, coalesce(nullif(rtrim(left(ltrim(regexp_replace(lower({_DECODED}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), 80), '-'), ''), 'page') AS slug FROM pages""")
def tag_slug(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.slug(F.coalesce(T.html_title(F.col("html")), F.lit(""))).alias("slug"))


@query(f"""WITH {tables.SQL}, t AS (SELECT name, regexp_extract(name, '([^-]*)$', 1) AS last FROM tag_counts),
    h AS (SELECT name, last, left(name, length(name) - length(last)) AS head,
        length(last) > 3 AND last LIKE '%s' AND NOT regexp_matches(last, '(ss|us|is)$') AS p, last NOT LIKE '%s' AS s FROM t),
    v AS (SELECT name, last, head, unnest([
        CASE WHEN p AND last LIKE '%ies' THEN regexp_replace(last, 'ies$', 'y') END, CASE WHEN p AND last LIKE '%es' THEN regexp_replace(last, 'es$', '') END,
        CASE WHEN p THEN regexp_replace(last, 's$', '') END, CASE WHEN s THEN last || 's' END,
        CASE WHEN s AND regexp_matches(last, '(x|z|ch|sh)$') THEN last || 'es' END, CASE WHEN s AND last LIKE '%y' THEN regexp_replace(last, 'y$', 'ies') END]) AS w FROM h)
    SELECT DISTINCT least(v.name, c.name) AS a, greatest(v.name, c.name) AS b, 'merge:' || least(v.name, c.name) || '|' || greatest(v.name, c.name) AS decision_key
    FROM v JOIN tag_counts c ON c.name = v.head || v.w WHERE v.w <> '' AND v.w <> v.last""")
def plural_pairs(spark, sf_dir):
    tags = tables.tag_counts(spark, sf_dir).select("name")
    found = tags.select("name", F.explode(T.plural_variants(F.col("name"))).alias("other")).join(tags.select(F.col("name").alias("other")), "other")
    return found.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"), T.pair_key(F.col("name"), F.col("other")).alias("decision_key")).distinct()


@query("""WITH m AS (SELECT conv_id, turn, '{"role":"' || role || '","chars":' || CAST(length(text) AS VARCHAR) || '}' AS j FROM conversations)
    SELECT conv_id, '{"model":"local","messages":[' || string_agg(j, ',' ORDER BY turn) || ']}' AS body FROM m GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    """Request bodies: the messages of a conversation in order, texts shown by their length."""
    one = F.struct("turn", F.to_json(F.struct("role", F.char_length("text").alias("chars"))).alias("j"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return rows.select("conv_id", F.concat(F.lit('{"model":"local","messages":['), F.array_join(F.col("m.j"), ","), F.lit("]}")).alias("body"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'T' || CAST(doc_id AS VARCHAR) END AS title,
    doc_id % 4 < 2 AS valid FROM documents""")
def reply_parse(spark, sf_dir):
    """Replies with and without fences; a blank title or summary makes a reply invalid, as does text without an object."""
    doc = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"title":"T'), doc, F.lit('","summary":"s","tags":["a"]}'))
    n = F.col("doc_id") % 4
    reply = F.when(n == 0, body).when(n == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(n == 2, F.lit('{"title":" ","summary":"s"}')).otherwise(F.lit("no object"))
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "title string, summary string, tags array<string>")
    rows = read(spark, sf_dir, "documents").select("doc_id", parsed.alias("r"))
    good = F.coalesce((F.trim("r.title") != "") & (F.trim("r.summary") != ""), F.lit(False))
    return rows.select("doc_id", F.when(good, F.trim("r.title")).alias("title"), good.alias("valid"))
