"""Registered queries of the ten operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from loomtide.llm.audio import audio_features
from loomtide.llm.bpe import bpe_roundtrip
from loomtide.llm.exact_dedup import exact_dedup
from loomtide.llm.jaccard_join import jaccard_components
from loomtide.llm.line_dedup import WINDOW, line_dedup
from loomtide.llm.lines import CHARS_A_WORD
from loomtide.llm.mixing import mixture
from loomtide.llm.quality import quality_scores
from loomtide.llm.shared import documents
from loomtide.llm.substring_dedup import MIN_UNIT, MIN_WORDS, substring_dedup
from loomtide.llm.token_counts import token_counts
from loomtide.llm.toxicity import toxicity


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_quality_classifier(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir), _labels(spark, sf_dir)).select("doc_id", "lang", "perplexity", "threshold", "kept")


def _listed(found):
    """Spans as text: first-end,first-end."""
    spans = F.transform("spans", lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.withColumn("spans", F.array_join(spans, ","))


def op4_substring_dedup(spark, sf_dir):
    return _listed(substring_dedup(documents(spark, sf_dir)))


def op5_line_dedup(spark, sf_dir):
    return _listed(line_dedup(documents(spark, sf_dir)))


def op6_media_columns(spark, sf_dir):
    return audio_features(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mixture(documents(spark, sf_dir)).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def op8_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op10_byte_bpe(spark, sf_dir):
    return bpe_roundtrip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_quality_classifier, op4_substring_dedup, op5_line_dedup, op6_media_columns, op7_mixing, op8_toxicity, op9_jaccard_join, op10_byte_bpe)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Units of each text with the break that ends them, and the spaces that normalisation collapses.
_SENTENCES, _LINES = r"[^\n]*?(?:\n|[.!?][ \t]+|[。！？]|$)", r"[^\n]*(?:\n|$)"
_SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def _units_sql(tile: str) -> str:
    """tiles (doc_id, i, tile, first) of every text, and units (doc_id, i, place, norm) of those that aren't blank."""
    return f"""
        p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{tile}') AS t FROM documents),
        q AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS tile FROM p),
        tiles AS (SELECT *, CAST(coalesce(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM q),
        norms AS (SELECT doc_id, i, first, first + length(tile) AS past, lower(trim(regexp_replace(tile, '{_SPACES}', ' ', 'g'))) AS norm FROM tiles),
        units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM norms WHERE norm <> '')"""


def _cut_sql(least: int, longest: int) -> str:
    """What goes, from ``later`` (doc_id, place, start) and ``covered`` (doc_id, place)."""
    return f"""
        islands AS (SELECT u.*, greatest(len(string_split(norm, ' ')), length(norm) // {CHARS_A_WORD}) AS words, u.place - row_number() OVER (PARTITION BY u.doc_id ORDER BY u.place) AS island FROM units u JOIN covered USING (doc_id, place)),
        gone AS (SELECT doc_id, min(place) AS a, max(place) AS z, min(first) AS first, max(past) AS past FROM islands
            GROUP BY doc_id, island HAVING sum(words) >= {least} AND max(words) >= {longest}),
        told AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(past - first) AS BIGINT) AS removed, string_agg(first || '-' || past, ',' ORDER BY first) AS spans FROM gone GROUP BY doc_id),
        counted AS (SELECT l.doc_id, count(*) AS n FROM later l JOIN gone g ON g.doc_id = l.doc_id AND l.start BETWEEN g.a AND g.z GROUP BY l.doc_id),
        kept AS (SELECT t.doc_id, string_agg(tile, '' ORDER BY i) AS text FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND t.first >= g.first AND t.first < g.past) GROUP BY t.doc_id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_repeats, coalesce(n_spans, 0) AS n_spans, coalesce(removed, 0) AS removed_chars, coalesce(spans, '') AS spans, coalesce(kept.text, '') AS text
        FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)"""


ORACLE_SQL = {
    "op4_substring_dedup": f"""
        WITH {_units_sql(_SENTENCES)},
        later AS (SELECT doc_id, place, place AS start FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) AS rank FROM units) WHERE rank > 1),
        covered AS (SELECT doc_id, place FROM later), {_cut_sql(MIN_WORDS, MIN_UNIT)}""",
    "op5_line_dedup": f"""
        WITH {_units_sql(_LINES)},
        windows AS (SELECT doc_id, place, norm || chr(10) || lead(norm, 1) OVER w || chr(10) || lead(norm, 2) OVER w AS norm FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
        ranked AS (SELECT *, row_number() OVER r AS rank, first_value(doc_id) OVER r AS head_doc, first_value(place) OVER r AS head FROM windows WHERE norm IS NOT NULL WINDOW r AS (PARTITION BY norm ORDER BY doc_id, place)),
        later AS (SELECT doc_id, place, CASE WHEN doc_id = head_doc THEN greatest(place, head + {WINDOW}) ELSE place END AS start FROM ranked WHERE rank > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(start, place + {WINDOW})) AS place FROM later), {_cut_sql(1, 1)}""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (
            SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
                WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END) AS shingle
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)
        LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x) k USING (doc_id)""",
}


def all_queries():
    """The ten operators."""
    return dict(QUERIES)
