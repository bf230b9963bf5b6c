"""A corpus pipeline: quality, exact dedup, near-duplicate dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` has the
columns of documents.  ``run`` writes each stage's rows to the shared folder and
reads them again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from loomtide.llm.bpe import bpe_roundtrip
from loomtide.llm.exact_dedup import exact_dedup
from loomtide.llm.jaccard_join import jaccard_components, text_digest
from loomtide.llm.mixing import mixture
from loomtide.llm.quality import quality_scores
from loomtide.llm.shared import bounded, documents, lower_ascii, row_key, save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs):
    """The rows with the name that stages give them: by doc_id and text."""
    return docs.select(*COLUMNS, *row_key(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))


def quality(spark, docs, sf_dir):
    """Rows that the quality classifier rejects go; rows without text go."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = save(scores.where(~F.col("kept")).select("k", "digest").distinct(), "rejected")
    return _keyed(docs).join(bounded(rejected), ["k", "digest"], "left_anti").select(*COLUMNS)


def _named(doc, sha):
    """The key of a row in the exact stage: its doc_id, and a digest of it and of the digest of its text."""
    return F.coalesce(doc, F.lit(0)).alias("k"), F.xxhash64(doc, sha).alias("digest")


def exact(spark, docs, sf_dir):
    """One row of each group of equal texts stays, one with the largest doc_id.

    Rows are named by what they hold, never by their place in a scan: a second
    scan may be split in another way, say after an executor was lost.  Of rows
    that repeat the doc_id and the text, one stays.
    """
    found = exact_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = found.select(*_named(F.col("doc_id"), F.col("text_sha256"))).groupBy("k", "digest").agg(F.count(F.lit(1)).alias("rows"))
    kept = save(kept, "kept")
    keyed = docs.select(*COLUMNS, *_named(F.col("doc_id").cast("long"), F.sha2(lower_ascii(F.col("text")), 256)))
    out = keyed.join(bounded(kept.where("rows = 1").drop("rows")), ["k", "digest"], "left_semi").select(*COLUMNS)
    repeated = kept.where("rows > 1").drop("rows")
    if repeated.isEmpty():
        return out
    again = keyed.join(bounded(repeated), ["k", "digest"], "left_semi")
    again = again.groupBy("k", "digest").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return out.unionByName(again)


def near(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays (five words, 0.8): the one with the group's smallest doc_id.

    A null doc_id ranks last; of different texts under one doc_id, one stays.  Rows without words are in no group and
    stay.  Rows that repeat doc_id and text are decided alike (the stage before leaves one).
    """
    found = jaccard_components(docs).where("label is not null").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row"))
    found = save(found, "near")
    heads = save(found.groupBy("label").agg(F.min("row").alias("head")), "heads")
    dropped = found.join(heads, "label").where("row != head").select(F.coalesce("row.doc_id", F.lit(0)).alias("k"), "row.digest")
    dropped = save(dropped, "dropped")
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), text_digest(F.col("text")).alias("digest"))
    return keyed.join(bounded(dropped), ["k", "digest"], "left_anti").select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """The documents of the mixture; none is repeated, so each leaf gives one epoch at most."""
    chosen = save(mixture(docs, max_epochs=1).select("k", "digest").distinct(), "chosen")
    return _keyed(docs).join(bounded(chosen), ["k", "digest"], "left_semi").select(*COLUMNS)


def tokens(spark, docs, sf_dir):
    """Token counts and digests of ids and of decoded bytes."""
    return save(bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "tokens")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language-model scores and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
