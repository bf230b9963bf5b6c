"""Exact dedup by deterministic block naming (DataFrame functions only).

Each text is cut into blocks of a fixed byte length.  Distinct blocks are sorted
and get integer names; then adjacent pairs of names are sorted and named in the
same way, level by level, until one name is left per document.  Equal texts get
equal names and different texts different ones: no digest decides equality.

Text crosses the network once (the distinct blocks, combined before the
shuffle).  Afterwards a block travels as a 64-bit locator; locators that stand
for more than one distinct block are found and those blocks are named by
content instead, so a locator clash cannot merge two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.shared import drop, lower_ascii, save

BLOCK_BYTES = 4096
_CLASH = 31  # level tag of blocks that are named by content


def _tagged(level: int):
    """Sorted rows get rising integers; the level tag keeps the names of all levels apart."""
    return F.lit(level << 58).bitwiseOR(F.monotonically_increasing_id())


def _blocks(norm, block_bytes: int):
    raw = F.to_binary(norm, F.lit("utf-8"))
    last = F.greatest(F.ceil(F.octet_length(norm) / F.lit(block_bytes)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, locator_bits: int = 64) -> DataFrame:
    """(rid, doc_id, sha, name): one row per input row; equal ``name`` iff equal normalised text.

    ``locator_bits`` below 64 forces locator clashes (for tests of that path).
    """

    def locate(block):
        h = F.xxhash64(block)
        return h if locator_bits == 64 else F.pmod(h, F.lit(1 << locator_bits))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), lower_ascii(F.col(text_col)).alias("norm"))
    rows = rows.select("rid", "doc_id", F.sha2(F.col("norm"), 256).alias("sha"), _blocks(F.col("norm"), block_bytes).alias("blocks"))
    occ = rows.select("rid", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    occ = save(occ.select("rid", "doc_id", "sha", "n", "pos", locate(F.col("block")).alias("h")), "blocks")

    content = docs.select(F.explode(_blocks(lower_ascii(F.col(text_col)), block_bytes)).alias("block"))
    content = content.select(locate(F.col("block")).alias("h"), "block")
    distinct = content.groupBy("h", "block").agg(F.count(F.lit(1)).alias("uses"))
    names = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).orderBy("h")
    names = save(names.withColumn("name", _tagged(0)), "names")

    cur = occ.join(names, "h")
    clashing = names.where("variants > 1").select("h")
    if not clashing.isEmpty():
        exact = save(content.join(clashing, "h", "left_semi").distinct().orderBy("h", "block").withColumn("exact", _tagged(_CLASH)), "clash")
        sites = rows.select("sha", F.posexplode("blocks").alias("pos", "block")).withColumn("h", locate(F.col("block")))
        sites = sites.join(clashing, "h", "left_semi").distinct().join(exact, ["h", "block"]).select("sha", "pos", "exact")
        cur = cur.join(sites, ["sha", "pos"], "left").withColumn("name", F.coalesce("exact", "name"))
    cur = save(cur.select("rid", "doc_id", "sha", "n", "pos", "name"), "level0")
    drop(occ)

    most = cur.agg(F.max("n")).first()[0] or 1
    done = [cur.where("n = 1")]
    for level in range(1, (most - 1).bit_length() + 1):
        pairs = cur.where("n > 1").groupBy("rid", "doc_id", "sha", "n", F.shiftright("pos", 1).alias("p")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r")
        )
        named = save(pairs.where("r is not null").select("l", "r").distinct().orderBy("l", "r").withColumn("name", _tagged(level)), f"pairs{level}")
        up = pairs.join(named, ["l", "r"], "left")
        cur = save(up.select("rid", "doc_id", "sha", F.shiftright(F.col("n") + 1, 1).alias("n"), F.col("p").alias("pos"), F.coalesce("name", "l").alias("name")), f"level{level}")
        done.append(cur.where("n = 1"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("rid", "doc_id", "sha", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, locator_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, identity, rid.

    Texts are equal when identical after lower-casing A-Z only; a null text is
    the empty text, and all empty texts are one group.  The row with the largest
    doc_id of a group is kept; a null doc_id ranks below any number, and if all
    are null ``keep_id`` is null.  Rows that repeat the kept doc_id are copies
    too: exactly one row of a group has ``kept``.  An empty table gives no rows.
    Other columns, whatever their names, are not read.  ``rid`` numbers the input
    rows in scan order.
    """
    who = identities(docs, id_col, text_col, block_bytes, locator_bits)
    groups = who.groupBy("name").agg(F.max(F.struct("doc_id", (-F.col("rid")).alias("back"))).alias("top"), F.count(F.lit(1)).alias("group_size"))
    # a written table, so that the join's sides are plain exchanges and a large group can be split
    out = who.join(save(groups, "groups"), "name")
    return out.select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == -F.col("top.back")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("name").alias("identity"),
        "rid",
    )
