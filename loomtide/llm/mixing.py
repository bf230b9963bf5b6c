"""Mixing sources to target weights over a domain - language - source tree.

The budget of tokens is handed down the tree by weight.  What a child cannot
supply goes to its siblings; only what all of them cannot supply goes further
up.  A leaf then takes whole epochs of its documents and the prefix of one more
epoch, in an order seeded by epoch.  The prefix is found from a histogram of the
order's leading bits, so that no task sees a whole leaf.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.llm.shared import row_key, save

LEVELS = ("domain", "lang", "source")
MAX_LEAVES = 200_000  # sums of leaves that the driver reads; more is an error
BITS = 16
DOMAIN_WEIGHTS = {"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1}
LANG_WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1, "*": 0.02}
OTHER = "*"  # the weight of each name that has none of its own
SHARE = 0.8  # of all tokens that the mixture holds


def share_out(budget: int, children: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Split ``budget`` by weight; a child's shortage goes to the siblings that have tokens left.  Children: (weight, capacity)."""
    got = dict.fromkeys(children, 0)
    left = min(budget, sum(cap for _, cap in children.values()))
    while left > 0:
        live = {k: w for k, (w, cap) in sorted(children.items()) if got[k] < cap and w > 0}
        if not live:  # only children of weight 0 have tokens left
            break
        total = sum(live.values())
        given = {k: min(children[k][1] - got[k], math.floor(left * w / total)) for k, w in live.items()}
        if not any(given.values()):
            k = max(live, key=lambda k: (live[k], k))
            given = {k: 1}
        for k, n in given.items():
            got[k] += n
        left -= sum(given.values())
    return got


def budgets(leaves: dict[tuple[str, str, str], int], budget: int, weights: tuple[dict, dict, dict], max_epochs: int) -> dict[tuple[str, str, str], int]:
    """Tokens for each leaf.  ``weights`` by level; a name without one has that of OTHER, or 1 on levels whose weights are empty, else 0."""

    def down(prefix: tuple, amount: int, out: dict) -> None:
        level = len(prefix)
        if level == 3:
            out[prefix] = amount
            return
        inner: dict[str, int] = {}
        for leaf, tokens in leaves.items():
            if leaf[:level] == prefix:
                inner[leaf[level]] = inner.get(leaf[level], 0) + _usable(leaf, level + 1, weights) * tokens * max_epochs
        children = {k: (_weight(weights[level], k), cap) for k, cap in inner.items()}
        children = {k: (w, cap if w > 0 else 0) for k, (w, cap) in children.items()}
        for k, n in share_out(amount, children).items():
            down((*prefix, k), n, out)

    out: dict[tuple[str, str, str], int] = {}
    down((), budget, out)
    return out


def _weight(weights: dict, name: str) -> float:
    return weights.get(name, weights.get(OTHER, 0.0)) if weights else 1.0


def _usable(leaf: tuple, level: int, weights: tuple) -> int:
    """0 if a weight of 0 below ``level`` shuts the leaf."""
    return int(all(_weight(w, name) > 0 for name, w in zip(leaf[level:], weights[level:], strict=True)))


def word_count(text):
    return F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+"))


def by_source_number():
    """Domains of the example corpus: the source's number modulo 4."""
    n = F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("long") % 4, F.lit(0))
    return F.concat(F.lit("domain"), n.cast("string"))


def _edge(rows: DataFrame, parts: int) -> DataFrame:
    """(domain, lang, source, edge, before): the part in which the tokens of a leaf pass its rest, and the tokens before it.

    ``parts`` bounds the sums of a leaf that one task sees.
    """
    hist = rows.groupBy(*LEVELS, "rest", "before", "part").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(-parts, 0)
    hist = hist.withColumn("through", F.col("before") + F.sum("t").over(run))
    passed = hist.where("through > rest").groupBy(*LEVELS).agg(F.min("part").alias("edge"), F.min(F.col("through") - F.col("t")).alias("before"))
    return passed


def mixture(docs: DataFrame, domain=None, share: float = SHARE, domain_weights=None, lang_weights=None, source_weights=None, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, k, digest, domain, lang, source, tokens, copies): the selected rows and how often each occurs in the mixture.

    ``share`` of the corpus's tokens (words) is the budget.  Null domains,
    languages and sources are named "none".  A null text has no tokens; rows
    without tokens are never selected.  Languages other than those of
    ``LANG_WEIGHTS``, null ones too, each have the weight of ``OTHER``.  Rows that repeat doc_id and text are
    rows of their own, ordered alike.  The prefix ends before the first document
    that would pass the leaf's budget.  An empty table gives no rows.  Columns
    other than doc_id, text, lang, source and those of ``domain`` are not read.
    """
    domain = by_source_number() if domain is None else domain
    weights = (DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANG_WEIGHTS if lang_weights is None else lang_weights, source_weights or {})
    doc = F.col("doc_id").cast("long")
    name = lambda c: F.coalesce(c, F.lit("none"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(doc.alias("doc_id"), *row_key(doc, text), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), word_count(text).cast("long").alias("tokens"))
    rows = save(rows.where("tokens > 0"), "sizes")
    sums = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("total")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: group sources first")
    leaves = {tuple(r[k] for k in LEVELS): r.total for r in sums}
    goal = budgets(leaves, math.floor(share * sum(leaves.values())), weights, max_epochs)
    plan = [{**dict(zip(LEVELS, leaf, strict=True)), "whole": n // leaves[leaf], "rest": n % leaves[leaf]} for leaf, n in goal.items()]
    # as an Arrow table: tuples would go through Python workers of their own, which executors keep beside the others
    table = pa.Table.from_pylist(plan, pa.schema([*((c, pa.string()) for c in LEVELS), ("whole", pa.int64()), ("rest", pa.int64())]))
    targets = F.broadcast(docs.sparkSession.createDataFrame(table))  # MAX_LEAVES rows at most
    keyed = rows.join(targets, list(LEVELS)).withColumn("order", F.xxhash64(F.lit(seed), F.col("whole"), F.col("digest")))
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("order", 64 - BITS))
    # the bucket in which a leaf's rest ends: first by the leading half of the bits, then within that half
    half = 1 << BITS // 2
    coarse = _edge(keyed.withColumn("part", F.shiftright("bucket", BITS // 2)).withColumn("before", F.lit(0).cast("long")), half)
    fine = keyed.withColumn("part", F.shiftright("bucket", BITS // 2)).join(F.broadcast(coarse), list(LEVELS)).where("part = edge")
    fine = _edge(fine.withColumn("part", F.col("bucket")).drop("edge"), half).withColumnRenamed("edge", "last")
    found = keyed.join(F.broadcast(coarse.select(*LEVELS, "edge")), list(LEVELS), "left").join(F.broadcast(fine.select(*LEVELS, "last", "before")), list(LEVELS), "left")
    inside = found.where("bucket = last")
    nth = Window.partitionBy(*LEVELS).orderBy("order", "digest", "k").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.sum("tokens").over(nth)).withColumn("extra", (F.col("before") + F.col("run") <= F.col("rest")).cast("long"))
    clear = found.where("last is null or bucket != last").withColumn("extra", F.coalesce((F.col("bucket") < F.col("last")).cast("long"), F.lit(1)))
    cols = ["doc_id", "k", "digest", *LEVELS, "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return clear.select(*cols).unionByName(inside.select(*cols)).where("copies > 0")
