"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The units are characters, each a code point of its own, the order is four.  Every
language has two models, each trained on the trusted texts of one fold (by a
digest of the text, so that copies share a fold); a text of either kind is scored
by the model of the other fold, so that no text is scored by counts of its own.
A document is rejected when its perplexity passes its language's threshold, a
quantile of the trusted documents' perplexities.

Counts of all orders are aggregated over the cluster.  A model set of at most
``MODEL_GRAMS`` n-grams is sent to the tasks, which score while they read.  A
larger one is kept in shards by the characters before the predicted one: a shard
holds all that the smoothing of its n-grams needs.  Documents then send their
n-grams, packed, to salted copies of the shards, whose answers are summed.  Both
ways give the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.llm.shared import bounded, row_key, save, tidied
from loomtide.llm.textnum import chunks, mix

ORDER = 4  # at most 6: two integers of three characters hold an n-gram
QUANTILE = 0.99
MODEL_GRAMS = 2_000_000  # n-grams of all orders, languages and folds that are sent to the tasks; 24 bytes each
SHARD_GRAMS, ASK_BYTES = 500_000, 64 << 20  # of one group in the sharded way
STEPS = 1_000  # thresholds are steps of a thousandth of the log perplexity
BIT, START = 21, (1 << 21) - 1  # characters are code points plus one; 0 stands for none
CHAR = (1 << BIT) - 1
U = np.uint64


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, text) of every character: it and up to ``order`` - 1 before it, of which START is the first."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hi, lo = np.zeros(len(flat), np.int64), flat.copy()
    for k in range(1, order):
        c = np.zeros(len(flat), np.int64)
        c[k:] = flat[: max(len(flat) - k, 0)]
        c = np.where(place >= k, c, np.where(place == k - 1, START, 0))
        if k < 3:
            lo |= c << (BIT * k)
        else:
            hi |= c << (BIT * (k - 3))
    return hi, lo, np.repeat(np.arange(len(texts)), sizes)


def name(hi, lo) -> np.ndarray:
    """A 64-bit name of an n-gram."""
    return mix(np.asarray(hi).astype(U) * U(0x9E3779B97F4A7C15) + mix(np.asarray(lo).astype(U) + U(0x632BE59BD9B4E019)))


def level(hi, lo) -> np.ndarray:
    """Characters of an n-gram, START included."""
    n = np.ones(len(lo), np.int64)
    for k in range(1, 6):
        part = lo >> (BIT * k) & CHAR if k < 3 else hi >> (BIT * (k - 3)) & CHAR
        n[part > 0] = k + 1
    return n


def _last(hi, lo, k: int):
    """The last ``k`` characters."""
    return (hi & ((1 << BIT * max(k - 3, 0)) - 1), lo & ((1 << BIT * min(k, 3)) - 1))


def _before(hi, lo):
    """All characters but the last."""
    return hi >> BIT, (lo >> BIT) | ((hi & CHAR) << (2 * BIT))


class Model:
    """Probabilities from the counts of all orders: raw ones for the highest and for n-grams that begin a text, else of different characters before."""

    def __init__(self, order: np.ndarray, hi: np.ndarray, lo: np.ndarray, c: np.ndarray, discounts: dict[int, list[float]], vocabulary: int):
        self.tables, self.floor = [], 1.0 / (vocabulary + 1)  # one share for a character that was never seen
        for k in sorted(discounts):
            at = np.flatnonzero(order == k)
            key, ctx = name(hi[at], lo[at]), name(*_before(hi[at], lo[at]))
            count = c[at].astype(np.float64)
            off = np.array([0.0, *discounts[k]])[np.minimum(c[at], 3)]
            ctx, inv = np.unique(ctx, return_inverse=True)
            total = np.bincount(inv, weights=count, minlength=len(ctx))
            rest = np.bincount(inv, weights=off, minlength=len(ctx)) / np.maximum(total, 1)
            share = (count - off) / total[inv] if len(at) else count
            by = np.argsort(key)
            self.tables.append((key[by], share[by], ctx, rest))

    def logp(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        p, depth = np.full(len(lo), self.floor), level(hi, lo)
        for k, (key, share, ctx, rest) in enumerate(self.tables, 1):
            part = _last(hi, lo, k)
            c, at = _find(ctx, name(*_before(*part)))
            g, hit = _find(key, name(*part))
            p = np.where(at & (depth >= k), np.where(hit, share[g] if len(share) else 0.0, 0.0) + (rest[c] if len(rest) else 1.0) * p, p)
        return np.log(p)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _texts(batches, column: int, key: int):
    """(key, rows, texts, first row, batch) over chunks of batches, by the value of column ``key``."""
    for b in batches:
        for at, n, data, off in chunks(b.column(column)):
            keys = np.array(b.column(key).slice(at, n).to_pylist(), dtype=object)
            raw = data.tobytes()
            for k in sorted(set(keys)):
                rows = np.flatnonzero(keys == k)
                yield k, rows, [raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i in rows], at, b


def _distinct(hi, lo):
    """An order that puts equal n-grams side by side, and where another one begins in it."""
    by = np.argsort(name(hi, lo))
    new = np.flatnonzero(np.concatenate([[True], (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])])) if len(by) else by
    return by, new


def _counter(order: int):
    def count(batches):
        for model, _, texts, _, _ in _texts(batches, 1, 0):
            hi, lo, _ = ngrams(texts, order)
            by, new = _distinct(hi, lo)
            yield pa.record_batch([pa.array([model] * len(new), pa.string()), pa.array(hi[by][new]), pa.array(lo[by][new]), pa.array(np.diff(np.append(new, len(by))))], ["model", "hi", "lo", "c"])

    return count


def ngram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, order, hi, lo, c) of columns model, text: the counts that the smoothing of each order uses."""
    raw = trusted.select("model", "text").mapInArrow(tidied(_counter(order)), "model string, hi long, lo long, c long")
    raw = raw.groupBy("model", "hi", "lo").agg(F.sum("c").alias("c"))
    slots = [F.shiftrightunsigned("lo", BIT * k).bitwiseAND(CHAR) if k < 3 else F.shiftrightunsigned("hi", BIT * (k - 3)).bitwiseAND(CHAR) for k in range(order)]
    depth = F.lit(1)
    for k in range(1, order):
        depth = F.when(slots[k] > 0, k + 1).otherwise(depth)
    raw = save(raw.withColumn("order", depth), "ngrams")
    cur = raw.where(F.col("order") == order)
    out = cur
    for k in range(order - 1, 0, -1):
        masks = [F.col(n).bitwiseAND((1 << BIT * w) - 1).alias(n) for n, w in (("hi", max(k - 3, 0)), ("lo", min(k, 3)))]
        shorter = cur.groupBy("model", *masks).agg(F.count(F.lit(1)).alias("c")).withColumn("order", F.lit(k))
        cur = save(shorter.unionByName(raw.where(F.col("order") == k)), f"ngrams{k}")  # those that begin a text keep their raw counts
        out = out.unionByName(cur)
    return out.select("model", "order", "hi", "lo", "c")


def discounts(counts: DataFrame) -> dict[str, tuple[dict[int, list[float]], int]]:
    """By model: the three discounts of each order, and the number of characters.  One row a model and order reaches the driver."""
    rows = counts.groupBy("model", "order").agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, tuple[dict[int, list[float]], int]] = {}
    for r in rows:
        n = [r.n1, r.n2, r.n3, r.n4]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.25 + 0.25 * i for i in (1, 2, 3)]
        by_order, size = out.get(r.model, ({}, 0))
        by_order[r.order] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        out[r.model] = (by_order, r.n if r.order == 1 else size)
    return out


def _told(counts: DataFrame, known: dict) -> dict[str, Model]:
    """All models, on the driver.  ``counts`` has at most MODEL_GRAMS rows."""
    t = counts.toArrow()
    model = t.column("model").combine_chunks().dictionary_encode()
    code, cols = model.indices.to_numpy(), [t.column(c).to_numpy() for c in ("order", "hi", "lo", "c")]
    return {m: Model(*(c[code == i] for c in cols), *known[m]) for i, m in enumerate(model.dictionary.to_pylist())}


def _scorer(order: int, models):
    """Over batches of (model, text, doc_id, lang, k, digest): the rows with the sum of log probabilities and the length."""

    def score(batches):
        for model, rows, texts, at, b in _texts(batches, 1, 0):
            m = models.value.get(model)
            hi, lo, doc = ngrams(texts, order)
            by, new = _distinct(hi, lo)
            total = np.zeros(len(rows))
            if m is not None and len(by):
                each = np.repeat(m.logp(hi[by][new], lo[by][new]), np.diff(np.append(new, len(by))))
                total = np.bincount(doc[by], weights=each, minlength=len(rows))
            n = np.bincount(doc, minlength=len(rows)) if m is not None else np.zeros(len(rows), np.int64)
            part = b.slice(at, int(rows[-1]) + 1).take(pa.array(rows))
            yield pa.record_batch([*(part.column(i) for i in range(2, 6)), pa.array([len(t) > 0 for t in texts]), pa.array(total), pa.array(n.astype(np.int64))], ["doc_id", "lang", "k", "digest", "full", "logp", "n"])

    return score


_SCORED = "doc_id long, lang string, k long, digest long, full boolean, logp double, n long"


def _shard_of(one, two, a: int, b: int) -> np.ndarray:
    """The shard of n-grams by the character before the predicted one (``a`` classes) and the one before that (``b`` classes)."""
    return ((mix(one.astype(U)) >> U(33)) % U(a) * U(b) + (mix(two.astype(U) + U(77)) >> U(33)) % U(b)).astype(np.int32)


def _dealer(a: int, b: int):
    """Rows of counts, each with the shards that need it: one from order 3 on, the ``b`` of its first class for pairs, all for characters."""

    def deal(batches):
        for t in batches:
            order, lo = t.column("order").to_numpy(), t.column("lo").to_numpy()
            shard = _shard_of(lo >> BIT & CHAR, lo >> (2 * BIT) & CHAR, a, b)
            copies = np.where(order >= 3, 1, np.where(order == 2, b, a * b))
            rows = np.repeat(np.arange(len(lo)), copies)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
            base = np.where(order >= 3, shard, np.where(order == 2, shard // b * b, 0))
            part = t.take(pa.array(rows))
            yield pa.record_batch([*part.columns, pa.array((base[rows] + nth).astype(np.int32))], [*t.schema.names, "shard"])

    return deal


def _packed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), "zstd", asbytes=True), kind)


def _asker(order: int, a: int, b: int, salts: int):
    """Packed n-grams of the documents of a chunk, for each shard."""

    def ask(batches):
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        for model, rows, texts, at, batch in _texts(batches, 1, 0):
            hi, lo, doc = ngrams(texts, order)
            if not len(lo):
                continue
            k, digest = (batch.column(c).slice(at, int(rows[-1]) + 1).to_numpy(zero_copy_only=False)[rows] for c in (4, 5))
            shard = _shard_of(lo >> BIT & CHAR, lo >> (2 * BIT) & CHAR, a, b)
            by = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1], [True]]))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = by[i:j]
                inner, new = _distinct(hi[part], lo[part])
                part = part[inner]
                packed = (k, digest, hi[part][new], lo[part][new], np.diff(np.append(new, len(part))).astype(np.uint32), doc[part].astype(np.uint16))
                row = [model, int(shard[part[0]]), int(np.uint64(digest[0] & 0x7FFFFFFFFFFFFFFF) % np.uint64(salts)), *(_packed(x) for x in packed)]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["model", "shard", "salt", "k", "digest", "hi", "lo", "runs", "docs"])

    return ask


def _answerer(known: dict):
    def answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
        kinds = {"k": pa.int64(), "digest": pa.int64(), "logp": pa.float64(), "n": pa.int64()}
        if not counts.num_rows or not asked.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        model = Model(*(counts.column(c).to_numpy() for c in ("order", "hi", "lo", "c")), *known[counts.column("model")[0].as_py()])
        out = {k: [] for k in kinds}
        for i in range(asked.num_rows):
            k, digest, hi, lo = (_unpacked(asked.column(c)[i].as_py(), np.int64) for c in ("k", "digest", "hi", "lo"))
            runs, docs = (_unpacked(asked.column(c)[i].as_py(), t) for c, t in (("runs", np.uint32), ("docs", np.uint16)))
            each = np.repeat(model.logp(hi, lo), runs)
            n = np.bincount(docs, minlength=len(k))
            seen = n > 0
            for c, v in (("k", k), ("digest", digest), ("logp", np.bincount(docs, weights=each, minlength=len(k))), ("n", n)):
                out[c].append(v[seen])
        return pa.table({k: pa.array(np.concatenate(v), kinds[k]) for k, v in out.items()})

    return answer


def _by_shards(base: DataFrame, counts: DataFrame, known: dict, order: int, grams: int) -> DataFrame:
    """The scores, by joins of documents' n-grams with salted shards of the counts."""
    a = min(-(-grams // SHARD_GRAMS), 4096)
    by = (F.col("order") >= 3) & (F.col("order") <= order)
    hot = counts.where(by).groupBy(F.shiftrightunsigned("lo", BIT).bitwiseAND(CHAR).alias("one")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    b = -(-hot // SHARD_GRAMS)
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    salts = max(1, -(-int(2.5 * chars) // (a * b * ASK_BYTES)))
    dealt = counts.mapInArrow(tidied(_dealer(a, b)), "model string, order int, hi long, lo long, c long, shard int")
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = base.mapInArrow(tidied(_asker(order, a, b, salts)), "model string, shard int, salt int, k binary, digest binary, hi binary, lo binary, runs binary, docs binary")
    key = ["model", "shard", "salt"]
    parts = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_answerer(known), "k long, digest long, logp double, n long")
    sums = save(parts.groupBy("k", "digest", F.lit(1).alias("one")).agg(F.sum("logp").alias("logp"), F.sum("n").alias("n")).drop("one"), "sums")
    # rows that repeat doc_id and text have asked once each: the mean over all their characters is the same
    rows = base.select("doc_id", "lang", "k", "digest", (F.length("text") > 0).alias("full"))
    return rows.join(sums, ["k", "digest"], "left").na.fill({"logp": 0.0, "n": 0}).select(*(c.split()[0] for c in _SCORED.split(", ")))


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, model_grams: int = MODEL_GRAMS) -> DataFrame:
    """One row per input row: doc_id, lang, k, digest, perplexity, threshold, kept.

    ``labels`` (doc_id, quality) marks trusted rows with quality 1.  A null lang
    is the language "und".  A null or empty text has no perplexity and is not
    kept.  A language without trusted text in either fold has no threshold, and
    a row without a model for it has no perplexity; both keep their rows.
    ``threshold`` is the least step of a thousandth of the log perplexity that
    the share ``quantile`` of a language's trusted rows doesn't pass; it depends
    on the rows alone, not on their order or split.  A row on the threshold is
    kept.  Repeated rows get the same values; a null doc_id is never trusted;
    empty tables give no rows, and with empty labels all rows with text are kept.
    ``k`` and ``digest`` name a row by doc_id and text.  Other columns are not read.
    """
    spark = docs.sparkSession
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(2))
    base = docs.select(doc.alias("doc_id"), lang.alias("lang"), *row_key(doc, text), text.alias("text"), F.concat(fold.cast("string"), lang).alias("own"), F.concat((1 - fold).cast("string"), lang).alias("model"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = base.join(bounded(good), "doc_id", "left_semi").select(F.col("own").alias("model"), "text")
    counts = ngram_counts(trusted, order)
    known = discounts(counts)
    grams = counts.count()
    base = base.select("model", "text", "doc_id", "lang", "k", "digest")
    if grams <= model_grams:
        models = spark.sparkContext.broadcast(_told(counts, known))
        scored = base.mapInArrow(tidied(_scorer(order, models)), _SCORED)
    else:
        scored = _by_shards(base, counts, known, order, grams)
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.round(F.exp(-F.col("logp") / F.col("n")), 6)))
    scored = save(scored.select("doc_id", "lang", "k", "digest", "full", "perplexity", F.ceil(F.log("perplexity") * STEPS).alias("step")), "perplexity")

    # at most some 14,000 steps a language
    steps = scored.where("step is not null").join(bounded(good), "doc_id", "left_semi").groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    steps = steps.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    limits = steps.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg(F.min("step").alias("limit"))
    out = scored.join(bounded(limits), "lang", "left")
    kept = F.col("full") & F.coalesce(F.col("step") <= F.col("limit"), F.lit(True))
    return out.select("doc_id", "lang", "k", "digest", "perplexity", F.round(F.exp(F.col("limit") / STEPS), 6).alias("threshold"), kept.alias("kept"))
