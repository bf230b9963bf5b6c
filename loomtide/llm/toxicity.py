"""Toxicity by weak supervision.

Terms (word beginnings) that are typical of toxic training rows become lexicon
voters; densities, counts and neighbourhoods of terms become pattern voters.  A
generative label model estimates each voter's accuracy by expectation
maximisation, finds correlated voters and shares their weight, and gives every
training row a posterior.  A linear classifier is trained on the posteriors and
scores all documents.  Only the text enters a score.

Labels are used twice: to find the terms, and for the share of toxic rows, the
label model's prior.  Label model and classifier see votes and texts only; a
score is the classifier's probability as it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.shared import slices, tidied

#: Bound of the labelled sample that the driver reads: rows of each class, and the characters read in all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2_500, 5_000, 60_000_000
MAX_TERMS, SHORTEST, LONGEST, LEAST_Z = 64, 4, 9, 8.0
NEAR = 60  # characters between two terms that count as one outburst
_WORD = re.compile(r"[^\W\d_]+")


def distinct_rows(texts: list[str], alike: float = 0.8) -> list[int]:
    """Rows that are no near copies of a row before them: copies say nothing new about a term.

    A near copy shares ``alike`` of all different words with an earlier row that
    stays; one of the 16 smallest word hashes in common makes a row a candidate.
    """
    holders: dict[int, list[int]] = {}
    kept: dict[int, set[str]] = {}
    for i, text in enumerate(texts):
        words = set(_WORD.findall(text.lower()))
        sketch = sorted(zlib.crc32(w.encode()) for w in words)[:16]
        near = {k for h in sketch for k in holders.get(h, ()) if alike * len(words) <= len(kept[k]) <= len(words) / alike}
        if any(len(words & kept[k]) >= alike * len(words | kept[k]) for k in near) or (not words and any(not w for w in kept.values())):
            continue
        kept[i] = words
        for h in sketch:
            holders.setdefault(h, []).append(i)
    return list(kept)


def mine_terms(texts: list[str], toxic: np.ndarray, limit: int = MAX_TERMS) -> list[str]:
    """Word beginnings whose share of toxic rows stands out most; none is the beginning of another.

    A share is that of the rows that have the term, or of those that have it more than once.
    """
    seen = {(y, least): Counter() for y in (0, 1) for least in (1, 2)}
    rows = [0, 0]
    for text, y in zip(texts, toxic.astype(int).tolist(), strict=True):
        words = Counter(_WORD.findall(text.lower()))
        rows[y] += 1
        found: Counter = Counter()
        for w, c in words.items():
            for n in range(SHORTEST, min(len(w), LONGEST) + 1):
                found[w[:n]] += c
        seen[y, 1].update(found.keys())
        seen[y, 2].update(t for t, c in found.items() if c > 1)
    n0, n1 = (max(1, n) for n in rows)
    ranked: dict[str, float] = {}
    for least in (1, 2):
        for term, a in seen[1, least].items():
            p, q = a / n1, (seen[0, least][term] + 0.5) / n0
            if a >= 3 and p > 3 * q and (z := _z(p, q, n1, n0)) >= LEAST_Z:
                ranked[term] = max(z, ranked.get(term, 0.0))
    out: list[str] = []
    for term in sorted(ranked, key=lambda t: (-ranked[t], -len(t), t)):
        if not any(term.startswith(t) or t.startswith(term) for t in out):
            out.append(term)
            if len(out) == limit:
                break
    return sorted(out)


def _z(p: float, q: float, n1: int, n0: int) -> float:
    pool = (p * n1 + q * n0) / (n1 + n0)
    return (p - q) / np.sqrt(pool * (1 - min(pool, 0.999)) * (1 / n1 + 1 / n0))


class Finder:
    """Counts of terms at word beginnings, and the shape of their places."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.auto = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            self.auto.add_word(t, (k, len(t)))
        if terms:
            self.auto.make_automaton()

    def features(self, text: str) -> list[float]:
        """Counts of each term, then words, hits, different terms, pairs of near hits."""
        low = text.lower()
        counts = [0.0] * len(self.terms)
        last, near = -NEAR * 2, 0
        if self.terms:
            for end, (k, n) in self.auto.iter(low):
                at = end - n + 1
                if at == 0 or not low[at - 1].isalpha():
                    counts[k] += 1
                    near += at - last <= NEAR
                    last = at
        return [*counts, float(low.count(" ") + low.count("\n") + 1), sum(counts), float(sum(c > 0 for c in counts)), float(near)]


def votes(x: np.ndarray, n_terms: int) -> np.ndarray:
    """Votes of all voters on each row: 1 toxic, -1 clean, 0 abstains."""
    words, hits, kinds, near = (x[:, n_terms + i] for i in range(4))
    rate = hits / words
    cols = [(x[:, k] >= 1).astype(int) for k in range(n_terms)]
    cols += [(hits >= c).astype(int) for c in (2, 4, 8)]
    cols += [(rate >= r).astype(int) for r in (0.005, 0.01, 0.02, 0.04)]
    cols += [(kinds >= c).astype(int) for c in (2, 4)]
    cols += [((near >= 1) & (hits >= 2)).astype(int), (near >= 3).astype(int)]
    cols += [-(hits == 0).astype(int), -(rate < 0.002).astype(int), -((hits <= 1) & (words > 60)).astype(int)]
    return np.stack(cols, axis=1) if len(x) else np.zeros((0, len(cols)), int)


class LabelModel:
    """Accuracies of voters given the hidden label, with weight shared among correlated voters."""

    def fit(self, v: np.ndarray, prior: float, rounds: int = 25, clash: float = 0.5) -> LabelModel:
        """From votes alone; ``prior`` is the share of toxic rows.  It starts from the rows with the most votes for toxic."""
        balance = v.sum(1)
        post = np.where(balance > np.quantile(balance, 1 - prior), 0.9, 0.1)
        self.weight = np.ones(v.shape[1])
        self.prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        for r in range(rounds):
            self.table = np.stack([[((v == k) * p[:, None]).sum(0) + 0.5 for k in (-1, 0, 1)] for p in (1 - post, post)])
            self.table /= self.table.sum(axis=1, keepdims=True)
            if r in (3, 10):
                self.weight = self._shares(v, post, clash)
            post = 1 / (1 + np.exp(-np.clip(self.evidence(v), -30, 30)))
        self.posterior = post
        return self

    def _shares(self, v: np.ndarray, post: np.ndarray, clash: float) -> np.ndarray:
        """One over the voters that say the same beyond what the label explains."""
        means = [(v * p[:, None]).sum(0) / max(p.sum(), 1e-9) for p in (1 - post, post)]
        rest = v - np.outer(1 - post, means[0]) - np.outer(post, means[1])
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        self.correlation = np.abs(rest.T @ rest / max(len(v), 1) / np.outer(scale, scale))
        return 1 / np.maximum((self.correlation * (self.correlation > clash)).sum(1), 1)

    def evidence(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.table[1]) - np.log(self.table[0])
        each = np.where(v == 1, log[2], np.where(v == 0, log[1], log[0]))
        return np.log(self.prior / (1 - self.prior)) + (each * self.weight).sum(1)


def design(x: np.ndarray, n_terms: int) -> np.ndarray:
    """Inputs of the linear classifier."""
    words, hits, kinds, near = (x[:, n_terms + i] for i in range(4))
    rate = hits / words
    shape = [np.log1p(hits), np.log(rate + 1e-3), np.sqrt(rate), np.log1p(kinds), np.log1p(near), (hits == 0) * 1.0, np.log(words), hits / np.sqrt(words)]
    return np.concatenate([np.log1p(x[:, :n_terms]), np.stack(shape, 1)], 1)


class Scorer:
    """The linear classifier; ``weights`` holds the bias last."""

    def __init__(self, terms, centre, scale, weights):
        self.terms, self.centre, self.scale, self.weights = terms, centre, scale, weights
        self._counter = None

    def __getstate__(self):
        return {**self.__dict__, "_counter": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self._counter is None:
            self._counter = Finder(self.terms)
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([self._counter.features(t) for t in texts], float).reshape(len(texts), -1)
        return self.on(x)

    def on(self, x: np.ndarray) -> np.ndarray:
        z = (design(x, len(self.terms)) - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def train(texts: list[str], toxic: list[int]) -> Scorer:
    """Fit voters, label model and classifier.  Without rows of both classes every score is 0."""
    use = distinct_rows(texts)
    texts, y = [texts[i] for i in use], np.array(toxic, dtype=bool)[use]
    if not y.any() or y.all():
        return Scorer([], None, None, None)
    terms = mine_terms(texts, y)
    counter = Finder(terms)
    x = np.array([counter.features(t) for t in texts], float)
    target = LabelModel().fit(votes(x, len(terms)), y.mean()).posterior
    d = design(x, len(terms))
    centre, scale = d.mean(0), d.std(0) + 1e-6
    d = np.concatenate([(d - centre) / scale, np.ones((len(d), 1))], 1)
    w = np.zeros(d.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-6
    for _ in range(30):  # Newton steps of the regularised logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(ridge), d.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(terms, centre, scale, w)


def in_test_fold(doc_id):
    """The fold whose labels are never read."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list:
    """Bounded training rows (doc_id, text, toxic), taken in the order of a digest of doc_id.

    Texts are whole; one that would pass SAMPLE_CHARS is left out of the sample.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_test_fold(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary"))
    parts = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    picked = parts[0].unionByName(parts[1]).withColumn("turn", order)  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    sizes = rows.select("doc_id", F.struct(F.length("text").alias("chars"), "digest").alias("least")).join(F.broadcast(picked), "doc_id")
    sizes = sizes.groupBy("turn", "doc_id", "toxic").agg(F.min("least").alias("least"))  # rows that repeat a doc_id give one
    use, chars = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r.turn, r.doc_id, r.toxic)):
        if chars + r.least.chars <= SAMPLE_CHARS:
            chars += r.least.chars
            use.append((r.doc_id, r.least.digest, r.toxic))
    if not use:
        return []
    chosen = F.broadcast(docs.sparkSession.createDataFrame(use, "doc_id long, digest long, toxic int"))  # as many at most
    got = rows.join(chosen, ["doc_id", "digest"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text, r.toxic) for r in got.toLocalIterator())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) is read for training only, and only outside the
    fold of ``held_out`` rows.  Null and empty texts are scored as a text without
    terms.  A null doc_id is not held out and has no label.  Repeated rows get
    equal scores.  Without labelled rows of both classes all scores are 0.  An
    empty table gives no rows.  Other columns are not read.
    """
    sample = labelled_sample(docs, labels)
    scorer = train([t for _, t, _ in sample], [y for _, _, y in sample])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # MAX_TERMS terms and weights

    def run(batches):
        for part in slices(batches, 2, 256):
            score = shared.value.score(part.column(2).to_pylist())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_test_fold(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return base.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")
