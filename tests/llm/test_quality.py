"""The Kneser-Ney model against its definition, and both ways of scoring."""

import collections
import math

import numpy as np
import pytest

from loomtide.llm import quality as Q

TRUSTED = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "abc", "日本語のテキスト", "the cat sat on the mat", "", "x", "αβγ αβγ the"]


def brute_counts(texts, order):
    """Counts of all orders by definition: raw for the highest order and for n-grams that begin a text, else different characters before."""
    raw = collections.Counter()
    for t in texts:
        s = ("<", *t)
        for k in range(1, order + 1):
            for i in range(len(s) - k + 1):
                if not (k == 1 and i == 0):
                    raw[s[i : i + k]] += 1
    out = {}
    for k in range(1, order + 1):
        grams = [g for g in raw if len(g) == k]
        if k == order:
            out[k] = {g: raw[g] for g in grams}
        else:
            out[k] = {g: raw[g] if g[0] == "<" else len({h[0] for h in raw if len(h) == k + 1 and h[1:] == g}) for g in grams}
    return out


def brute_p(counts, order):
    cut, size = {}, len(counts[1])
    for k, table in counts.items():
        n = [sum(c == i for c in table.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        cut[k] = [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.25 + 0.25 * i, 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(context, c):
        context = context[-(order - 1) :]
        k = len(context) + 1
        lower = 1 / (size + 1) if k == 1 else p(context[1:], c)
        follow = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not follow:
            return lower
        total = sum(follow.values())
        rest = sum(cut[k][min(n, 3)] for n in follow.values()) / total
        own = follow.get((*context, c), 0)
        return max(own - cut[k][min(own, 3)], 0) / total + rest * lower

    return p


def scored(spark, docs, labels, **more):
    return {r.doc_id: r for r in Q.quality_scores(docs, labels, **more).collect()}


def corpus(spark):
    rng = np.random.default_rng(2)
    words = ["sun", "moon", "river", "stone", "über", "日本", "a", "of"]
    rows = [(k, " ".join(words[i] for i in rng.integers(0, 8, rng.integers(1, 12))), "en" if k % 2 else "fr") for k in range(120)]
    rows += [(200, "qzx jjj kkk #@! zzzz", "en"), (201, None, "en"), (202, "", None), (203, "und text", None), (204, "other", "xx")]
    labels = [(k, 1, 0) for k in range(0, 100)] + [(200, 0, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize("order", [2, 3, 5, 6])
def test_counts_and_probabilities(spark, order):
    counts = Q.ngram_counts(spark.createDataFrame([("m", t) for t in TRUSTED], "model string, text string"), order)
    want = brute_counts(TRUSTED, order)

    def text(r):
        chars = [r.lo & Q.CHAR, r.lo >> 21 & Q.CHAR, r.lo >> 42, r.hi & Q.CHAR, r.hi >> 21 & Q.CHAR, r.hi >> 42]
        return tuple("<" if c == Q.START else chr(c - 1) for c in reversed(chars) if c)

    rows = counts.collect()
    assert {(r.order, text(r)): r.c for r in rows} == {(k, g): n for k, table in want.items() for g, n in table.items()}
    known = Q.discounts(counts)
    cols = [np.array([r[c] for r in rows]) for c in ("order", "hi", "lo", "c")]
    model, p = Q.Model(*cols, *known["m"]), brute_p(want, order)
    for t in [*TRUSTED, "unseen 字 text", "the cow", "zzz"]:
        if t:
            got = model.logp(*Q.ngrams([t], order)[:2])
            s = ("<", *t)
            assert np.allclose(got, [math.log(p(s[:i], s[i])) for i in range(1, len(s))])
    letters = [*{c for t in TRUSTED for c in t}, "\U0001f692"]  # the last stands for all that was never seen
    for context in ("the", "", "q", "日本", "a ", "on t"):
        total = sum(math.exp(model.logp(*(x[-1:] for x in Q.ngrams([context + c], order)[:2]))[0]) for c in letters)
        assert abs(total - 1) < 1e-9


def test_shards_score_like_one_model(spark, monkeypatch):
    docs, labels, rows = corpus(spark)
    whole = scored(spark, docs, labels)
    for size in (10, 60, 10_000):
        monkeypatch.setattr(Q, "SHARD_GRAMS", size)
        monkeypatch.setattr(Q, "ASK_BYTES", 300)
        got = scored(spark, docs, labels, model_grams=0)
        assert got.keys() == whole.keys() == {r[0] for r in rows}
        for k, r in whole.items():
            assert (r.perplexity is None) == (got[k].perplexity is None) and (r.perplexity is None or abs(r.perplexity - got[k].perplexity) < 1e-5)
            assert r.kept == got[k].kept or abs(r.perplexity - r.threshold) < 1e-3
    assert not whole[200].kept and whole[203].kept and whole[204].kept and not whole[201].kept and not whole[202].kept
    assert whole[203].perplexity is None and whole[200].perplexity > whole[200].threshold


def test_threshold_and_folds(spark):
    """A text is scored by the other fold only; the threshold keeps its share of trusted rows, whatever the split."""
    docs, labels, rows = corpus(spark)
    a, b = scored(spark, docs, labels, quantile=0.9), scored(spark, docs.repartition(7).sortWithinPartitions("text"), labels, quantile=0.9)
    assert {k: (r.perplexity, r.threshold, r.kept) for k, r in a.items()} == {k: (r.perplexity, r.threshold, r.kept) for k, r in b.items()}
    for lang in ("en", "fr"):
        good = [a[k] for k, _, at in rows if at == lang and k < 100]
        assert sum(r.perplexity <= r.threshold for r in good) >= 0.9 * len(good)
        least = math.log(good[0].threshold) - 1.01 / Q.STEPS
        assert sum(math.log(r.perplexity) <= least for r in good) < 0.9 * len(good)
    copies = docs.where("doc_id = 3").union(docs.where("doc_id = 3"))
    twice = Q.quality_scores(docs.union(copies), labels).where("doc_id = 3").select("perplexity").distinct().count()
    assert twice == 1
