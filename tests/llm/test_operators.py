"""The ten operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from loomtide.llm import audio, bpe, mixing, shared
from loomtide.llm import jaccard_join as J
from loomtide.llm.bpe import bpe_codes, bpe_roundtrip, byte_chars
from loomtide.llm.components import components
from loomtide.llm.exact_dedup import exact_dedup
from loomtide.llm.line_dedup import line_dedup
from loomtide.llm.quality import quality_scores
from loomtide.llm.substring_dedup import substring_dedup
from loomtide.llm.token_counts import END, Matcher, read_vocabulary, token_counts
from loomtide.llm.toxicity import LabelModel, distinct_rows, toxicity, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, name string, h long, u string, node string, label string, size string"
LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = [
    (1, "Some Words of a text that is here"), (2, "some words of a TEXT that is here"), (3, None), (4, ""), (5, "Été some"), (6, "ÉTÉ some"), (7, "x " * 9000), (8, "X " * 9000),
    (9, "one"), (10, "one two"), (11, "one two"), (12, " \t\n"), (13, "日本語 🚒 テスト"), (None, "no id"), (None, None), (14, "x " * 8999 + "y"), (15, "a b c d e f g h i j k l"), (16, "a b c d e f g h i j k l m"),
]


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, f"src{i}" if i else None, 0, "rid", "name", 1, "u", "n", "l", "s") for i, t in rows], SCHEMA)


OPERATORS = {
    "counts": lambda d, lab: token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "exact": lambda d, lab: exact_dedup(d),
    "quality": quality_scores,
    "substring": lambda d, lab: substring_dedup(d),
    "lines": lambda d, lab: line_dedup(d),
    "audio": lambda d, lab: audio.audio_features(d, with_media=True),
    "toxicity": toxicity,
    "jaccard": lambda d, lab: J.jaccard_components(d, 3, 90, 100),
    "bpe": lambda d, lab: bpe_roundtrip(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
}


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    rows = OPERATORS[name](table(spark), labels(spark, [(1, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None)])).collect()
    assert len(rows) == len(TEXTS)
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in TEXTS)
    assert OPERATORS[name](table(spark, []), labels(spark)).count() == 0


def test_mixing_odd_rows(spark):
    got = mixing.mixture(table(spark), max_epochs=3).collect()
    assert all(r.copies > 0 and r.tokens > 0 for r in got)
    assert mixing.mixture(table(spark, [])).count() == 0


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (7, 64), (16, 3)])
def test_exact_dedup(spark, block, bits):
    rows = [(i, t) for i, t in TEXTS if i] + [(2, "some words of a TEXT that is here"), (20, "q" * 64), (21, "q" * 65), (22, "Q" * 64)]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = exact_dedup(table(spark, rows), block_bytes=block, locator_bits=bits).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        norm = next(k for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert (r.keep_id, r.group_size) == (max(groups[norm]), len(groups[norm]))
        assert not r.kept or r.doc_id == r.keep_id


def brute(rows, width, num):
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    sets = []
    for _, t in rows:
        w = find((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    link = [[bool(a) and bool(b) and 100 * len(a & b) >= num * len(a | b) for b in sets] for a in sets]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(len(rows)) if link[k][j] and j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if sets[i] and ids else rows[i][0], sum(link[i]) - link[i][i]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(spark, width, num):
    rng = np.random.default_rng(width)
    rows = list(TEXTS)
    passage = [f"p{k}" for k in range(60)]
    for n in (4, 9, 12, 20, 21, 22, 25, 40, 150, 400):
        base = [f"w{v}" for v in rng.integers(0, 500, n)] + (passage if n > 100 else [])
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.integers(len(w))] = f"e{rng.integers(1 << 30)}"
            rows.append((1000 + len(rows), " ".join(w[: len(w) - int(rng.integers(2))])))
    rows += [(3000 + k, " ".join([*passage, *(f"z{k}-{j}" for j in range(30))])) for k in range(90)]
    got = J.jaccard_components(table(spark, rows), width, num, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, width, num)


@pytest.mark.parametrize("partitions", [3, 6, 200])
def test_jaccard_join_for_any_number_of_partitions(spark, partitions):
    """Pairs that share a single key are found however many buckets the keys fall into; none is a power of two here."""
    rng = np.random.default_rng(partitions)
    rows = []
    for k in range(60):
        w = [f"w{v}" for v in rng.integers(0, 1 << 30, 12 + k % 6)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-1]))]
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, partitions)
    try:
        got = J.jaccard_components(table(spark, rows), 3, 90, 100).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, 3, 90)


def test_lists_hold_every_key(monkeypatch):
    """Runs of any length hand on the same keys and tie the same sets."""
    plan, text = J.Plan(90, 100), pa.array([" ".join(f"w{i % 150}-{k}" for k in range(12)) for i in range(200)])

    class Told:
        value = np.zeros(0, np.uint64)

    def listed(keys):
        monkeypatch.setattr(J, "KEYS", keys)
        out = pa.Table.from_batches(J._lists(plan, 3, Told)(pa.record_batch([text.slice(at, 20)], ["text"]) for at in range(0, 200, 20)))
        return {k for k in out.column("key").to_pylist() if k is not None}

    assert listed(1) == listed(1000) == listed(10**6) and len(listed(1)) > 150


def test_one_family_of_many_blocks(spark):
    """A family of unlike near copies is verified in many small groups, whatever the number of shuffle partitions."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: k % 60], f"e{k}", *base[k % 60 + 1 :]])) for k in range(400)]
    got = J.jaccard_components(table(spark, rows), 3, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, 3, 80)
    assert len({r.component_id for r in got}) < 10


def test_blocks_travel_whole():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 7, 300)]
    block = J.Block(np.array([5, 6, 7]), np.array([1, 2, 3]), sets)
    again = J.Block.unpacked(block.packed())
    assert again.node.tolist() == [5, 6, 7] and again.copies.tolist() == [1, 2, 3] and all((a == b).all() for a, b in zip(again.tokens, sets, strict=True))


def test_long_words_and_texts_hash_alike():
    """Words and shingles don't depend on the chunk that a text is hashed in."""
    from loomtide.llm import textnum as tn

    text = " ".join(f"w{k}" for k in range(400_000)) + " " + "x" * (3 << 20) + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    h, n = tn.words(data, np.array([0, len(data)]))
    assert n.tolist() == [400_002]
    for k in (0, 1234, 399_999, 400_001):
        word = np.frombuffer(text.split(" ")[k].encode(), np.uint8)
        assert tn.words(word, np.array([0, len(word)]))[0][0] == h[k]
    value = 0
    for c in reversed(b"x" * (3 << 20)):
        value = (value * tn._BASE + int(tn._VALUE[c])) % (1 << 64)
    assert tn.mix(np.array([value], np.uint64))[0] == h[400_000]


def test_lists_are_read_through_in_order(monkeypatch):
    monkeypatch.setattr(J, "KEYS", 7)
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(u)) for k, u in zip(rng.integers(-4, 4, 60), rng.integers(-50, 50, 60), strict=True)} | {(9, u) for u in range(25)})
    rows = [(k, u, None) for k, u in rows]
    rows[5:5], rows[40:40] = [(rows[5][0], 70, 71)], [(rows[40][0], 72, 73)]
    want = {(70, 71), (72, 73)}
    for k in {r[0] for r in rows}:
        nodes = [u for key, u, v in rows if key == k and v is None]
        want |= {(nodes[0], u) for u in nodes[1:]}
    for size in (1, 4, 200):
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], J._LISTED) for i in range(0, len(rows), size)]
        got = pa.Table.from_batches(J._tied(batches))
        assert set(zip(*(c.to_pylist() for c in got.columns), strict=True)) == want
    assert not list(J._tied([]))


def test_lists_lose_no_pair():
    """Any two sets that link share a key, whatever shingles count as frequent."""
    rng = np.random.default_rng(0)
    for num in (60, 80, 90, 95):
        plan = J.Plan(num, 100)
        for n in [*range(1, 60), 100, 333]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for frequent in (None, np.sort(a[: n // 2]), a):
                b = a
                while True:
                    b = np.unique(np.append(b[1:], rng.integers(0, 1 << 63, int(rng.integers(2)), dtype=np.uint64)))
                    both = len(np.intersect1d(a, b))
                    if 100 * both < num * (len(a) + len(b) - both) or not len(b):
                        break
                    keys = [set(J.list_keys(x, np.array([len(x)]), plan, frequent)[0].tolist()) for x in (a, b)]
                    assert keys[0] & keys[1], (num, len(a), len(b))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500 + k, 501 + k) for k in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {v: root(v) for e in edges for v in e if e[0] != e[1]}


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*[(i, t) for i, t in TEXTS if i], (50, "<|endoftext|> it's  odd\x00\x1c  \n\n"), (51, "é" * 3000)]
    codes = {r.doc_id: r.ids for r in bpe_codes(table(spark, rows), path, public_tokenizers.PATTERN).collect()}
    for r in bpe_roundtrip(table(spark, rows), path, public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = model.encode_ordinary(text)
        assert codes[r.doc_id] == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_counts():
    vocabulary = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    pieces, matcher = set(vocabulary), Matcher(vocabulary)

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = next((z for z in range(len(word), at, -1) if word[at:z] in pieces), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    for w in ("unbelievable", "xqzzy", "a", "thethethe", "0", "straße", "日" * 5):
        w = "".join(c for c in w if c < "\x7f") + END
        assert matcher.count(w) == greedy(w)
    small = Matcher(["ab", "abc" + END, "c", "d" + END, "abcde"])
    assert [small.count(w + END) for w in ("abc", "abcd", "abd", "zz", "abcdf")] == [1, 3, 2, 1, 1]


def test_audio(spark):
    row = audio.audio_features(table(spark, [(1, "Hello wörld " * 400)]), with_media=True).first()
    raw = ("Hello wörld " * 400).encode()
    payload = raw + bytes(-len(raw) % 64)
    assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    assert audio.from_wav(bytes(row.media))[0] == payload and row.media_sha256 == hashlib.sha256(bytes(row.media)).hexdigest()
    cube = audio.from_ipc(bytes(row.tensors))
    assert cube.column("log_mel").type.shape == [audio.WINDOW, audio.BANDS] and cube.column("start_s")[0].as_py() == 0
    x = np.random.default_rng(0).standard_normal(500).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        spread = np.zeros(len(x) * up)
        spread[::up] = x
        h = audio._lowpass(up, down)
        assert np.allclose(audio.resample(x, up, down), np.convolve(spread, h)[len(h) // 2 :][: len(spread)][::down], atol=1e-5)
    assert audio.segments(np.array([0, 0, 9, 5, 4, 0, 0, 8], np.float32)) == [(2, 5), (7, 8)]


def test_mixing(spark):
    assert mixing.share_out(100, {"a": (0.5, 10), "b": (0.25, 1000), "c": (0.25, 1000)}) == {"a": 10, "b": 45, "c": 45}
    leaves = {("d", "en", "s1"): 100, ("d", "en", "s2"): 1000, ("d", "fr", "s1"): 1000}
    goal = mixing.budgets(leaves, 1000, ({}, {"en": 0.5, "fr": 0.5}, {}), 1)
    assert goal == {("d", "en", "s1"): 100, ("d", "en", "s2"): 400, ("d", "fr", "s1"): 500}
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 7))").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 2).cast("string")).alias("source"))
    got = mixing.mixture(docs, share=0.7, domain_weights={"domain0": 0.9, "domain1": 0.1}, max_epochs=2).toPandas()
    total = 4000 * 4
    for source, goal in (("src0", 0.63 * total), ("src1", 0.07 * total)):
        part = got[got.source == source]
        assert goal - 7 <= (part.tokens * part.copies).sum() <= goal


def test_label_model_against_its_definition():
    """Posteriors are Bayes' rule over the voters' tables; independent voters' accuracies are found without labels."""
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    right = [0.95, 0.9, 0.8, 0.85]
    v = np.stack([np.where(rng.random(len(y)) < 0.3, 0, np.where(rng.random(len(y)) < a, 1, -1) * np.where(y, 1, -1)) for a in right], 1)
    model = LabelModel().fit(v, 0.2)
    for row in v[:50]:
        p = [1 - model.prior, model.prior]
        for k, vote in enumerate(row):
            for label in (0, 1):
                p[label] *= model.table[label][vote + 1][k] ** model.weight[k]
        assert abs(1 / (1 + np.exp(-model.evidence(row[None]))[0]) - p[1] / sum(p)) < 1e-9
    for k, a in enumerate(right):
        said = model.table[1][:, k]
        assert abs(said[2] / (said[0] + said[2]) - a) < 0.04 and abs(said[1] - 0.3) < 0.02
    assert ((model.posterior > 0.5) == y).mean() > 0.95


def test_near_copies_count_once():
    rows = [" ".join(f"{chr(97 + k % 26)}{'abcdefgh'[k // 26]}word" for k in range(50)), "a different text of its own words"]
    assert distinct_rows([rows[0], rows[0] + " more", rows[1], rows[1].upper(), "", "", "a different text of other things"]) == [0, 2, 4, 6]


def test_mixing_against_a_plain_sort(spark):
    """The chosen rows are the prefixes that a sort and a running sum of each leaf give; unlisted languages have their weight."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id * 7 % 11))").alias("text"), F.expr("array('en','fr','de','es','it',null)[id % 6]").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 5).cast("string")).alias("source"))
    got = {r.doc_id: r for r in mixing.mixture(docs, share=0.6, max_epochs=2).collect()}
    rows = mixing.mixture(docs, share=1.0, domain_weights={}, lang_weights={}, max_epochs=1).collect()
    assert len(rows) == 3000
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[r.domain, r.lang, r.source].append(r)
    total = {k: sum(r.tokens for r in v) for k, v in leaves.items()}
    weights = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})
    goal = mixing.budgets(total, int(0.6 * sum(total.values())), weights, 2)
    assert {k[1] for k, n in goal.items() if n} == {"en", "fr", "de", "es", "it", "none"}
    for leaf, members in leaves.items():
        whole, rest = divmod(goal[leaf], total[leaf])
        order = spark.createDataFrame([(r.doc_id, r.digest) for r in members], "doc_id long, digest long").select("doc_id", F.xxhash64(F.lit("mix"), F.lit(whole).cast("long"), F.col("digest")).alias("o")).collect()
        place = {r.doc_id: r.o % (1 << 64) for r in order}
        run, past = 0, False
        for r in sorted(members, key=lambda r: place[r.doc_id]):
            run += r.tokens
            past = past or run > rest
            want = whole + (not past)
            assert (got[r.doc_id].copies if r.doc_id in got else 0) == want


def test_token_counts_of_whole_texts(spark):
    """The query's counts against a greedy split of every word, over long and odd texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, chars = set(read_vocabulary(path)), byte_chars()
    rows = [*[(i, t) for i, t in TEXTS if i], (60, "Word, 12 words!\u00a0and—more " * 3000), (61, "ab" * 4000)]

    def greedy(word):
        word = "".join(chars[b] for b in word.encode()) + END
        n = at = 0
        while at < len(word):
            end = next((z for z in range(min(len(word), at + 80), at, -1) if word[at:z] in pieces), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    for r in token_counts(table(spark, rows), path).collect():
        words = regex.findall(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", (dict(rows)[r.doc_id] or "").lower())
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(greedy, words)))


def test_parts_hold_whole_words():
    from loomtide.llm.token_counts import parts

    text = "some words and_a_very_long_one " * 50
    for size in (1, 7, 40, 10_000):
        cut = list(parts(text, size))
        assert "".join(cut) == text and all(regex.findall(r"\S+", text) == sum((regex.findall(r"\S+", p) for p in cut), []) for _ in (0,))


def test_long_texts_encode_alike():
    from loomtide.llm import bpe

    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "It's  a text, 123 of\n\n words " * 500
    whole = c.encode([text])[0]
    c.cache.clear()
    assert c._encode_long(text) == whole and c.decode(whole) == text.encode()


def test_toxicity_and_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, lab).join(lab, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 2 and held[held.toxic == 1].score.mean() > 0.4
    assert train(["a", "b"], [0, 0]).score(["x", ""]).tolist() == [0.0, 0.0]
    scored = quality_scores(docs, lab).join(lab, "doc_id").toPandas()
    assert scored[scored.quality == 1].kept.mean() > 0.95 and scored[scored.quality == 0].kept.mean() < 0.4


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_exact_stage_survives_another_split(spark, tmp_path, monkeypatch):
    """A second scan that is split in another way keeps the same rows; repeated rows and null ids leave one row a group."""
    import corpus_pipeline

    rows = [(k, f"text {k % 40}", "en", f"s{k}", 1) for k in range(400)] + [(399, "Text 39", "fr", "x", 1)] * 2 + [(None, None, None, None, None), (None, "", None, "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(7).write.parquet(str(tmp_path / "docs"))
    real, key = corpus_pipeline.save, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def save_then_split(df, tag):
        out = real(df, tag)
        spark.conf.set(key, "1200")
        return out

    monkeypatch.setattr(corpus_pipeline, "save", save_then_split)
    try:
        got = corpus_pipeline.exact(spark, spark.read.parquet(str(tmp_path / "docs")), None).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.text or "").lower() for r in got) == sorted({f"text {k}" for k in range(40)} | {""})
    assert all(r.doc_id is None or r.doc_id >= 360 for r in got)


def test_training_sample_holds_whole_texts(spark, monkeypatch):
    from loomtide.llm import toxicity as T

    rows = [(k, f"row {k} " * 10) for k in range(60)] + [(3, "row 3 again")] * 5 + [(61, "w " * 200_000)]
    known = labels(spark, [(k, 1, k % 2) for k in range(62)])
    got = T.labelled_sample(table(spark, rows), known)
    assert len({i for i, _, _ in got}) == len(got) and all((i, t) in rows for i, t, _ in got)
    assert {i for i, _, _ in got} == {k for k in [*range(60), 61] if zlib.crc32(str(k).encode()) % 3 != 1}
    monkeypatch.setattr(T, "SAMPLE_CHARS", 500)
    few = T.labelled_sample(table(spark, rows), known)
    assert 0 < sum(len(t) for _, t, _ in few) <= 500 and set(few) < set(got)


def test_near_stage_keys_rows_by_id_and_text(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(base)), (9, " ".join([*base, "end"])), (9, "a text of its own under an id that is dropped elsewhere"), (None, " ".join([*base, "more"])), (None, "no id but a text of its own"), (7, None), (8, "")]
    docs = table(spark, rows)
    got = corpus_pipeline.near(spark, docs, None).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted((rows[k] for k in (0, 2, 4, 5, 6)), key=str)


def test_pairs_of_short_lists_and_ties_of_long_ones(monkeypatch):
    """Whatever the batches, a list of at most so many members gives all pairs, the larger node first, and a longer one its ties."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(k), int(u)) for k, u in zip(rng.integers(-9, 9, 70), rng.integers(-50, 50, 70), strict=True)} | {(20, u) for u in range(40)})
    want = set()
    for k in {r[0] for r in rows}:
        nodes = sorted(u for key, u in rows if key == k)
        want |= {(v, u) for u in nodes for v in nodes if u < v} if len(nodes) <= 4 else {(nodes[0], u) for u in nodes[1:]}
    for length, size in ((3, 1), (7, 4), (1000, 9)):
        monkeypatch.setattr(J, "SORTED", length)
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*((k, u, None) for k, u in rows[i : i + size]), strict=True)], J._LISTED) for i in range(0, len(rows), size)]
        got = pa.Table.from_batches(J._tied(batches, 4))
        assert set(zip(*(c.to_pylist() for c in got.columns), strict=True)) == want


def test_parities_lose_no_pair():
    """Sets that link pass, whatever their sizes; unlike sets of the same size don't."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 9, 30, 63, 64, 65, 127, 128, 129, 140, 1000, 1024, 1100, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for lost in (0, 1, n // 20, n // 10, n // 5):
            sets.append(np.unique(np.append(a[lost:], rng.integers(0, 1 << 63, lost // 2, dtype=np.uint64))))
    sets = [a for a in sets if len(a)]
    sizes = np.array([len(a) for a in sets])
    data, off = J.parities(np.concatenate(sets), sizes)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    for num in (60, 80, 90):
        links = 100 * both >= num * (sizes[i] + sizes[j] - both)
        passed = J.alike(data, off[:-1], np.diff(off), sizes, i, j, num, 100)
        assert passed[links].all()
        if num > 60:
            assert not passed[(both == 0) & (np.minimum(sizes[i], sizes[j]) >= 100)].any()


@pytest.mark.parametrize("paired", [1, 3, 32])
def test_sets_that_share_a_phrase_are_no_family(spark, monkeypatch, paired):
    """Long texts that share single phrases with others are not verified, since their chains would grow with the corpus; near copies are."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(120):
        w = [f"w{v}" for v in rng.integers(0, 1 << 30, 300)]
        for j in range(6):  # each phrase lies in two or more texts
            at = 10 + 45 * j
            phrase = int(rng.integers(60))
            w[at : at + 5] = [f"p{phrase}-{i}" for i in range(5)]
        rows.append((2 * k, " ".join(w)))
    rows += [(1001 + k, t + " end") for k, (_, t) in enumerate(rows[:5])]
    sizes = {}

    def kept(df, tag, save=J.save):
        out = save(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(J, "PAIRED", paired)
    monkeypatch.setattr(J, "save", kept)
    got = J.jaccard_components(table(spark, rows), 5, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, 5, 80)
    assert sizes["members"] == 10


def test_workers_get_small_batches_and_keep_one_cache(spark):
    """A batch is bounded by bytes; what a worker keeps for one kind of work goes when it does other work."""
    path, size = public_tokenizers.path("byte_bpe_50k.tiktoken"), "spark.sql.execution.arrow.maxBytesPerBatch"

    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([bpe.codec.cache_info().currsize])], ["bytes", "codecs"])

    before = spark.conf.get(size)
    texts = spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('many words ', 10000)").alias("text"))
    shared.save(bpe_roundtrip(texts, path, public_tokenizers.PATTERN), "codes")
    got = shared.save(texts.mapInArrow(shared.tidied(run), "bytes long, codecs long"), "batches").collect()
    assert max(r.bytes for r in got) < 2 << 20 and sum(r.bytes for r in got) > 100 * 110_000
    assert {r.codecs for r in got} == {0}
    assert spark.conf.get(size) == before


def test_worker_caches_by_operator():
    first = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    list(shared.tidied(lambda batches: iter(batches), bpe.codec)([]))
    assert bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN) is first
    list(shared.tidied(lambda batches: iter(batches))([]))
    assert bpe.codec.cache_info().currsize == 0


def test_workers_hand_on_small_batches():
    rows = pa.record_batch([pa.array(range(500_000)), pa.array(["x"] * 500_000)], ["u", "v"])
    long, none = pa.record_batch([pa.array(["y" * 3_000_000] * 2)], ["t"]), rows.slice(0, 0)
    got = list(shared.tidied(lambda batches: iter([rows, none]))([]))
    assert max(b.nbytes for b in got) <= shared.SMALL_BYTES + 64 and pa.Table.from_batches(got).equals(pa.Table.from_batches([rows]))
    assert [b.num_rows for b in shared.tidied(lambda batches: iter([long]))([])] == [1, 1]


def test_mixing_starts_no_python_workers(spark, capsys):
    mixing.mixture(table(spark, [(1, "a b")])).explain()
    assert "ExistingRDD" not in capsys.readouterr().out  # the fixture's rows are one, but are written before
