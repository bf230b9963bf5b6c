"""Repeated units against a brute force, and both queries against their SQL."""

import collections
import re

import duckdb
import numpy as np
import pytest

from loomtide.llm.line_dedup import line_dedup
from loomtide.llm.queries import ORACLE_SQL, QUERIES
from loomtide.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, k long, digest string, later string, h1 string, place string"
ENDS = {"line": r"\n", "sentence": r"\n|[.!?][ \t]+|[。！？]"}


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d", "l", "h", "p") for i, t in rows], SCHEMA)


def brute(rows, unit, window, min_words, min_unit):
    """Texts without repeats, by comparing the units themselves."""
    docs = []
    for i, t in rows:
        parts, tile = [], ""
        for c in re.split(f"({ENDS[unit]})", t or ""):
            tile += c
            if re.fullmatch(ENDS[unit], c):
                parts.append(tile)
                tile = ""
        docs.append((i, t or "", [*parts, tile]))
    order = sorted(range(len(docs)), key=lambda d: (docs[d][0] is not None, docs[d][0] or 0))
    first, out = {}, {}
    for d in order:
        live = [(k, " ".join(p.split()).lower()) for k, p in enumerate(docs[d][2]) if p.split()]
        covered, repeats = set(), []
        for n in range(len(live) - window + 1):
            name = tuple(x for _, x in live[n : n + window])
            head = first.setdefault(name, (d, n))
            if head == (d, n):
                continue
            start = max(n, head[1] + window) if head[0] == d else n
            covered.update(range(start, n + window))
            repeats.append(start)
        words = [max(len(x.split()), len(x) // 8) for _, x in live]
        gone, total = set(), 0
        for n in sorted(covered):
            if n - 1 in covered:
                continue
            run = list(range(n, next(z for z in range(n, len(live) + 1) if z not in covered)))
            if sum(words[x] for x in run) >= min_words and max(words[x] for x in run) >= min_unit:
                gone.update(range(live[run[0]][0], live[run[-1]][0] + 1))
                total += sum(r in run for r in repeats)
        out[d] = (docs[d][0], total, "".join(p for k, p in enumerate(docs[d][2]) if k not in gone))
    return [out[d] for d in range(len(docs))]


def corpus():
    rng = np.random.default_rng(5)
    said = [" ".join(f"w{v}" for v in rng.integers(0, 40, n)) for n in rng.integers(1, 14, 60)]
    rows = []
    for i in range(80):
        text = ""
        for _ in range(rng.integers(0, 25)):
            at = int(rng.integers(len(said)))
            for s in said[at : at + int(rng.integers(1, 6))]:  # passages of several units
                text += s.upper() if rng.integers(5) == 0 else s
                text += ["\n", ". ", "!  ", "\n\n \n", "。", "? "][rng.integers(6)]
        rows.append((int(i), text))
    rows += [(200, None), (201, ""), (202, " \n\t\n"), (203, "one line"), (204, "One  LINE"), (205, "a\na\na\na\na"), (206, "a\nb\na\nb\na\nb\na"), (207, "空白のない行が続きます。" * 3), (208, "空白のない行が続きます。" * 3)]
    return rows


@pytest.mark.parametrize(("unit", "window", "words", "longest"), [("sentence", 1, 25, 8), ("sentence", 1, 1, 1), ("line", 1, 6, 3), ("line", 3, 1, 1), ("sentence", 2, 9, 4)])
def test_against_brute_force(spark, unit, window, words, longest):
    from loomtide.llm.lines import remove_repeats

    rows = corpus()
    got = remove_repeats(table(spark, rows), unit, window, words, longest).collect()
    assert sorted((r.doc_id, r.n_repeats, r.text) for r in got) == sorted(brute(rows, unit, window, words, longest))
    texts = dict(rows)
    for r in got:  # every column tells the same spans
        assert r.n_spans == len(r.spans) and r.removed_chars == sum(s.end - s.first for s in r.spans) == len(texts[r.doc_id] or "") - len(r.text)
        kept = list(texts[r.doc_id] or "")
        for s in reversed(r.spans):
            del kept[s.first : s.end]
        assert "".join(kept) == r.text and (r.n_repeats > 0) == (r.n_spans > 0)


def test_null_ids_and_ties(spark):
    """A null id ranks first; rows that repeat id and text are cut alike; of texts under one id one keeps its units."""
    long = "this is a line of more than eight words for the test. and a second one that makes the run as long as it has to be here"
    rows = [(5, long), (None, long), (None, long), (7, long + "\nmore"), (7, long + "\nmore"), (9, "x\n" + long), (9, "y\n" + long)]
    got = collections.Counter((r.doc_id, r.n_repeats, r.text) for r in substring_dedup(table(spark, rows)).collect())
    assert got[(None, 0, long)] == 2 and got[(5, 2, "")] == 1 and got[(7, 2, "more")] == 2 and got[(9, 2, "x\n")] == got[(9, 2, "y\n")] == 1


def test_first_occurrence_stays_whole(spark):
    got = {r.doc_id: r.text for r in line_dedup(table(spark, [(1, "a\na\na\na\na"), (2, "q\na\na\na\nz")])).collect()}
    assert got == {1: "a\na\na\n", 2: "q\nz"}


def test_very_long_text(spark):
    """50 MB in one row, with a passage that another row has too."""
    passage = "this passage of many words stands in two rows, and one of them is very long. it has two sentences, which are found wherever they begin or end"
    long = "".join(f"{k} has a line of its own here\n" for k in range(1_600_000)) + passage
    got = {r.doc_id: (r.n_repeats, r.removed_chars) for r in substring_dedup(table(spark, [(1, passage), (2, long)])).select("doc_id", "n_repeats", "removed_chars").collect()}
    assert len(long) > 50_000_000 and got == {1: (0, 0), 2: (2, len(passage))}


def test_hot_unit(spark):
    """One passage in most rows: every row but the first loses it, and no task holds them all."""
    passage = "one passage that nearly every row of the table holds, twenty words or more of it. so that it counts as one and goes from all rows but the first of them"
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat('row ', id, '\n', if(id % 10 = 0, '', '{passage}')) AS text")
    got = {r.n_repeats: r["count"] for r in substring_dedup(docs).groupBy("n_repeats").count().collect()}
    assert got == {0: 2001, 2: 17_999}


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op5_line_dedup"])
def test_query_against_sql(spark, name, tmp_path):
    table(spark, corpus()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.select(*want.columns).collect()) == sorted(want.fetchall())
