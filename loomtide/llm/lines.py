"""Repeated text units: lines, sentences or paragraphs, and overlapping windows of them.

Units are normalised (spaces collapsed, lower case) and digested; digests are
grouped over the whole corpus, after a partial aggregation in each task.  The
occurrence that ranks first, by doc_id and then by place, stays.

A unit's span holds its text and the break that ends it, so that the spans of a
text lie side by side and what stays is the text without the spans that go.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.shared import drop, row_key, save, slices, tidied

#: What ends a unit.  A sentence also ends with its line.
BREAKS = {"line": re.compile(r"\n"), "sentence": re.compile(r"\n|[.!?][ \t]+|[。！？]"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
CHARS_A_WORD = 8  # a unit counts at least one word for so many characters, so that scripts without spaces have words too
_UNITS = "k long, digest long, place int, h1 long, h2 long"


def split_units(text: str, unit: str = "line") -> list[tuple[int, int, str]]:
    """(first, end, normalised text) of each unit that isn't blank; offsets count characters of ``text``."""
    out, at = [], 0
    ends = [m.end() for m in BREAKS[unit].finditer(text)]
    for end in itertools.chain(ends, [len(text)]):
        norm = " ".join(text[at:end].split()).lower()
        if norm:
            out.append((at, end, norm))
        at = end
    return out


def words_of(norm: str) -> int:
    """Words of a normalised unit, at least one for CHARS_A_WORD characters."""
    return max(norm.count(" ") + 1, len(norm) // CHARS_A_WORD)


def runs(covered: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers; ``covered`` rises."""
    out: list[tuple[int, int]] = []
    for i in covered:
        if out and i == out[-1][1] + 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``, which rise and don't overlap."""
    out, at = [], 0
    for a, z in spans:
        out.append(text[at:a])
        at = z
    return "".join(out) + text[at:]


def _occurrences(unit: str, window: int):
    def table(rows):
        k, digest, place, h = zip(*rows, strict=True)
        halves = np.frombuffer(b"".join(h), np.int64)
        return pa.record_batch([pa.array(k, pa.int64()), pa.array(digest, pa.int64()), pa.array(place, pa.int32()), pa.array(halves[::2]), pa.array(halves[1::2])], ["k", "digest", "place", "h1", "h2"])

    def run(batches):
        for part in slices(batches, 2):
            rows = []
            for doc, digest, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                norms = [u[2] for u in split_units(text, unit)]
                for place in range(len(norms) - window + 1):
                    norm = norms[place] if window == 1 else "\n".join(norms[place : place + window])
                    rows.append((doc, digest, place, xxhash.xxh3_128_digest(norm)))
                if len(rows) > 100_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return run


def _without(unit: str, window: int, min_words: int, min_unit: int):
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def one(text, later):
        """(repeats, spans) that go."""
        units = split_units(text, unit)
        covered = sorted({i for s in later for i in range(s["start"], s["place"] + window)})
        lengths = [words_of(u[2]) for u in units]
        gone = [(a, z) for a, z in runs(covered) if sum(lengths[a : z + 1]) >= min_words and max(lengths[a : z + 1]) >= min_unit]
        starts = sorted(s["start"] for s in later)
        n = sum(bisect.bisect_right(starts, z) - bisect.bisect_left(starts, a) for a, z in gone)
        return n, [(units[a][0], units[z][1]) for a, z in gone]

    def run(batches):
        for part in slices(batches, 1):
            doc, texts, later = (c.to_pylist() for c in part.columns)
            got = [one(t, x) if x else (0, []) for t, x in zip(texts, later, strict=True)]
            kept = [cut(t, s) if s else t for t, (_, s) in zip(texts, got, strict=True)]
            yield pa.record_batch(
                [
                    pa.array(doc, pa.int64()),
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([len(s) for _, s in got], pa.int64()),
                    pa.array([sum(z - a for a, z in s) for _, s in got], pa.int64()),
                    pa.array([[{"first": a, "end": z} for a, z in s] for _, s in got], span),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_repeats", "n_spans", "removed_chars", "spans", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, unit: str = "line", window: int = 1, min_words: int = 1, min_unit: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_repeats, n_spans, removed_chars, spans, text.

    ``window`` consecutive units (blank ones aside) are a repeat if equal ones
    rank before them; the order is doc_id (a null one first), then place.  Units
    covered by repeats make runs of consecutive units; a run goes if it has at
    least ``min_words`` words and a unit of at least ``min_unit`` (see :func:`words_of`).  A repeat that overlaps its
    own first occurrence covers only the units past that occurrence, so that the
    first occurrence stays whole: of five equal lines three stay with a window
    of three.

    ``spans`` are the runs' places in the original text, in characters, with the
    break that ends each unit and blank units between; ``text`` is the text
    without them, ``removed_chars`` their length, ``n_spans`` their number and
    ``n_repeats`` the repeats that they hold.  A null text is empty; empty texts and texts
    with fewer units have no repeats.  Rows that repeat both doc_id and text
    count as one occurrence and are cut alike; of different texts under one
    doc_id (or without one) the first is decided by a digest of the text.  A text
    may be as long as an Arrow string (2 GiB).  An empty table gives no rows.
    Other columns are not read.
    """
    doc = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(doc.alias("doc_id"), *row_key(doc, text), text.alias("text"))
    found = save(base.select("k", "digest", "text").mapInArrow(tidied(_occurrences(unit, window)), _UNITS), "units")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("k", "digest", "place")).alias("head"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    first = save(first, "first")  # written, so that the occurrences of a common unit can be split in the join
    # Both joins are planned alike at every size: what they join grows with the corpus.
    same = (F.col("k") == F.col("head.k")) & (F.col("digest") == F.col("head.digest"))
    later = found.join(first.hint("merge"), ["h1", "h2"]).where(~(same & (F.col("place") == F.col("head.place"))))
    start = F.when(same, F.greatest("place", F.col("head.place") + window)).otherwise(F.col("place"))
    later = later.select("k", "digest", "place", start.alias("start")).distinct()
    places = save(later.groupBy("k", "digest").agg(F.collect_list(F.struct("place", "start")).alias("later")), "places")  # of one text
    out = base.join(places.hint("merge"), ["k", "digest"], "left").select("doc_id", "text", "later")
    drop(found, first)
    return out.mapInArrow(tidied(_without(unit, window, min_words, min_unit)), "doc_id long, n_repeats long, n_spans long, removed_chars long, spans array<struct<first:int,end:int>>, text string")
