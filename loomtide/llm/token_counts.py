"""Word-piece counts by a longest-match automaton that never steps back.

A trie of the vocabulary gets failure links; each link knows how many tokens are
popped when it is taken.  Reading a word's characters once therefore gives the
number of greedy longest-match pieces without building a piece.
"""

from __future__ import annotations

import functools
import json
from collections import deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.bpe import byte_chars
from loomtide.llm.shared import slices, tidied, worker_cache

END = "\n"  # ends a word; no byte character is a line feed
CACHE_WORDS = 100_000
PART = 1 << 20  # characters of a text whose words are held at a time; parts end at spaces
WORDS = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Matcher:
    """Counts greedy pieces of words.  ``vocabulary``: strings, in which ``END`` closes a word."""

    def __init__(self, vocabulary):
        self.next: list[dict[str, int]] = [{}]
        token = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                at = to
            token[at] = at > 0
        #: Where to go on when a character doesn't fit (-1: nowhere), and how many tokens that pops.
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if token[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                at, n = self.fail[u], self.popped[u]
                while at >= 0 and c not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.next[at][c], n

    def count(self, word: str) -> int:
        """Pieces of ``word``; 1 (the unknown token) if it has no split into pieces."""
        at = n = 0
        for c in word:
            while c not in self.next[at]:
                if self.fail[at] < 0:
                    return 1
                n += self.popped[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at:
            if self.fail[at] < 0:
                return 1
            n += self.popped[at]
            at = self.fail[at]
        return n


class WordCounts(dict):
    """Piece counts of words, kept by word."""

    def __init__(self, vocabulary):
        self.matcher = Matcher(vocabulary)
        self.table = byte_chars()

    def __missing__(self, word: str) -> int:
        n = self[word] = self.matcher.count(word.encode().decode("latin-1").translate(self.table) + END)
        return n


def read_vocabulary(path: str) -> list[str]:
    """Pieces of a tokenizers JSON file whose word-final pieces carry an end suffix; special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    suffix = spec["model"].get("end_of_word_suffix") or "</w>"
    special = {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
    return [p.removesuffix(suffix) + END if p.endswith(suffix) else p for p in spec["model"]["vocab"] if p not in special]


@worker_cache
@functools.lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    """One automaton a Python worker."""
    return WordCounts(read_vocabulary(path))


def parts(text: str, size: int = PART):
    """``text`` in parts of about ``size`` characters that end before a space, which no word holds."""
    space, at = regex.compile(r"\s"), 0
    while len(text) - at > size and (m := space.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens.

    Words are the matches of ``pattern``, which hold no spaces, in the lower-cased whole text; a word's
    tokens are its greedy longest-match pieces, a word without a split counts as
    one.  Null and empty texts have 0 of both; repeats and null doc_ids stay; an
    empty table gives no rows.  Other columns are not read.
    """

    def run(batches):
        find, counts = regex.compile(pattern).findall, word_counts(path)
        for b in slices(batches, 1):
            words, tokens = [], []
            for text in b.column(1):
                n_words = n_tokens = 0
                for part in parts(text.as_py()):
                    found = find(part.lower())
                    n_words += len(found)
                    n_tokens += sum(map(counts.__getitem__, found))
                    if len(counts) > CACHE_WORDS:
                        counts.clear()
                words.append(n_words)
                tokens.append(n_tokens)
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(tidied(run, word_counts), "doc_id long, n_words long, n_tokens long")
