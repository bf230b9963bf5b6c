"""Byte-level BPE through a sentencepiece model that is written from a rank file.

Nothing is trained: the model's pieces are the rank file's tokens in byte-mapped
form, scored by negative rank, with identity normalisation, so that the merges
happen in rank order.  The protocol buffer is serialised here field by field.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.shared import slices, tidied, worker_cache

CACHE_WORDS = 80_000
CHUNK, CHUNK_BYTES = 256, 2 << 20  # documents, and bytes of them, whose new pre-tokens are encoded in one call
WORDS = 200_000  # pre-tokens of a longer text that are held at a time


def byte_chars() -> str:
    """A printable character for each byte: visible Latin-1 ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id; ids must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("ranks must run from 0 without gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece ids are the ranks, the unknown piece comes last."""
    table = byte_chars()
    pieces = [_field(1, _field(1, t.decode("latin-1").translate(table).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)))
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + unknown + trainer + normalizer


class Codec:
    """Encodes texts to ids and back; pre-tokens are split by ``pattern`` and encoded one by one."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.pattern = regex.compile(pattern)
        self.table = byte_chars()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.cache: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Put the packed ids of ``words`` into the cache."""
        slow, mapped = [], []
        for w in words:
            raw = w.encode()
            rank = self.whole.get(raw)
            if rank is not None:
                self.cache[w] = struct.pack("<I", rank)
            else:
                slow.append(w)
                mapped.append(raw.decode("latin-1").translate(self.table))
        for w, ids in zip(slow, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            self.cache[w] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if sum(map(len, texts)) > CHUNK_BYTES:
            return [self._encode_long(t) for t in texts]
        parts = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*parts).difference(self.cache))
        return [b"".join(map(self.cache.__getitem__, p)) for p in parts]

    def _encode_long(self, text: str) -> bytes:
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(itertools.islice(found, WORDS)):
            self.learn(set(part).difference(self.cache))
            out.append(b"".join(map(self.cache.__getitem__, part)))
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


@worker_cache
@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a Python worker."""
    return Codec(path, pattern)


def bpe_codes(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row; a null text is the empty text, which has no ids.  Row order and repeats are kept."""

    def run(batches):
        c = codec(path, pattern)
        for part in slices(batches, 1, CHUNK, CHUNK_BYTES):
            packed = c.encode(part.column(1).to_pylist())
            ends = list(itertools.accumulate((len(p) // 4 for p in packed), initial=0))
            ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidied(run, codec), "doc_id long, ids array<int>")


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each text is encoded, its ids are decoded again, and both are digested.  A
    null or empty text has 0 tokens and digests of nothing; null doc_ids stay
    null; an empty table gives no rows.  Other columns are not read.
    """

    def run(batches):
        c = codec(path, pattern)
        for part in slices(batches, 1, CHUNK, CHUNK_BYTES):
            packed = c.encode(part.column(1).to_pylist())
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(c.decode(p)).hexdigest() for p in packed], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        c.cache.clear()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(tidied(run, codec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
