"""Pages, models and vectors from servers, through Arrow batches on the executors.

A provider is a picklable object with one method; a task calls it for the rows
of its batches.  Servers answer a repeated call differently, so results are
written before they are used twice, and speculation must be off for the stage.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.functions import replies as R
from loomtide.functions import urls as U

EMBED_BATCH = 64
FETCHED = "id long, final_url string, html string, error_kind string, error string"
SUMMARIES = "id long, title string, summary string, language string, tags array<string>, new_tags array<struct<name:string,description:string>>, error_kind string, error string, stop boolean, input_tokens long, output_tokens long, requests long, retries long, invalid long, without_usage long, seconds double"


class Fetcher(Protocol):
    def fetch(self, url: str) -> dict:
        """``final_url`` and ``html``, or ``error_kind`` and ``error``."""


class Chat(Protocol):
    def ask(self, messages: list[dict], schema: dict) -> dict:
        """``content`` and ``usage``; or ``status`` or ``failure`` with ``error``.  ``retries`` counts repeated tries."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class Slots:
    """Evenly spaced request times; 0 a minute means no limit.  The limit is a task's share of the whole."""

    per_minute: float = 0
    due: float = 0.0

    def wait(self, now: float) -> float:
        """Seconds to wait before a request that is ready at ``now``."""
        if not self.per_minute:
            return 0.0
        start = max(now, self.due)
        self.due = start + 60.0 / self.per_minute
        return start - now


def _open(request, timeout: float) -> tuple[int | None, dict, bytes, str | None, str]:
    """(status, headers, body, failure, final url) of one HTTP call."""
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read(R.MAX_HTML), None, r.geturl()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read(R.MAX_HTML), None, request.full_url
    except (TimeoutError, OSError) as e:
        reason = getattr(e, "reason", e)
        failure = "timeout" if isinstance(reason, TimeoutError) else "dns" if isinstance(reason, socket.gaierror) else "connection"
        return None, {}, b"", failure, request.full_url


def _tries(request, timeout: float, retries: int, most: float, sleep: Callable = time.sleep):
    for attempt in range(retries + 1):
        status, headers, body, failure, url = _open(request, timeout)
        if attempt == retries or not R.may_retry(status, failure):
            return status, headers, body, failure, url, attempt
        after = headers.get("Retry-After", "")
        sleep(R.backoff(attempt, float(after) if re.fullmatch(r"\d+(\.\d+)?", after) else None, most))


@dataclass
class HttpFetcher:
    timeout: int = 20
    retries: int = 2
    user_agent: str = "Mozilla/5.0 (compatible; loomtide)"

    def fetch(self, url: str) -> dict:
        request = urllib.request.Request(url, headers={"User-Agent": self.user_agent, "Accept": "text/html,application/xhtml+xml"})
        status, headers, body, failure, final, _ = _tries(request, self.timeout, self.retries, 30.0)
        kind = R.fetch_error(status, headers.get("Content-Type"), failure)
        if kind:
            return {"error_kind": kind, "error": failure or f"HTTP {status}"}
        return {"final_url": final, "html": R.decode_page(body, headers.get("Content-Type"))}


@dataclass
class ChatServer:
    base_url: str
    model: str
    key_env: str | None = None
    structured: str = "json_schema"
    temperature: float = 0.2
    timeout: int = 300
    retries: int = 3
    slots: Slots = field(default_factory=Slots)
    extra: dict = field(default_factory=dict)

    def ask(self, messages: list[dict], schema: dict) -> dict:
        time.sleep(self.slots.wait(time.monotonic()))
        body = R.chat_body(self.model, messages, schema, self.structured, self.temperature, self.extra)
        status, _, reply, failure, _, tried = _tries(_post(f"{self.base_url.rstrip('/')}/chat/completions", body, self.key_env), self.timeout, self.retries, 60.0)
        text = reply.decode("utf-8", "replace")
        if failure or status != 200:
            return {"status": status, "failure": failure, "error": failure or R.snippet(text), "retries": tried}
        try:
            return {"content": R.message_content(text), "usage": R.parse_usage(json.loads(text)), "retries": tried}
        except ValueError as e:
            return {"failure": "invalid_reply", "error": str(e), "retries": tried}


@dataclass
class EmbeddingServer:
    base_url: str
    model: str
    key_env: str | None = None
    timeout: int = 60
    retries: int = 3

    def embed(self, texts: list[str]) -> list[list[float]]:
        request = _post(f"{self.base_url.rstrip('/')}/embeddings", {"model": self.model, "input": texts}, self.key_env)
        status, _, reply, failure, _, _ = _tries(request, self.timeout, self.retries, 60.0)
        if failure or status != 200:
            raise RuntimeError(failure or f"HTTP {status}: {R.snippet(reply.decode('utf-8', 'replace'))}")
        return R.parse_embeddings(json.loads(reply), len(texts))


def _post(url: str, body: dict, key_env: str | None):
    headers = {"Content-Type": "application/json"}
    if key_env and os.environ.get(key_env):
        headers["Authorization"] = f"Bearer {os.environ[key_env]}"
    return urllib.request.Request(url, data=json.dumps(body).encode(), headers=headers)


@dataclass
class WordEmbedder:
    """Hashed bags of words: vectors without a server, the same on every machine."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for word in re.findall(r"\w+", text.lower()):
                v[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % self.size] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out


def model_info(body: dict, name: str) -> dict | None:
    """size, GPU share and context length of a loaded model in a server's list; the tag ``latest`` may be left out."""
    for m in body.get("models") or []:
        if m.get("name") in (name, f"{name}:latest"):
            size = m.get("size") or 0
            return {"size": size, "gpu_share": (m.get("size_vram") or 0) / size if size else None, "context": m.get("context_length")}
    return None


def process_usage() -> dict:
    """CPU seconds and peak memory (bytes) of the driver's Python process."""
    import resource

    u = resource.getrusage(resource.RUSAGE_SELF)
    return {"cpu_seconds": u.ru_utime + u.ru_stime, "peak_bytes": u.ru_maxrss * 1024}


def fetch_pages(pages: DataFrame, fetcher: Fetcher, per_domain: int = 2, lanes: int = 200) -> DataFrame:
    """FETCHED rows of (id, url): a host's pages lie in ``per_domain`` lanes, so that no more of them are asked for at once."""
    lane = F.pmod(F.xxhash64(U.host(F.col("url")), F.pmod(F.col("id"), F.lit(per_domain))), F.lit(lanes))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for id_, url in zip(b.column("id").to_pylist(), b.column("url").to_pylist()):  # a page a batch: pages are large
                got = fetcher.fetch(url)
                yield pa.RecordBatch.from_pydict({"id": pa.array([id_], pa.int64())} | {k: pa.array([got.get(k)], pa.string()) for k in ("final_url", "html", "error_kind", "error")})

    return pages.select("id", "url", lane.alias("lane")).repartition(lanes, "lane").drop("lane").mapInArrow(run, FETCHED)


def summarize_one(chat: Chat, title: str, text: str, vocabulary: str, language: str | None) -> dict:
    """A row of SUMMARIES without its id: one repair round for an unusable reply, then ``invalid_reply``."""
    out = dict.fromkeys(("title", "summary", "language", "tags", "new_tags", "error_kind", "error")) | {"stop": False, "input_tokens": 0, "output_tokens": 0, "requests": 0, "retries": 0, "invalid": 0, "without_usage": 0}
    messages, began = R.summary_messages(title, text, vocabulary, language), time.monotonic()
    for last in (False, True):
        got = chat.ask(messages, R.SCHEMAS["summary"])
        out["requests"] += 1
        out["retries"] += got.get("retries", 0)
        if "content" not in got:
            out["error_kind"], out["error"] = R.page_error(got.get("status"), got.get("failure")), got.get("error")
            out["stop"] = out["error_kind"] is None
            break
        usage = got.get("usage")
        out["without_usage"] += usage is None
        out["input_tokens"] += usage[0] if usage else 0
        out["output_tokens"] += usage[1] if usage else 0
        try:
            out |= R.parse_summary(got["content"])
            break
        except ValueError as e:
            out["invalid"] += 1
            if last:
                out["error_kind"], out["error"] = "invalid_reply", str(e)
            messages = [*messages, {"role": "assistant", "content": got["content"]}, {"role": "user", "content": f"That can't be used ({e}). Reply with the JSON object only."}]
    out["seconds"] = time.monotonic() - began
    return out


def summarize(pages: DataFrame, chat: Chat, language: str | None = "en") -> DataFrame:
    """SUMMARIES rows of (id, title, text, vocabulary)."""
    import pyspark.sql.types as ST
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(ST._parse_datatype_string(SUMMARIES))

    def run(batches):
        for b in batches:
            rows = [{"id": r["id"]} | summarize_one(chat, r["title"] or "", r["text"] or "", r["vocabulary"] or "", language) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select("id", "title", "text", "vocabulary").mapInArrow(run, SUMMARIES)


def embed(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, vector, error) of (id, text), in requests of 64 texts; a failed request loses only its texts."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, EMBED_BATCH):
                part = b.slice(at, EMBED_BATCH)
                try:
                    vectors, error = embedder.embed([t or "" for t in part.column("text").to_pylist()]), None
                except (RuntimeError, ValueError, OSError) as e:
                    vectors, error = [None] * part.num_rows, str(e)
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * part.num_rows, pa.string())], ["id", "vector", "error"])

    return rows.select("id", "text").mapInArrow(run, "id long, vector array<float>, error string")


def tag_text(name, description):
    """Text of a tag's vector: words, and the description if there is one."""
    words = F.replace(name, F.lit("-"), F.lit(" "))
    return F.when(F.coalesce(description, F.lit("")) == "", words).otherwise(F.concat(words, F.lit(": "), description))
