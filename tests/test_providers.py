import json
import sys

import pytest
from pyspark import cloudpickle

from loomtide.functions import replies as R
from loomtide.sources import providers as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fakes below travel to the workers


def test_entities_and_charsets():
    assert R.decode_entities("a &amp;lt; &#65;&#x42; &nope; &#0; &#xD800;") == "a &lt; AB &nope; &#0; &#xD800;"
    assert R.decode_page("é".encode("utf-16")) == "é"
    assert R.decode_page("привет".encode("cp1251"), "text/html; charset=windows-1251") == "привет"
    assert R.decode_page(b"<meta charset='utf-16'>\xc3\xa9") == "<meta charset='utf-16'>é"
    assert R.decode_page(b"<meta charset=iso-8859-1>\xe9") == "<meta charset=iso-8859-1>é"
    assert R.decode_page(b"a\xff") == "a�" and R.decode_page(b"") == ""


def test_errors_and_waits():
    kinds = [R.fetch_error(s, "text/html") for s in (200, 404, 410, 403, 429, 500, None)]
    assert kinds == [None, "not_found", "not_found", "blocked", "blocked", "http_error", "http_error"]
    assert R.fetch_error(200, "application/pdf") == "unsupported_type" and R.fetch_error(200, None) is None and R.fetch_error(failure="dns") == "connection"
    assert [R.backoff(i, most=60) for i in range(7)] == [1, 2, 4, 8, 16, 32, 32] and R.backoff(0, 90) == 30 and R.backoff(6) == 30
    assert R.may_retry(429) and R.may_retry(503) and R.may_retry(failure="timeout") and not R.may_retry(404) and not R.may_retry(failure="dns")
    assert [R.page_error(s) for s in (400, 413, 422, 401, 500)] == ["rejected"] * 3 + [None, None]
    slots = P.Slots(30)
    assert [slots.wait(t) for t in (0.0, 0.0, 1.0, 10.0)] == [0.0, 2.0, 3.0, 0.0]


def test_replies():
    good = R.parse_summary('```json\n{"title": " T ", "summary": "S", "tags": ["a"], "new_tags": [{"path": "b"}], "language": " EN "}\n```')
    assert good == {"title": "T", "summary": "S", "language": "en", "tags": ["a"], "new_tags": [{"name": "b", "description": ""}]}
    for bad in ("no", '{"title": " ", "summary": "s", "tags": []}', '{"title": "t", "summary": "s"}'):
        with pytest.raises(ValueError):
            R.parse_summary(bad)
    assert R.parse_usage({"usage": {"prompt_tokens": 3}}) == (3, 0) and R.parse_usage({"usage": {"completion_tokens": 3}}) is None
    two = R.parse_embeddings({"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}, 2)
    assert two == [[0.6, 0.8], [0.0, 1.0]]
    with pytest.raises(ValueError):
        R.parse_embeddings({"data": []}, 1)
    assert R.chat_body("m", [], {"type": "object"}, "none", extra={"model": "n"})["model"] == "n"
    assert [R.language_mode(x) for x in (" English", "original", "FR")] == ["en", None, "fr"]
    assert P.model_info({"models": [{"name": "m:latest", "size": 10, "size_vram": 5, "context_length": 8}]}, "m") == {"size": 10, "gpu_share": 0.5, "context": 8}


class Scripted:
    """Replies by title: ``bad`` never gives JSON, ``fixed`` does in its second reply."""

    def ask(self, messages, schema):
        text = messages[1]["content"]
        if "Title: down" in text:
            return {"status": 500, "error": "down"}
        if "Title: big" in text:
            return {"status": 413, "error": "big"}
        if "Title: bad" in text or ("Title: fixed" in text and len(messages) == 2):
            return {"content": "sorry", "usage": (5, 1)}
        return {"content": json.dumps({"title": "T", "summary": "S", "tags": ["a"]}), "usage": None if "Title: free" in text else (10, 2)}


def test_summaries(spark):
    titles = ["fine", "fixed", "bad", "big", "down", "free"]
    pages = spark.createDataFrame([(i, t, "text", "") for i, t in enumerate(titles)], "id long, title string, text string, vocabulary string")
    rows = {titles[r["id"]]: r for r in P.summarize(pages, Scripted()).collect()}
    assert {t: r["error_kind"] for t, r in rows.items()} == {"fine": None, "fixed": None, "bad": "invalid_reply", "big": "rejected", "down": None, "free": None}
    assert [t for t, r in rows.items() if r["stop"]] == ["down"]
    assert (rows["fixed"]["requests"], rows["fixed"]["invalid"], rows["fixed"]["input_tokens"]) == (2, 1, 15) and rows["free"]["without_usage"] == 1


class Pages:
    def fetch(self, url):
        return {"error_kind": "not_found", "error": "HTTP 404"} if url.endswith("0") else {"final_url": url, "html": f"<p>{url}</p>"}


class Refusing(P.WordEmbedder):
    def embed(self, texts):
        if "stop" in texts:
            raise RuntimeError("no server")
        return super().embed(texts)


def test_fetch_and_embed(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}") for i in range(30)], "id long, url string")
    got = P.fetch_pages(pages, Pages(), lanes=8).collect()
    assert len(got) == 30 and sorted(r["id"] for r in got if r["error_kind"]) == [0, 10, 20]
    texts = spark.createDataFrame([(i, "stop" if i == 0 else f"word{i} x") for i in range(200)], "id long, text string").coalesce(1)
    out = P.embed(texts, Refusing()).collect()
    assert sum(r["vector"] is None for r in out) == 64 and {r["error"] for r in out} == {None, "no server"}
