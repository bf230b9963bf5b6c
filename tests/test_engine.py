import json
import re
import sys

from pyspark import cloudpickle

from loomtide.plans import engine as E
from loomtide.sources import config as C
from loomtide.sources.providers import WordEmbedder
from loomtide.sources.state import State

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fakes below travel to the workers


class Web:
    def fetch(self, url):
        if "gone" in url:
            return {"error_kind": "not_found", "error": "404"}
        if "paper" in url:
            return {"error_kind": "unsupported_type", "error": "pdf"}
        word = url.rsplit("/", 1)[1]
        return {"final_url": url, "html": f"<head><title>About {word}</title></head><body><nav>menu</nav><article><p>All of {word} here</p></article></body>"}


class Model:
    """Tags a page by the last word of its title; reviews by rules."""

    def ask(self, messages, schema):
        body = messages[1]["content"]
        kind = next(iter(schema["properties"]))
        numbered = [(int(n), t) for n, t in re.findall(r"(?m)^(\d+)\. (.*)$", body)]
        if kind == "title":
            word = re.search(r"Title: About (\S+)", body)[1]
            if word == "down":
                return {"status": 401, "error": "no key"}
            if word.startswith("bad"):
                return {"content": "sorry", "usage": (5, 1)}
            reply = {"title": word, "summary": f"On {word}.", "language": "EN", "tags": [word.rstrip("0123456789")], "new_tags": []}
        elif kind == "decisions":
            reply = {"decisions": [{"pair": n, "merge": "game" in t, "keep": "games"} for n, t in numbered]}
        elif kind == "domains":
            reply = {"domains": [{"tag": n, "domain": "things"} for n, _ in numbered]}
        elif kind == "placements":
            reply = {"placements": [{"tag": n, "path": []} for n, _ in numbered]}
        else:
            reply = {"meanings": [], "split": False, "tags": [], "assignments": []}
        return {"content": json.dumps(reply), "usage": (10, 2)}


def _list(tmp_path, *urls):
    path = tmp_path / "list.txt"
    path.write_text("# a list\n" + "\n".join(urls) + "\n")
    return str(path)


def test_run_review_and_finish(spark, tmp_path):
    path = _list(tmp_path, "http://h/game", "http://h/games", "http://h/chess", "http://h/game", "http://h/gone", "http://h/paper", "http://skip/x", "about:x")
    root, folder = str(tmp_path / "a"), str(tmp_path / "out")
    plan = E.dry_run(spark, root, path, deny=["domain:skip"])
    assert plan["outcomes"] == {"new": 5, "duplicate": 1, "filtered": 1, "not_web": 1} and plan["pages"] == 5 and plan["input_tokens"] > 0
    shown = []
    choose = lambda proposals: shown.append([p.description for p in proposals]) or list(range(len(proposals)))
    out = E.run(spark, root, E.Services(Web(), Model(), WordEmbedder()), C.parse("[run]\nsequential_start = 1"), path=path, folder=folder, deny=["domain:skip"], choose=choose)
    assert out.stop is None and out.used["done"] == 3 and out.used["unread"] == 2 and out.used["input_tokens"] == 30
    s = State(spark, root)
    assert s.status_counts() == {"pending": 0, "done": 3, "failed": 1, "unreachable": 1}
    tags = {r["name"]: r for r in s.table("tags").collect() if not r["name"].startswith("status/")}
    assert set(tags) == {"games", "chess", "things"} and all(t["placed"] for t in tags.values())
    assert tags["chess"]["parent_id"] == tags["things"]["id"] and shown[0] == ["merge  game → games (1 + 1 page)"]
    assert out.used["review"]["applied"] == out.used["review"]["proposed"] and not out.used["review"]["failed"]
    lines = (tmp_path / "out" / "_tags.md").read_text().splitlines()
    assert lines[2:] == ["- things (3 pages, 0 tagged directly)", "  - games (2 pages)", "  - chess (1 page)"]
    assert len(list((tmp_path / "out" / "notes").glob("*.md"))) == 5 and out.lines[-1] == "0 pending, 3 done, 1 failed, 1 unreachable"
    row = E.compare_trees({"a": s}).first()
    assert (row["pages"], row["tags"], row["tags_per_page"], row["average_depth"], row["roots"]) == (3, 2, 1.0, 2.0, 1)
    again = E.run(spark, root, E.Services(Web(), Model()), config=C.parse("[reconcile]\nat_end_of_run = false"), path=path, deny=["domain:skip"])
    assert again.used["outcomes"] == {"known": 5, "duplicate": 1, "filtered": 1, "not_web": 1} and again.used["requests"] == 0


def test_stops_and_budget(spark, tmp_path):
    assert [E.room(*a) for a in ((0, 0, 0, None, 9), (0, 0, 0, 50, 9), (12, 12, 1, 50, 9), (50, 50, 4, 50, 9), (60, 12, 1, 70, 9))] == [9, 1, 4, 0, 1]
    assert E.streak([False] * 3, 2) == (5, True) and E.streak([False] * 4 + [True, False]) == (1, False)
    services, config = E.Services(Web(), Model()), C.parse("[reconcile]\nat_end_of_run = false\n[run]\nsequential_start = 0")
    path = _list(tmp_path, *(f"http://h/ok{i}" for i in range(6)))
    out = E.run(spark, str(tmp_path / "b"), services, config, path, max_tokens=30)
    assert out.stop == "the token limit was reached" and out.used["done"] == 3
    out = E.run(spark, str(tmp_path / "c"), services, config, _list(tmp_path, "http://h/one", "http://h/down"))
    assert out.stop == "no key" and State(spark, str(tmp_path / "c")).status_counts()["pending"] == 1
    out = E.run(spark, str(tmp_path / "d"), services, config, _list(tmp_path, *(f"http://h/bad{i}" for i in range(6)), "http://h/ok"), step=6)
    assert out.stop == "5 pages in a row failed" and State(spark, str(tmp_path / "d")).status_counts()["failed"] == 6
