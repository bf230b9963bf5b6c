import json

from loomtide.operators.resolution import resolve
from loomtide.sources.state import State
from loomtide.streaming.ingest import ingest_results, ingest_urls, stubbed


def test_fold_limits_and_spellings():
    known = [{"name": "board-games", "id": 1, "rank": 0}, {"name": "ml", "id": 2, "rank": 1}, {"name": "boardgames", "id": 1, "rank": 2}]
    page = lambda i, tags, new=(): {"id": i, "title": f"t{i}", "tags": tags, "new_tags": list(new)}
    got = resolve([page(1, ["boardgames", "Board Games", "ML", "x", "status/done", "12", "y", "z"], [{"name": "X", "description": " about x "}]), page(2, ["z", "q"]), page(3, [])], known, 10, 4, 1)
    assert got.links == [(1, "boardgames", 1), (1, "ML", 2), (1, "x", 10), (2, "z", 11)]
    assert got.tags == [(10, "x", "about x"), (11, "z", "first used for: t2")] and got.aliases == [("boardgames", 1)] and got.next_id == 12


def _drop(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_stream_resumes(spark, tmp_path):
    urls, results, root = tmp_path / "urls", tmp_path / "results", str(tmp_path / "a")
    urls.mkdir(), results.mkdir()
    _drop(urls, "1.json", [{"url": f"http://h/{i}#x"} for i in (1, 2, 2, 3)] + [{"url": "about:blank"}, {"url": None}])
    ingest_urls(spark, str(urls), root, str(tmp_path / "c1"))
    _drop(urls, "2.json", [{"url": "http://h/3"}, {"url": "http://h/4"}])
    ingest_urls(spark, str(urls), root, str(tmp_path / "c1"))
    assert State(spark, root).status_counts()["pending"] == 4
    _drop(results, "1.json", [{"url": "http://h/1", "status": "done", "title": "A", "summary": "s", "lang": " EN ", "tags": ["Chess", "unknown thing"]}, {"url": "http://h/2", "status": "unreachable", "error_kind": "timeout", "title": "B"}])
    ingest_results(spark, str(results), root, str(tmp_path / "c2"))
    _drop(results, "2.json", [{"url": "http://h/3", "status": "done", "title": "C", "summary": "s", "tags": ["chess", "un-known-thing"]}, {"url": "http://other/", "status": "done"}])
    ingest_results(spark, str(results), root, str(tmp_path / "c2"))
    ingest_results(spark, str(results), root, str(tmp_path / "c3"))  # a lost checkpoint: the same batches again
    s = State(spark, root)
    names = {r["id"]: r["name"] for r in s.table("tags").collect()}
    urls_by_id = {r["id"]: r["url"] for r in s.table("pages").collect()}
    assert sorted((urls_by_id[r["page_id"]][-1], names[r["resolved_tag_id"]]) for r in s.table("page_tags").collect()) == [("1", "chess"), ("1", "unknown-thing"), ("2", "status/unreachable"), ("3", "chess"), ("3", "unknown-thing")]
    assert [(r["alias"], names[r["tag_id"]]) for r in s.table("tag_aliases").collect()] == [("un-known-thing", "unknown-thing")]
    assert s.status_counts() == {"pending": 1, "done": 2, "failed": 0, "unreachable": 1}


def test_other_batches_after_a_lost_checkpoint(spark, tmp_path):
    """Files are taken once, however they are dealt into batches: none is lost and none is applied again."""
    results, root = tmp_path / "results", str(tmp_path / "a")
    results.mkdir()
    state = State(spark, root)
    state.add_pages(spark.createDataFrame([(k, f"http://h/{k}", f"http://h/{k}", None) for k in range(6)], "line_no long, url string, original_url string, title string"))
    row = lambda k, title: {"url": f"http://h/{k}", "status": "done", "title": title, "summary": "s", "tags": [f"tag {k}"]}
    for k in range(3):
        _drop(results, f"{k}.json", [row(k, "old")])
    ingest_results(spark, str(results), root, str(tmp_path / "c1"), files=1)
    found = State(spark, root)
    assert found.status_counts()["done"] == 3 and found.table("files").count() == 3
    version = found.manifest["version"]
    for k in range(3, 6):
        _drop(results, f"{k}.json", [row(k, "new"), row(0, "again")])
    ingest_results(spark, str(results), root, str(tmp_path / "c2"), files=4)  # batch 0 now holds other files
    found = State(spark, root)
    assert found.status_counts()["done"] == 6 and found.table("files").count() == 6
    ingest_results(spark, str(results), root, str(tmp_path / "c3"), files=2)
    assert State(spark, root).manifest["version"] == found.manifest["version"] == version + 2


def test_old_batch_names_are_not_forgotten(spark, tmp_path):
    state = State(spark, str(tmp_path / "b"))
    state.commit(batch="first")
    state.commit(batches=state.table("batches").unionByName(spark.range(1001).selectExpr("concat('b', id) AS name")))
    state.commit(batch="later", next_id={"tags": 7})
    state.commit(batch="first", next_id={"tags": 9})
    state.commit(batch="b500", next_id={"tags": 9})
    assert state.next_id("tags") == 7


def test_pages_without_content_get_a_title_and_a_cause(spark):
    rows = [
        ("http://a/b", " Saved ", "Own", "unreachable", "HTTP 500", "http_error", None, None),
        ("http://a/b", " ", "Own", "failed", None, "invalid_reply", "t", "s"),
        ("http://a/b?c", None, None, "failed", "", None, None, None),
        ("http://a/b", "Saved", "Own", "done", None, None, "t", "s"),
    ]
    df = spark.createDataFrame(rows, "url string, browser_title string, page_title string, status string, error string, error_kind string, title string, summary string")
    assert [tuple(r) for r in stubbed(df).select("title", "page_title", "summary").collect()] == [
        ("Saved", "Saved", "No summary: this page couldn't be loaded (HTTP 500). The title was saved with the link."),
        ("Own", "Own", "No summary: this page couldn't be summarized (invalid reply). The title is the page's own."),
        ("a/b?c", None, "No summary: this page couldn't be summarized (cause unknown). The title is its address."),
        ("t", "Own", "s"),
    ]
