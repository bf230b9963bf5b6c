import datetime
import json

from pyspark.sql import functions as F

from loomtide.operators.hierarchy import count_tree
from loomtide.plans import report as RP
from loomtide.plans.engine import write_index
from loomtide.sinks import notes as N
from loomtide.sources.state import State


def make(spark, tmp_path):
    s = State(spark, str(tmp_path / "a"))
    pages = spark.createDataFrame([(1, "http://h/1", "done", "Same", "S1", None), (2, "http://h/2", "done", "Same", "S2", None), (3, "http://www.g/3", "unreachable", "Gone", None, "not_found"), (4, "http://h/4", "pending", None, None, None), (5, "http://h/5", "done", "Same", "S5", None)], "id long, url string, status string, title string, summary string, error_kind string")
    pages = pages.withColumns({c: F.lit(None).cast("string") for c in ("original_url", "browser_title", "error", "lang", "page_title")} | {"note_file": F.when(F.col("id") == 2, "same-2.md"), "source": F.lit("list"), "added_at": F.lit("2024-01-02 03:04:05").cast("timestamp"), "processed_at": F.lit(None).cast("timestamp")})
    tags = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id long, name string, parent_id long").withColumns({"description": F.lit(None).cast("string"), "locked": F.lit(False), "placed": F.lit(True), "created_at": F.current_timestamp()})
    s.commit(pages=pages, tags=tags, page_tags=spark.createDataFrame([(1, "A", 1), (1, "b", 2), (2, "b", 2)], "page_id long, raw_tag string, resolved_tag_id long"))
    return s


def test_notes(spark, tmp_path):
    s, folder = make(spark, tmp_path), tmp_path / "notes"
    folder.mkdir()
    (folder / "gone.md").write_text("mine")
    out = {r["note_file"]: r["written"] for r in N.render(s, str(folder)).collect()}
    assert out == {"same.md": True, "same-2.md": True, "same-3.md": True, "gone.md": False} and (folder / "gone.md").read_text() == "mine"
    text = (folder / "same.md").read_text()
    assert text == '---\nloomtide: note\nurl: "http://h/1"\ntitle: "Same"\nsource: "list"\ncaptured: "2024-01-02T03:04:05Z"\ntags:\n  - "a"\n  - "b"\n---\n\n# Same\n\n**URL:** <http://h/1>\n\nS1\n\n#a #b\n'
    N.render(s, str(folder)).collect()
    assert sorted(p.name for p in folder.iterdir()) == ["gone.md", "same-2.md", "same-3.md", "same.md"]
    tree = count_tree(s.table("tags"), s.links())
    assert [r["line"] for r in N.tag_lines(tree).collect()] == ["- a (2 pages, 1 tagged directly)", "  - b (2 pages)"]
    assert [r["line"] for r in N.tag_table(tree).collect()] == ["TAG   PAGES  DIRECT", "a         2       1", "  b       2       2"]
    assert [r["line"] for r in N.tag_table(tree.where("false")).collect()] == ["No tags yet."]


def test_names_around_taken_ones(spark):
    pages = spark.createDataFrame([(i, None, "T", None) for i in range(1, 5)], "id long, page_title string, title string, note_file string")
    taken = spark.createDataFrame([("t.md",), ("t-3.md",), ("t-4.md",), (None,)], "note_file string")
    assert [r["note_file"] for r in N.name_notes(pages, taken).orderBy("id").collect()] == ["t-2.md", "t-5.md", "t-6.md", "t-7.md"]
    clash = spark.createDataFrame([(1, None, "A", None), (2, None, "A", None), (3, None, "A 2", None)], "id long, page_title string, title string, note_file string")
    assert [r["note_file"] for r in N.name_notes(clash, taken).orderBy("id").collect()] == ["a.md", "a-2.md", "a-2-2.md"]


def test_report(spark, tmp_path):
    s = make(spark, tmp_path)
    r = RP.build(s, {"seconds": 3725, "done": 10, "requests": 10, "input_tokens": 12_345, "output_tokens": 20_000, "pages_cut": 3})
    assert r["archive"] == {"pending": 1, "done": 3, "failed": 0, "unreachable": 1} and r["domains"] == {"h": 4, "g": 1}
    assert r["tags"] == {"in_use": 2, "used_once": 1, "new": 0, "untagged": 1} and len(r["warnings"]) == 2
    text = RP.text(r)
    assert "Run of 1h 2m" in text and "unreachable            1   1 not found" in text and "12.3k in, 20.0k out" in text
    now = datetime.datetime(2024, 1, 1)
    assert RP.save(s, r, now, now) == 1 and RP.save(s, {"run": {}}, now, now) == 2 and json.loads(s.latest_report()) == {"run": {}}
    assert "- <http://www.g/3>: not found" in "".join(RP.markdown(r, [tuple(x)[:1] + (x["error_kind"], x["error"]) for x in s.failed_pages().collect()]))
    assert RP.estimate(None) == (2750.0, 250.0) and RP.estimate(r) == (1234.5, 2000.0)
    assert RP.cost({"input_tokens": 1_000_000}, (2.0, 3.0)) == 2.0 and RP.cost({}, None) is None


def test_index_lines(spark):
    rows = [(1, "Untagged", "z", "z.md"), (2, "b", "B [x]", "b x.md"), (3, "b", "a", "a.md"), (4, "z", "c", "c.md")]
    out = N.index_lines(spark.createDataFrame(rows, "id long, section string, title string, note_file string")).collect()
    assert [(r["section"], r["line"]) for r in out] == [("b", "- [a](notes/a.md)"), ("b", "- [B \\[x\\]](notes/b%20x.md)"), ("z", "- [c](notes/c.md)"), ("Untagged", "- [z](notes/z.md)")]


def test_index_file(spark, tmp_path):
    s = State(spark, str(tmp_path / "a"))
    s.add_pages(spark.createDataFrame([(k, f"http://h/{k}", f"http://h/{k}", f"Title {k}") for k in (3, 1, 2)], "line_no long, url string, original_url string, title string"))
    pages = s.table("pages").withColumn("status", F.lit("done")).withColumn("note_file", F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md"))).withColumn("title", F.col("browser_title"))
    tags = spark.createDataFrame([(1, "games"), (2, "chess")], "id long, name string").selectExpr("id", "name", "if(id = 2, 1L, null) AS parent_id", "cast(null AS string) AS description", "false AS locked", "current_timestamp() AS created_at", "true AS placed")
    s.commit(pages=pages, tags=tags, page_tags=spark.createDataFrame([(1, "chess", 2), (2, "games", 1)], "page_id long, raw_tag string, resolved_tag_id long"))
    with open(write_index(s, str(tmp_path / "out"))) as f:
        assert f.read() == "# Index\n\n## games\n\n- [Title 1](notes/n1.md)\n- [Title 2](notes/n2.md)\n\n## Untagged\n\n- [Title 3](notes/n3.md)\n"
