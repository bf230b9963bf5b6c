import pytest
from pyspark.sql import functions as F

from loomtide.sources import config, lists, taxonomy
from loomtide.sources.state import SchemaError, State, insert_or_ignore, upsert


def test_config_rejects_what_it_does_not_know():
    assert config.parse("").tags.max_per_page == 5
    assert config.parse("[reconcile]\nmodel = 'big'").review_model().model == "big"
    assert config.parse("[llm]\nbase_url = 'https://example.org/v1'").prices() is None
    for bad in ("x = 1", "[llm]\ntimeout_secs = 0", "[tags]\nstyle = 'q'", "[run]\nconcurrency = true", "[filter]\nmode = 'allow'", "[reconcile]\nsplit_min_pages = 1"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_taxonomy():
    t = taxonomy.parse('strict = true\ncategories = ["Home Life", {name = "art", description = " pictures "}, "art"]')
    assert t.categories == (("home-life", None), ("art", "pictures")) and t.allows("art") and not t.allows("cars")
    for bad in ("categories = []", 'categories = ["12"]', "other = 1"):
        with pytest.raises(ValueError):
            taxonomy.parse(bad)


def test_list_outcomes(spark):
    lines = ["# head", "", " http://A.org/x  A title ", "http://a.org/x#part", "about:blank", "nonsense", "http://skip.org/", "http://skip.org/", "http://old.org/"]
    rows = lists.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    archive = spark.createDataFrame([("http://old.org/", "done")], "url string, status string")
    out = {r["line_no"]: (r["outcome"], r["title"]) for r in lists.classify(rows, archive, deny=["domain:skip.org"]).collect()}
    assert out == {2: ("new", "A title"), 3: ("duplicate", None), 4: ("not_web", None), 5: ("invalid", None), 6: ("filtered", None), 7: ("duplicate", None), 8: ("known", None)}


def test_state_versions(spark, tmp_path):
    root = str(tmp_path / "archive")
    with pytest.raises(SchemaError):
        State(spark, root, read_only=True)
    s = State(spark, root)
    rows = spark.createDataFrame([(i, f"http://h/{i % 7}", f"h/{i}", None) for i in range(20)], "line_no long, url string, original_url string, title string")
    assert s.add_pages(rows) == 7 and s.add_pages(rows) == 0
    assert [(r["id"], r["url"]) for r in s.pending().collect()] == [(i + 1, f"http://h/{i}") for i in range(7)]
    pinned = State(spark, root, read_only=True)
    s.commit(pages=s.table("pages").withColumn("status", F.when(F.col("id") > 4, "failed").otherwise("done")).withColumn("error_kind", F.lit("timeout")))
    assert s.status_counts() == {"pending": 0, "done": 4, "failed": 3, "unreachable": 0} and pinned.status_counts()["pending"] == 7
    assert s.failed_pages().count() == 3
    s.retry_failed()
    assert State(spark, root).status_counts() == {"pending": 3, "done": 4, "failed": 0, "unreachable": 0}
    with pytest.raises(PermissionError):
        pinned.commit()
    other = State(spark, root)
    s.commit(batch="b1")
    with pytest.raises(RuntimeError):
        other.commit()
    before = s.manifest["version"]
    s.commit(batch="b1")
    assert s.manifest["version"] == before


def test_old_schema_is_upgraded(spark, tmp_path):
    s = State(spark, str(tmp_path / "a"))
    tags = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", None)], "id long, name string, parent_id long")
    tags = tags.withColumns({"description": F.lit(None).cast("string"), "locked": F.lit(False), "created_at": F.current_timestamp(), "placed": F.lit(False)})
    s.commit(tags=tags, schema=5)
    found = State(spark, s.root, read_only=True)
    assert found.manifest["schema"] == 5
    assert {r["name"]: r["placed"] for r in State(spark, s.root).table("tags").collect()} == {"a": True, "b": True, "c": False}
    t = State(spark, s.root)
    t.commit(schema=9)
    with pytest.raises(SchemaError):
        State(spark, s.root)


def test_row_writes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v long")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, insert_or_ignore(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]
