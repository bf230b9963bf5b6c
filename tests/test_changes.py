import pytest
from pyspark.sql import functions as F

from loomtide.operators.changes import apply_changes, undo_last
from loomtide.sources.state import State

TAGS = "id long, name string, parent_id long, placed boolean, locked boolean"


@pytest.fixture
def state(spark, tmp_path):
    s = State(spark, str(tmp_path / "a"))
    tags = spark.createDataFrame([(1, "game", None, True, False), (2, "games", None, False, False), (3, "chess", 1, True, False), (4, "rust", None, False, False), (5, "fixed", None, False, True)], TAGS)
    links = spark.createDataFrame([(1, "Game", 1), (2, "games", 2), (3, "gaming", 1), (1, "rust", 4), (2, "rust", 4), (3, "Rust", 4)], "page_id long, raw_tag string, resolved_tag_id long")
    aliases = spark.createDataFrame([("gaming", 1, "rule", False)], "alias string, tag_id long, source string, locked boolean")
    extra = {"description": F.lit(None).cast("string"), "created_at": F.current_timestamp()}
    s.commit(tags=tags.withColumns(extra), page_tags=links, tag_aliases=aliases.withColumn("created_at", F.current_timestamp()), next_id={"tags": 6})
    return s


def view(s):
    names = {r["id"]: r for r in s.table("tags").collect()}
    tags = {r["name"]: (r["parent_id"] and names[r["parent_id"]]["name"], r["placed"]) for r in names.values()}
    links = sorted((r["page_id"], r["raw_tag"], names[r["resolved_tag_id"]]["name"]) for r in s.table("page_tags").collect())
    return tags, links, sorted((r["alias"], names[r["tag_id"]]["name"]) for r in s.table("tag_aliases").collect())


def test_merge_and_undo(state):
    before = view(state)
    assert apply_changes(state, [{"op": "merge", "from": "game", "into": "games"}, {"op": "merge", "from": "nope", "into": "games"}], ["merge:game|games"]) == [(1, "there is no tag nope")]
    tags, links, aliases = view(state)
    assert "game" not in tags and tags["games"] == (None, True) and tags["chess"] == ("games", True)
    assert aliases == [("game", "games"), ("gaming", "games")] and (1, "Game", "games") in links
    assert undo_last(state) and view(state) == before
    assert [(r["key"], r["decision"]) for r in state.table("tag_decisions").collect()] == [("merge:game|games", "declined")]
    assert not undo_last(state)


def test_chain_rename_split_and_undo(state):
    before = view(state)
    changes = [
        {"op": "merge", "from": "game", "into": "games"},
        {"op": "rename", "tag": "games", "name": "play"},
        {"op": "split", "tag": "rust", "parts": [{"name": "rust-lang", "description": "d", "pages": [1, 2]}, {"name": "game", "pages": [3]}]},
    ]
    assert apply_changes(state, changes) == []
    tags, links, aliases = view(state)
    assert set(tags) == {"play", "chess", "rust-lang", "fixed"}
    assert links == [(1, "Game", "play"), (1, "rust", "rust-lang"), (2, "games", "play"), (2, "rust", "rust-lang"), (3, "Rust", "play"), (3, "gaming", "play")]
    assert undo_last(state) and view(state) == before


def test_failing_changes_leave_nothing(state):
    before = view(state)
    bad = [
        {"op": "split", "tag": "rust", "parts": [{"name": "a", "pages": [1]}, {"name": "b", "pages": [2]}]},
        {"op": "rename", "tag": "rust", "name": "games"},
        {"op": "place", "path": ["chess"], "tags": ["chess"]},
        {"op": "place", "path": [], "tags": ["fixed"]},
        {"op": "place", "path": ["board"], "tags": ["chess"]},
        {"op": "merge", "from": "rust", "into": "rust"},
    ]
    assert [n for n, _ in apply_changes(state, bad)] == list(range(6)) and view(state) == before


def test_place_and_later_pages(state, spark):
    assert apply_changes(state, [{"op": "place", "path": ["technology", "code"], "tags": ["rust"]}]) == []
    assert view(state)[0]["rust"] == ("code", True)
    code = state.table("tags").where("name = 'code'").first()["id"]
    later = spark.createDataFrame([(9, "code", code)], "page_id long, raw_tag string, resolved_tag_id long")
    state.commit(page_tags=state.table("page_tags").unionByName(later))
    assert undo_last(state)
    tags, links, _ = view(state)
    assert tags["rust"] == (None, False) and "technology" not in tags and tags["code"] == (None, False) and (9, "code", "code") in links


def test_later_pages_of_a_part_return(state, spark):
    apply_changes(state, [{"op": "split", "tag": "rust", "parts": [{"name": "rust-lang", "pages": [1, 2]}, {"name": "corrosion", "pages": [3]}]}])
    new = state.table("tags").where("name = 'corrosion'").first()["id"]
    state.commit(page_tags=state.table("page_tags").unionByName(spark.createDataFrame([(8, "decay", new)], "page_id long, raw_tag string, resolved_tag_id long")))
    assert undo_last(state)
    tags, links, _ = view(state)
    assert {"corrosion", "rust-lang"}.isdisjoint(tags) and (8, "decay", "rust") in links
