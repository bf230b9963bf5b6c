import numpy as np

from loomtide.operators import placement as PL
from loomtide.operators import review as RV
from loomtide.operators.clusters import split_candidates, two_groups
from loomtide.operators.groups import groups
from loomtide.sources.taxonomy import Taxonomy


def test_merge_candidates(spark):
    tags = spark.createDataFrame([(1, "game", 5, False), (2, "games", 9, False), (3, "play", 2, False), (4, "fixed", 1, True)], "id long, name string, pages long, locked boolean")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [1.0, 0.0])], "id long, vector array<double>")
    none = spark.createDataFrame([], "key string")
    rows = [(r["a"], r["b"]) for r in RV.merge_candidates(tags, vectors, none).collect()]
    assert rows == [("games", "game"), ("games", "play"), ("game", "play")]
    assert [(r["a"], r["b"]) for r in RV.merge_candidates(tags, None, none).collect()] == [("games", "game")]
    assert RV.merge_candidates(tags, None, spark.createDataFrame([("merge:game|games",)], "key string")).count() == 0


def test_merge_groups():
    pages = {"a": 1, "b": 3, "c": 2}
    own = {n: n for n in pages}
    ops = lambda *v, **k: [tuple(p.change.values()) for p in RV.merge_groups(pages, list(v), owned=own, **k)]
    assert ops(("a", "b", "b")) == [("merge", "a", "b")]
    assert ops(("a", "b", "new"), ("b", "c", "new")) == [("rename", "b", "new"), ("merge", "c", "new"), ("merge", "a", "new")]
    assert ops(("a", "b", "new"), declined={"rename:b>new"}) == [("merge", "a", "b")]
    assert ops(("a", "b", "c")) == [("merge", "b", "c"), ("merge", "a", "c")]
    assert ops(("a", "b", "c"), locked={"c"}) == [("merge", "a", "b")]
    p = RV.merge_groups(pages, [("a", "b", "b")], owned=own)[0]
    assert p.description == "merge  a → b (1 + 3 pages)" and p.decision_keys == ["merge:a|b"]


def test_replies_and_approval():
    assert RV.read_merges({"decisions": [{"pair": 1, "merge": True, "keep": "B b"}, {"pair": 9, "merge": True}, {"pair": 2, "merge": False}]}, [("a", "b-b"), ("c", "d")]) == ([("a", "b-b", "b-b")], ["merge:c|d"])
    reply = {"split": True, "tags": [{"name": "X"}, {"name": "Y", "description": "y"}, {"name": "Z"}], "assignments": [{"page": 1, "tag": "x"}, {"page": 2, "tag": "y"}, {"page": 2, "tag": "x"}]}
    assert RV.read_split(reply, "t", [10, 20]) == [{"name": "x", "description": None, "pages": [10]}, {"name": "y", "description": "y", "pages": [20]}]
    assert RV.read_split(reply, "t", [10, 20, 30]) is None
    two = [{"name": "p", "pages": [1]}, {"name": "q", "pages": [2, 3]}]
    out = RV.split_proposals([("t", two), ("t", two), ("p", two), ("u", [{"name": "tt", "pages": [1]}, {"name": "v", "pages": [2]}])], [], {"tt": "t"})
    assert [p.description for p in out] == ["split  t → p (1 page), q (2 pages)"]
    assert [RV.parse_choice(x, 3) for x in ("", "N", "2, 3", "4", "x")] == [[0, 1, 2], [], [0], None, None]
    place = lambda path, tag: RV.Proposal({"op": "place", "path": path, "tags": [tag]}, "", [f"place:{tag}>{'/'.join(path)}"])
    apply, declined, held = RV.approve([place([], "a"), place(["a"], "b"), place([], "c")], [1, 2])
    assert [p.change["tags"] for p in apply] == [["c"]] and declined == ["place:a>"] and len(held) == 1
    assert RV.approve([place([], "a")], None) == ([], [], [])

    def ask(batch):
        if ("c", "d") in batch:
            raise RuntimeError("down")
        return {"decisions": [{"pair": 1, "merge": True, "keep": "a"}]}

    assert RV.run_review([("a", "b"), ("c", "d")], ask, 1) == ([("a", "b", "a")], [], ["down"]) and RV.step_failed(1, 0) and not RV.step_failed(1, 2)


def test_two_groups_and_candidates(spark):
    rng = np.random.default_rng(1)
    rows = [("t", i, [float(x) for x in (np.array([1, 0, 0]) if i % 2 else np.array([0, 1, 0])) + rng.normal(0, 0.05, 3)]) for i in range(60)] + [("one", 1, [1.0, 0.0, 0.0]), ("two", 1, [1.0, 0.0, 0.0]), ("two", 2, [1.0, 0.0, 0.0]), ("same", 1, [1.0, 0.0, 0.0]), ("same", 2, [1.0, 0.0, 0.0]), ("same", 3, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "tag string, id long, vector array<double>")
    got = {(r["tag"], r["id"]): (r["part"], r["similarity"]) for r in two_groups(v).collect()}
    assert len(got) == len(rows) and all(got["t", i][0] == i % 2 for i in range(60))
    assert got["one", 1] == (0, None) and got["two", 1][0] == 0 and got["same", 1] == (0, None)
    pages = spark.createDataFrame([("t", 60, False), ("two", 2, False)], "tag string, pages long, locked boolean")
    none = spark.createDataFrame([], "key string, decision string")
    assert split_candidates(v, pages, none, sample=5).count() == 10
    asked = lambda n: spark.createDataFrame([("split:t", f"single-meaning:{n}")], "key string, decision string")
    assert split_candidates(v, pages, asked(30)).count() == 40 and split_candidates(v, pages, asked(31)).count() == 0
    rest = RV.assign_rest(v.where("tag = 't'"), spark.createDataFrame([("t", 0, 0), ("t", 1, 1)], "tag string, id long, part int"))
    assert all(r["part"] == r["id"] % 2 for r in rest.collect()) and rest.count() == 58


def test_long_chains_are_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(900, 901)], "u long, v long")
    assert {r["merge_group"] for r in groups(edges).where("node < 900").collect()} == {0}


def test_placement():
    replies = {"rust": "technology", "chess": "games", "games": "leisure", "odd": "top-level"}
    paths = {"rust": ["technology", "programming languages"], "chess": ["board"]}

    def ask(kind, batch, context):
        if kind == "domains":
            return {"domains": [{"tag": n, "domain": replies[t]} for n, t in enumerate(batch, 1)] + [{"tag": 99, "domain": "x"}]}
        return {"placements": [{"tag": n, "path": paths[t]} for n, t in enumerate(batch, 1) if t in paths]}

    tags = ["rust", "chess", "games", "odd"]
    model = lambda **k: PL.Model(parents={"technology": None}, unplaced=set(tags), **k)
    assert PL.place(tags, model(), ask)[0] == [("games", ["leisure"]), ("rust", ["technology", "programming-languages"]), ("chess", ["leisure", "games"])]
    assert PL.place(tags, model(), ask, max_depth=1)[0] == [(t, []) for t in tags]
    strict = Taxonomy((("technology", None),), True)
    assert PL.place(tags, model(taxonomy=strict), ask)[0] == [("rust", ["technology", "programming-languages"])]
    assert PL.place(tags, model(decided={"place:games>leisure"}), ask)[0] == [("rust", ["technology", "programming-languages"])]
    m = PL.Model(parents={"a": None, "b": "a"}, canonical={"bee": "b"}, locked={"lock"}, unplaced={"lock", "t"})
    assert [m.check("t", w, 3) for w in (["a", "bee"], ["b"], ["a", "t", "b"], ["a", "a"], ["lock"], ["a", "12", "c"], ["n", "m", "o", "p"])] == [["a", "b"], [], ["a"], ["a"], [], ["a"], ["n", "m", "o"]]
    text = PL.describe([("x", ["n"]), ("y", ["n"]), ("z", [])], set())
    assert [d["description"] for d in text] == ["place  (top level) ← z", "place  n ← x, y (new: n)"]
    assert PL.chain(np.array([[1, 0], [0, 1], [0.9, 0.1], [0.1, 0.9]])) == [0, 2, 3, 1]


def test_categories_in_prompts():
    assert PL.shown([]) == "(none yet)" and PL.shown(["a", "b"]) == "a, b" and PL.shown(list("abcd"), 2) == "a, b (and 2 more)"
    seen = []
    model = PL.Model(parents={"zinc": None, "ores": None, "iron": "ores"}, canonical={}, locked={"kiln"}, unplaced={"kiln", "glaze", "clay"}, decided={PL.place_key("clay", [])}, taxonomy=None)
    PL.place(["glaze"], model, lambda kind, batch, context: seen.append((kind, context)) or {})
    assert seen[0] == ("domains", {"categories": ["ores", "zinc"], "blocked": ["clay", "kiln"]})
