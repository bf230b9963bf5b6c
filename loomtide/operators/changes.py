"""Reversible changes of tags: merge, rename, split, place, and their undo.

A change is a dict with ``op``: ``merge`` (from, into), ``rename`` (tag, name),
``split`` (tag, parts of name, description, pages) or ``place`` (path, tags);
tags are named by their names.  The tag and alias tables are edited on the
driver behind a size check; the rows of page_tags never leave the cluster: their
moves are composed into mappings, each one a join, and the moved rows are kept
in ``moves`` so that undo can return just those that are still where they went.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.functions.names import normalize_name
from loomtide.operators.shared import bounded, collect_bounded, cut
from loomtide.sources.state import State, upsert

MAX_DEPTH = 64


class ChangeError(ValueError):
    """A change that can't be made; the others of its revision still are."""


@dataclass
class Editor:
    state: State
    tags: dict = field(default_factory=dict)
    aliases: dict = field(default_factory=dict)
    steps: list = field(default_factory=list)
    segments: list = field(default_factory=list)  # ("map", {from: to}) or ("assign", frame of page_id, at, to)
    links: DataFrame | None = None
    next_id: int = 1

    def __post_init__(self):
        s = self.state
        self.tags = {r["id"]: r.asDict() for r in collect_bounded(s.table("tags"), "tags")}
        self.aliases = {r["alias"]: r.asDict() for r in collect_bounded(s.table("tag_aliases"), "aliases")}
        self.next_id = max([s.next_id("tags"), *(i + 1 for i in self.tags)])
        self.links = s.table("page_tags").select("page_id", "raw_tag", F.col("resolved_tag_id").alias("at"), F.array().cast("array<struct<step:bigint,from:bigint,to:bigint>>").alias("log"))
        self._by_name = {t["name"]: i for i, t in self.tags.items()}

    # Lookups.

    def named(self, name: str) -> int:
        if name not in self._by_name:
            raise ChangeError(f"there is no tag {name}")
        return self._by_name[name]

    def owner(self, name: str) -> int | None:
        """The tag of a name; a tag's own name comes before aliases."""
        found = self._by_name.get(name)
        return found if found is not None else self.aliases[name]["tag_id"] if name in self.aliases else None

    def above(self, id_: int | None) -> list[int]:
        out = []
        while id_ is not None:
            out.append(id_)
            if len(out) > MAX_DEPTH:
                raise ChangeError("the tag tree has a cycle")
            id_ = self.tags[id_]["parent_id"] if id_ in self.tags else None
        return out

    def children(self, id_: int) -> list[int]:
        return sorted(i for i, t in self.tags.items() if t["parent_id"] == id_)

    # Single steps; each records what undoes it.

    def _set(self, id_: int, **values) -> None:
        old = self.tags[id_]
        self._by_name.pop(old["name"], None)
        self.tags[id_] = old | values
        self._by_name[self.tags[id_]["name"]] = id_

    def move(self, id_: int, parent: int | None, placed: bool = True) -> None:
        t = self.tags[id_]
        if (t["parent_id"], t["placed"]) == (parent, placed):
            return
        if parent is not None and id_ in self.above(parent):
            raise ChangeError(f"{t['name']} can't stand under itself")
        self.steps.append({"step": "moved", "id": id_, "parent": t["parent_id"], "placed": t["placed"]})
        self._set(id_, parent_id=parent, placed=placed)

    def create(self, name: str, description: str | None, fallback: int | None, parent: int | None = None, placed: bool = False) -> int:
        if name in self._by_name:
            raise ChangeError(f"the name {name} is taken")
        id_, self.next_id = self.next_id, self.next_id + 1
        self.tags[id_] = {"id": id_, "name": name, "parent_id": parent, "description": description, "locked": False, "created_at": None, "placed": placed}
        self._by_name[name] = id_
        self.steps.append({"step": "tag_created", "id": id_, "fallback": fallback})
        return id_

    def retarget(self, old: int, new: int) -> None:
        n = len(self.steps)
        self.steps.append({"step": "retargeted", "n": n, "from": old, "to": new})
        self.segments.append(("map", n, old, new))

    def add_alias(self, alias: str, id_: int, source: str = "llm") -> None:
        if alias in self.aliases or alias in self._by_name:
            return
        self.aliases[alias] = {"alias": alias, "tag_id": id_, "source": source, "locked": False, "created_at": None}
        self.steps.append({"step": "alias_added", "alias": alias})

    def delete_aliases(self, names: list[str]) -> None:
        rows = [self.aliases.pop(a) for a in sorted(names)]
        if rows:
            self.steps.append({"step": "aliases_deleted", "rows": [_plain(r) for r in rows]})

    def move_aliases(self, old: int, new: int) -> None:
        names = sorted(a for a, r in self.aliases.items() if r["tag_id"] == old)
        for a in names:
            self.aliases[a] = self.aliases[a] | {"tag_id": new}
        if names:
            self.steps.append({"step": "aliases_moved", "aliases": names, "from": old})

    def delete(self, id_: int) -> None:
        """Removes a tag; its children move up one level."""
        for child in self.children(id_):
            self.move(child, self.tags[id_]["parent_id"], self.tags[child]["placed"])
        row = self.tags.pop(id_)
        self._by_name.pop(row["name"], None)
        self.steps.append({"step": "tag_deleted", "row": _plain(row)})

    # Changes.

    def merge(self, old: str, new: str) -> None:
        a, b = self.named(old), self.named(new)
        if a == b:
            raise ChangeError(f"{old} can't be merged into itself")
        if self.tags[a]["placed"] and (not self.tags[b]["placed"] or a in self.above(b)):
            self.move(b, self.tags[a]["parent_id"])
        for child in self.children(a):
            if child != b:
                self.move(child, b, self.tags[child]["placed"])
        self.retarget(a, b)
        self.move_aliases(a, b)
        self.delete(a)
        self.add_alias(old, b)

    def rename(self, tag: str, name: str) -> None:
        id_ = self.named(tag)
        if self.owner(name) not in (None, id_) or name == tag:
            raise ChangeError(f"the name {name} is taken")
        if name in self.aliases:
            self.delete_aliases([name])
        self.steps.append({"step": "renamed", "id": id_, "name": tag})
        self._set(id_, name=name)
        self.add_alias(tag, id_)

    def split(self, tag: str, parts: list[dict]) -> None:
        id_ = self.named(tag)
        spark = self.state.spark
        pages = [(int(p), n) for n, part in enumerate(parts) for p in part["pages"]]
        given = spark.createDataFrame(pages or [(0, 0)], "page_id long, part int").where(F.lit(bool(pages)))
        open_pages = self.current().where(F.col("at") == id_).join(bounded(given), "page_id", "left_anti")
        if not open_pages.isEmpty():
            raise ChangeError(f"a page of {tag} is in no part")
        targets = []
        for part in parts:
            name = part["name"]
            found = id_ if name == tag else self._by_name.get(name)
            if found is None and name in self.aliases:
                if self.aliases[name]["tag_id"] == id_:
                    self.delete_aliases([name])
                else:
                    found = self.aliases[name]["tag_id"]
            targets.append(self.create(name, part.get("description"), id_) if found is None else found)
        where = spark.createDataFrame(list(enumerate(targets)), "part int, to long")
        n = len(self.steps)
        assigned = given.join(F.broadcast(where), "part").groupBy("page_id").agg(F.min("to").alias("to"))
        self.segments.append(("assign", n, id_, assigned))
        self.steps.append({"step": "retargeted", "n": n, "from": id_, "to": None})
        if id_ not in targets:
            self.delete_aliases([a for a, r in self.aliases.items() if r["tag_id"] == id_])
            self.delete(id_)

    def place(self, path: list[str], tags: list[str]) -> None:
        under = None
        for name in path:
            found = self.owner(name)
            if found is None:
                under = self.create(name, None, None, under, True)
                continue
            t = self.tags[found]
            if t["name"] in tags:
                raise ChangeError(f"{name} can't stand under itself")
            if t["placed"] and t["parent_id"] != under:
                raise ChangeError(f"{name} stands elsewhere")
            if not t["placed"] and t["locked"]:
                raise ChangeError(f"{name} is locked outside the tree")
            self.move(found, under)
            under = found
        for name in tags:
            id_ = self.named(name)
            t = self.tags[id_]
            if t["placed"] and t["parent_id"] != under:
                raise ChangeError(f"{name} stands elsewhere")
            if not t["placed"] and t["locked"]:
                raise ChangeError(f"{name} is locked outside the tree")
            self.move(id_, under)

    def apply(self, change: dict) -> None:
        """One change, as a whole or not at all."""
        saved = dict(self.tags), dict(self.aliases), len(self.steps), len(self.segments), self.next_id, dict(self._by_name)
        try:
            if change["op"] == "merge":
                self.merge(change["from"], change["into"])
            elif change["op"] == "rename":
                self.rename(change["tag"], change["name"])
            elif change["op"] == "split":
                self.split(change["tag"], change["parts"])
            elif change["op"] == "place":
                self.place(change["path"], change["tags"])
            else:
                raise ChangeError(f"unknown change {change['op']}")
        except ChangeError:
            self.tags, self.aliases, steps, segments, _, self._by_name = saved
            del self.steps[steps:], self.segments[segments:]
            raise

    # The rows of page_tags.

    def current(self) -> DataFrame:
        """page_tags (page_id, raw_tag, at, log) after the changes so far; neighbouring mappings become one join."""
        out, run, spark = self.links, [], self.state.spark

        def mapped(df):
            paths: dict[int, list] = {}
            for n, old, new in run:
                for start in {old, *(k for k, p in paths.items() if p[-1][2] == old)}:
                    if not (start == old and start in paths):
                        paths.setdefault(start, []).append((n, old, new))
            table = spark.createDataFrame([(k, p, p[-1][2]) for k, p in paths.items()], "at long, path array<struct<step:bigint,from:bigint,to:bigint>>, to long")
            return df.join(bounded(table), "at", "left").select("page_id", "raw_tag", F.coalesce("to", "at").alias("at"), F.when(F.col("path").isNull(), F.col("log")).otherwise(F.concat("log", "path")).alias("log"))

        for kind, n, old, target in self.segments:
            if kind == "map":
                run.append((n, old, target))
                continue
            out, run[:] = mapped(out) if run else out, []
            to = target.select("page_id", "to", F.lit(old).cast("long").alias("at"))
            moved = F.col("to").isNotNull() & (F.col("to") != F.col("at"))
            entry = F.array(F.struct(F.lit(n).cast("long").alias("step"), F.col("at").alias("from"), F.col("to")))
            out = out.join(bounded(to), ["page_id", "at"], "left").select("page_id", "raw_tag", F.coalesce("to", "at").alias("at"), F.when(moved, F.concat("log", entry)).otherwise(F.col("log")).alias("log"))
        return mapped(out) if run else out

    def tables(self, vectors_gone: set[int]) -> dict[str, DataFrame]:
        s, spark = self.state, self.state.spark
        now = F.current_timestamp()
        tags = spark.createDataFrame(list(self.tags.values()), "id long, name string, parent_id long, description string, locked boolean, created_at timestamp, placed boolean")
        aliases = spark.createDataFrame(list(self.aliases.values()), "alias string, tag_id long, source string, locked boolean, created_at timestamp")
        gone = spark.createDataFrame([("tag", i) for i in sorted(vectors_gone)], "kind string, ref_id long")
        return {
            "tags": tags.withColumn("created_at", F.coalesce("created_at", now)),
            "tag_aliases": aliases.withColumn("created_at", F.coalesce("created_at", now)),
            "embeddings": s.table("embeddings").join(bounded(gone), ["kind", "ref_id"], "left_anti"),
        }


def _plain(row: dict) -> dict:
    return {k: v for k, v in row.items() if k != "created_at"}


def _vectors_gone(steps: list[dict]) -> set[int]:
    return {s["row"]["id"] for s in steps if s["step"] == "tag_deleted"} | {s["id"] for s in steps if s["step"] == "renamed"}


def _decisions(state: State, keys: list[str], decision: str, source: str) -> DataFrame:
    new = state.spark.createDataFrame([(k, decision, source) for k in sorted(set(keys))], "key string, decision string, source string")
    return upsert(state.table("tag_decisions"), new.withColumn("created_at", F.current_timestamp()), ["key"])


def remember(state: State, keys: list[str], decision: str, source: str = "llm") -> None:
    state.commit(tag_decisions=_decisions(state, keys, decision, source))


def apply_changes(state: State, changes: list[dict], decision_keys: list[str] = ()) -> list[tuple[int, str]]:
    """Applies changes as one revision; (index, reason) of those that failed.  Nothing is written if none succeeds."""
    editor, failed = Editor(state), []
    for n, change in enumerate(changes):
        try:
            editor.apply(change)
        except ChangeError as e:
            failed.append((n, str(e)))
    if not editor.steps:
        return failed
    spark, number = state.spark, state.next_id("revisions")
    rows = cut(editor.current())
    done = [c for n, c in enumerate(changes) if n not in {i for i, _ in failed}]
    revision = spark.createDataFrame([(number, "applied", json.dumps(done), json.dumps(editor.steps), list(decision_keys))], "id long, status string, changes string, undo string, decision_keys array<string>")
    moves = rows.where(F.size("log") > 0).select("page_id", "raw_tag", F.explode("log").alias("m")).select(F.lit(number).cast("long").alias("revision"), "m.step", "page_id", "raw_tag", F.col("m.from").alias("from_id"), F.col("m.to").alias("to_id"))
    state.commit(
        page_tags=rows.select("page_id", "raw_tag", F.col("at").alias("resolved_tag_id")),
        revisions=state.table("revisions").unionByName(revision.withColumn("created_at", F.current_timestamp())),
        moves=state.table("moves").unionByName(moves),
        next_id={"tags": editor.next_id, "revisions": number + 1},
        **editor.tables(_vectors_gone(editor.steps)),
    )
    return failed


def undo_last(state: State) -> bool:
    """Undoes the latest applied revision; False if there is none.

    Its steps are undone newest first, and pages tagged since stay tagged: rows
    go back only from where the revision put them, a tag made by it that newer
    pages use is kept or gives its pages to what it was split from, and a newer
    tag that took a restored name is absorbed.  Its decisions become declined.
    """
    last = state.table("revisions").where("status = 'applied'").orderBy(F.desc("id")).first()
    if last is None:
        return False
    spark, editor = state.spark, Editor(state)
    steps = json.loads(last["undo"])
    moves = state.table("moves").where(F.col("revision") == last["id"])
    rows = editor.links.select("page_id", "raw_tag", "at")
    freed: list[tuple[str, int]] = []
    fresh_vectors: set[int] = set()

    def redirect(df, old, new):
        return df.withColumn("at", F.when(F.col("at") == old, F.lit(new).cast("long")).otherwise(F.col("at")))

    def absorb(newcomer: int, into: int) -> None:
        nonlocal rows
        rows = redirect(rows, newcomer, into)
        editor.move_aliases(newcomer, into)
        for child in editor.children(newcomer):
            editor._set(child, parent_id=into)
        editor._by_name.pop(editor.tags.pop(newcomer)["name"], None)
        fresh_vectors.add(newcomer)

    for step in reversed(steps):
        kind = step["step"]
        if kind == "retargeted":
            back = moves.where(F.col("step") == step["n"]).select("page_id", "raw_tag", F.col("from_id"), F.col("to_id").alias("at"))
            rows = cut(rows.join(back, ["page_id", "raw_tag", "at"], "left").select("page_id", "raw_tag", F.coalesce("from_id", "at").alias("at")))
        elif kind == "aliases_moved":
            for a in step["aliases"]:
                if a in editor.aliases:
                    freed.append((a, editor.aliases[a]["tag_id"]))
                    editor.aliases[a] = editor.aliases[a] | {"tag_id": step["from"]}
        elif kind == "alias_added":
            if step["alias"] in editor.aliases:
                freed.append((step["alias"], editor.aliases.pop(step["alias"])["tag_id"]))
        elif kind == "aliases_deleted":
            for row in step["rows"]:
                newcomer = editor._by_name.get(row["alias"])
                if newcomer is not None:
                    absorb(newcomer, row["tag_id"])
                editor.aliases[row["alias"]] = row | {"created_at": None}
        elif kind == "tag_created" and step["id"] in editor.tags:
            id_, fallback = step["id"], step["fallback"]
            for child in editor.children(id_):
                editor._set(child, parent_id=None, placed=False)
            if fallback is not None and fallback in editor.tags:
                absorb(id_, fallback)
            elif rows.where(F.col("at") == id_).isEmpty():
                editor.aliases = {a: r for a, r in editor.aliases.items() if r["tag_id"] != id_}
                editor._by_name.pop(editor.tags.pop(id_)["name"], None)
                fresh_vectors.add(id_)
            else:
                editor._set(id_, parent_id=None, placed=False)
        elif kind == "tag_deleted":
            row = step["row"] | {"created_at": None}
            newcomer = editor._by_name.get(row["name"])
            if row["parent_id"] is not None and row["parent_id"] not in editor.tags:
                row |= {"parent_id": None, "placed": False}
            editor.tags[row["id"]] = row
            if newcomer is not None:
                absorb(newcomer, row["id"])
            editor._by_name[row["name"]] = row["id"]
        elif kind == "moved" and step["id"] in editor.tags:
            parent = step["parent"] if step["parent"] is None or step["parent"] in editor.tags else None
            editor._set(step["id"], parent_id=parent, placed=step["placed"] and (parent is not None or step["parent"] is None))
        elif kind == "renamed" and step["id"] in editor.tags:
            newcomer = editor._by_name.get(step["name"])
            if newcomer is not None and newcomer != step["id"]:
                absorb(newcomer, step["id"])
            editor._set(step["id"], name=step["name"])
            fresh_vectors.add(step["id"])

    owners = [(alias, was, editor.owner(alias)) for alias, was in freed]
    owners = [o for o in dict.fromkeys(owners) if o[2] is not None and o[2] != o[1]]
    if owners:
        table = spark.createDataFrame(owners, "alias string, at long, owner long").dropDuplicates(["alias", "at"])
        named = rows.withColumn("alias", T.normalize_name(F.col("raw_tag")))
        rows = named.join(bounded(table), ["alias", "at"], "left").select("page_id", "raw_tag", F.coalesce("owner", "at").alias("at"))
    status = F.when(F.col("id") == last["id"], "undone").otherwise(F.col("status"))
    state.commit(
        page_tags=rows.select("page_id", "raw_tag", F.col("at").alias("resolved_tag_id")),
        revisions=state.table("revisions").withColumn("status", status),
        moves=state.table("moves").where(F.col("revision") != last["id"]),
        tag_decisions=_decisions(state, list(last["decision_keys"] or []), "declined", "user"),
        **editor.tables(fresh_vectors),
    )
    return True


def valid_parts(names: list[str]) -> list[str]:
    """Usable names, each once, in order."""
    return list(dict.fromkeys(n for n in map(normalize_name, names) if n))
