"""The tag review: candidates as DataFrames, verdicts and proposals on the driver.

A review asks a model about few pairs and groups, and a person approves the
outcome, so everything after the candidates is small by nature.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.functions import vectors as V
from loomtide.functions.names import normalize_name, pages_noun, pair_key

NEIGHBOURS = 5


@dataclass
class Proposal:
    change: dict
    description: str
    decision_keys: list = field(default_factory=list)


def merge_candidates(tags: DataFrame, vectors: DataFrame | None, decided: DataFrame, similarity: float = 0.80) -> DataFrame:
    """(rank, a, b, key) of tag pairs that may be one tag: plural spellings first, then alike names.

    ``tags`` is (id, name, pages, locked), ``vectors`` (id, vector) of names or
    None, ``decided`` has ``key``.  A tag's five best neighbours are taken before
    locked and decided pairs are dropped; the first finding of a pair fixes
    which of its tags comes first.
    """
    tags = tags.select("id", "name", "pages", "locked")
    other = tags.select(F.col("id").alias("b_id"), F.col("name").alias("b"), F.col("locked").alias("b_locked"))
    plural = tags.select("*", F.posexplode(T.plural_variants(F.col("name"))).alias("nth", "b")).join(other, "b")
    found = plural.select(F.lit(0).alias("turn"), "pages", "name", F.col("nth").cast("long").alias("nth"), "b", "locked", "b_locked")
    if vectors is not None:
        near = V.similar(vectors, vectors, threshold=similarity, top=NEIGHBOURS)
        nth = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
        near = near.withColumn("nth", nth).where(F.col("nth") <= NEIGHBOURS)
        near = near.join(tags, F.col("id") == F.col("left_id")).join(other, F.col("b_id") == F.col("right_id"))
        found = found.unionByName(near.select(F.lit(1).alias("turn"), "pages", "name", F.col("nth").cast("long").alias("nth"), "b", "locked", "b_locked"))
    found = found.where("NOT locked AND NOT b_locked AND name != b").withColumn("key", T.pair_key(F.col("name"), F.col("b")))
    first = F.struct("turn", (-F.col("pages")).alias("less"), "name", "nth")
    pairs = found.groupBy("key").agg(F.min_by(F.struct(F.col("name").alias("a"), "b"), first).alias("p"), F.min(first).alias("rank"))
    return pairs.join(decided.select("key").distinct(), "key", "left_anti").select("rank", "p.a", "p.b", "key").orderBy("rank")


def merge_groups(pages: dict[str, int], verdicts: list[tuple[str, str, str]], locked: set[str] = frozenset(), owned: dict[str, str] | None = None, declined: set[str] = frozenset()) -> list[Proposal]:
    """Renames and merges from accepted pairs (a, b, name to keep).

    ``pages`` gives each tag's pages in id order, ``owned`` the tag of every name
    and alias.  Tags tied by pairs, or by a kept name that is an unlocked tag,
    form a group.  The name with most votes stays; on equal votes the one of the
    bigger member, then the last by alphabet.  A new name is given to the biggest
    member, unless it is given already, belongs to a tag outside, or was declined.
    """
    owned = owned or {}
    place = {name: i for i, name in enumerate(pages)}
    parent: dict[str, str] = {}
    votes: dict[str, Counter] = defaultdict(Counter)

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, keep in verdicts:
        for other in (b, keep if keep in pages and keep not in locked else b):
            top, low = root(a), root(other)
            if top != low:
                parent[low] = top
                votes[top] += votes.pop(low, Counter())
        votes[root(a)][keep] += 1
    members = defaultdict(list)
    for name in parent:
        members[root(name)].append(name)
    asked = {pair_key(a, b) for a, b, _ in verdicts}
    out, given = [], set()
    for top in sorted(members, key=lambda n: place.get(n, len(place))):
        group = sorted((n for n in members[top] if n != top), key=lambda n: place.get(n, len(place))) + [top]
        if len(group) < 2:
            continue
        biggest = max(enumerate(group), key=lambda x: (pages.get(x[1], 0), x[0]))[1]
        keep = max(votes[top], key=lambda n: (votes[top][n], pages.get(n, 0) if n in group else 0, n))
        outside = owned.get(keep) is not None and owned[keep] not in group
        if keep not in group and (keep in given or outside or f"rename:{biggest}>{keep}" in declined):
            keep = biggest
        given.add(keep)
        into = keep if keep in group else biggest
        if keep not in group:
            out.append(Proposal({"op": "rename", "tag": biggest, "name": keep}, f"rename {biggest} → {keep} ({pages_noun(pages.get(biggest, 0))})", [f"rename:{biggest}>{keep}"]))
        for old in group:
            if old != into:
                # The change is applied after the rename, so it names the tag as it is called then.
                keys = {pair_key(old, into), pair_key(old, keep)} | {k for k in asked if old in k.removeprefix("merge:").split("|")}
                out.append(Proposal({"op": "merge", "from": old, "into": keep}, f"merge  {old} → {keep} ({pages.get(old, 0)} + {pages_noun(pages.get(into, 0))})", sorted(keys)))
    return out


def read_merges(reply: dict, batch: list[tuple[str, str]]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(accepted pairs with the name to keep, keys of pairs that are separate) of a reply about a batch; wrong numbers are ignored."""
    accepted, separate = [], []
    for d in reply.get("decisions") or []:
        n = d.get("pair")
        if not isinstance(n, int) or not 1 <= n <= len(batch):
            continue
        a, b = batch[n - 1]
        if d.get("merge"):
            accepted.append((a, b, normalize_name(d.get("keep")) or a))
        else:
            separate.append(pair_key(a, b))
    return accepted, separate


def read_split(reply: dict, tag: str, sampled: list[int], descriptions: dict[str, str] | None = None) -> list[dict] | None:
    """Parts (name, description, pages) of a usable verdict to split a tag, else None.

    At least two different valid names, the first assignment of every sampled
    page names one of them, and two parts still have pages.  Names that are tags
    already keep their description.
    """
    about: dict[str, str] = {}
    for t in reply.get("tags") or []:
        name = normalize_name(t.get("name"))
        if name:
            about.setdefault(name, (descriptions or {}).get(name) or (t.get("description") or "").strip())
    if len(about) < 2:
        return None
    given: dict[int, str | None] = {}
    for x in reply.get("assignments") or []:
        n = x.get("page")
        if isinstance(n, int) and 1 <= n <= len(sampled):
            given.setdefault(n, normalize_name(x.get("tag")))
    if any(given.get(n) not in about for n in range(1, len(sampled) + 1)):
        return None
    parts = [{"name": name, "description": text or None, "pages": [p for n, p in enumerate(sampled, 1) if given[n] == name]} for name, text in about.items()]
    parts = [p for p in parts if p["pages"]]
    return parts if len(parts) > 1 else None


def assign_rest(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """(tag, id, part) of pages outside the sample: the part whose centre is nearest, the last of equal ones.

    ``vectors`` is (tag, id, vector) of all pages, ``parts`` (tag, id, part) of the sampled ones.
    """
    flat = vectors.join(parts, ["tag", "id"]).select("tag", "part", F.posexplode("vector").alias("i", "x"))
    sums = flat.groupBy("tag", "part", "i").agg(F.round(F.sum(F.col("x").cast("double")), 9).alias("s"))
    centres = sums.groupBy("tag", "part").agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("s")).select("tag", "part", V.normalized(F.col("s")).alias("centre"))
    rest = vectors.join(parts.select("tag", "id"), ["tag", "id"], "left_anti").join(centres, "tag")
    near = F.struct(F.round(V.dot(F.col("vector"), F.col("centre")), 12), "part")
    return rest.groupBy("tag", "id").agg(F.max_by("part", near).alias("part"))


def split_proposals(splits: list[tuple[str, list[dict]]], merges: list[Proposal], owned: dict[str, str]) -> list[Proposal]:
    """One split a tag; none of a tag that this review merges or renames, that is a part of an earlier split, or with a part that an earlier split divides."""
    touched = {n for p in merges for n in (p.change.get("from"), p.change.get("into"), p.change.get("tag"), p.change.get("name")) if n}
    same = lambda n: owned.get(n, n)
    divided, targets, out = set(), set(), []
    for tag, parts in splits:
        names = {same(p["name"]) for p in parts} - {tag}
        if tag in touched or tag in divided or tag in targets or names & divided:
            continue
        divided.add(tag)
        targets |= names
        text = ", ".join(f"{p['name']} ({pages_noun(len(p['pages']))})" for p in parts)
        out.append(Proposal({"op": "split", "tag": tag, "parts": parts}, f"split  {tag} → {text}", [f"split:{tag}"]))
    return out


def parse_choice(text: str, count: int) -> list[int] | None:
    """Indexes of the approved proposals: blank, y, yes, all; n, no, none; else the numbers to skip.  None if it can't be read."""
    word = text.strip().lower()
    if word in ("", "y", "yes", "all"):
        return list(range(count))
    if word in ("n", "no", "none"):
        return []
    parts = [p for p in re.split(r"[\s,]+", word) if p]
    if not all(re.fullmatch(r"[0-9]+", p) and 1 <= int(p) <= count for p in parts):
        return None
    return [n for n in range(count) if n + 1 not in set(map(int, parts))]


def approve(proposals: list[Proposal], approved: list[int] | None) -> tuple[list[Proposal], list[str], list[Proposal]]:
    """(to apply, keys that were declined, held back); None approved means that nobody was asked, and nothing is declined.

    A placement whose path holds the name of a tag with a declined placement is held back.
    """
    if approved is None:
        return [], [], []
    declined = [p for n, p in enumerate(proposals) if n not in approved]
    names = {t for p in declined if p.change["op"] == "place" for t in p.change["tags"]}
    apply, held = [], []
    for n in approved:
        p = proposals[n]
        (held if p.change["op"] == "place" and names & set(p.change["path"]) else apply).append(p)
    return apply, sorted({k for p in declined for k in p.decision_keys}), held


def step_failed(failed_requests: int, proposed: int) -> bool:
    """Whether failed requests make the review a failure: only if nothing came of it."""
    return failed_requests > 0 and proposed == 0


def run_review(pairs: list[tuple[str, str]], ask, batch_size: int = 20) -> tuple[list, list[str], list[str]]:
    """(accepted, separate keys, errors) of all pairs; ``ask(batch)`` gives the reply.  A failed request loses only its batch."""
    accepted, separate, errors = [], [], []
    for at in range(0, len(pairs), batch_size):
        batch = pairs[at : at + batch_size]
        try:
            yes, no = read_merges(ask(batch), batch)
        except (ValueError, RuntimeError, OSError, AttributeError, TypeError) as e:
            errors.append(str(e))
            continue
        accepted += yes
        separate += no
    return accepted, separate, errors
