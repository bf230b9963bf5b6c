"""Raw tags of pages to tags, in page order, with limits on tags and new tags per page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.functions.names import normalize_name
from loomtide.operators.shared import bounded, collect_bounded

#: Pages resolved in one step on the driver; what a step holds doesn't grow with the archive.
BATCH_PAGES = 2_000


@dataclass
class Resolved:
    links: list = field(default_factory=list)  # (page_id, raw_tag, tag_id)
    tags: list = field(default_factory=list)  # (id, name, description)
    aliases: list = field(default_factory=list)  # (alias, tag_id)
    next_id: int = 1


def known_names(tags: DataFrame, aliases: DataFrame, names: DataFrame) -> list:
    """(name, id, rank) of the tags and aliases that (name) can resolve to: by name 0, alias 1, without hyphens 2."""
    wanted = names.where("name IS NOT NULL").select("name").distinct()
    by_name = tags.join(bounded(wanted), "name", "left_semi").select("name", "id", F.lit(0).alias("rank"))
    by_alias = aliases.join(bounded(wanted.withColumnRenamed("name", "alias")), "alias", "left_semi").select(F.col("alias").alias("name"), F.col("tag_id").alias("id"), F.lit(1).alias("rank"))
    keys = wanted.select(T.squash(F.col("name")).alias("name")).distinct()
    squashed = tags.select(T.squash(F.col("name")).alias("name"), "id").join(bounded(keys), "name", "left_semi").groupBy("name").agg(F.min("id").alias("id")).select("name", "id", F.lit(2).alias("rank"))
    return collect_bounded(by_name.unionByName(by_alias).unionByName(squashed), "names of one batch")


def resolve(pages: list[dict], known: list, next_id: int, max_per_page: int = 5, max_new: int = 3) -> Resolved:
    """Resolves pages of id, title, tags and new_tags in the order given.

    A page stops at ``max_per_page`` tags.  A name that no tag, alias or
    spelling without hyphens has makes a tag, ``max_new`` a page at most unless
    the page would stay untagged; a tag found under another spelling gets that
    spelling as an alias.  A tag counts once a page.
    """
    names, aliases, squashed = ({k["name"]: k["id"] for k in known if k["rank"] == r} for r in range(3))
    out = Resolved(next_id=next_id)
    for page in pages:
        about = {}
        for t in page.get("new_tags") or []:
            if (t["description"] or "").strip():
                about[normalize_name(t["name"])] = t["description"].strip()
        have, created = [], 0
        for raw in page["tags"] or []:
            if len(have) >= max_per_page:
                break
            name = normalize_name(raw)
            if name is None:
                continue
            key = name.replace("-", "")
            found = names.get(name, aliases.get(name, squashed.get(key)))
            if found is None:
                if created >= max_new and have:
                    continue
                found, out.next_id = out.next_id, out.next_id + 1
                out.tags.append((found, name, about.get(name) or f"first used for: {page.get('title') or ''}"))
                names[name], created = found, created + 1
                squashed.setdefault(key, found)
            elif name not in names and name not in aliases:
                aliases[name] = found
                out.aliases.append((name, found))
            if found not in have:
                have.append(found)
                out.links.append((page["id"], raw, found))
    return out
