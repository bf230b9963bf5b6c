"""Wanted top-level categories from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomtide.functions.names import normalize_name


@dataclass(frozen=True)
class Taxonomy:
    categories: tuple[tuple[str, str | None], ...]
    strict: bool = False

    def allows(self, top: str) -> bool:
        return not self.strict or any(top == name for name, _ in self.categories)

    def rules_text(self) -> str:
        """What the model is told about the categories."""
        lines = [f"- {name}: {about}" if about else f"- {name}" for name, about in self.categories]
        head = "Use only these top-level categories:" if self.strict else "Prefer these top-level categories; add another one only where none of them fits:"
        return "\n".join([head, *lines])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.categories), "name string, description string")


def parse(text: str) -> Taxonomy:
    data = tomllib.loads(text)
    if unknown := set(data) - {"strict", "categories"}:
        raise ValueError(f"unknown setting {min(unknown)}")
    found: dict[str, str | None] = {}
    for entry in data.get("categories", []):
        if isinstance(entry, dict):
            if set(entry) - {"name", "description"} or not isinstance(entry.get("name"), str):
                raise ValueError(f"a category has a name and may have a description: {entry!r}")
            raw, about = entry["name"], (entry.get("description") or "").strip() or None
        else:
            raw, about = entry, None
        name = normalize_name(raw) if isinstance(raw, str) else None
        if not name:
            raise ValueError(f"no usable category name: {raw!r}")
        found.setdefault(name, about)
    if not found:
        raise ValueError("no categories")
    if not isinstance(data.get("strict", False), bool):
        raise ValueError("strict is true or false")
    return Taxonomy(tuple(found.items()), data.get("strict", False))


def load(path: str) -> Taxonomy:
    return parse(Path(path).read_text("utf-8"))
