"""Tag names on the driver, for replies and small lists; the rules are those of ``functions.text``."""

from __future__ import annotations

import re

RESERVED = "status/"
_RUN = re.compile(r"(?:[^\w]|_)+")


def kebab(text: str) -> str | None:
    return _RUN.sub("-", "".join(c.lower() for c in text)).strip("-") or None


def normalize_name(text: str | None) -> str | None:
    """Flat kebab-case tag name; None for reserved, empty or digit-only tags."""
    bare = (text or "").strip().lstrip("#").strip()
    if bare.lower().startswith(RESERVED):
        return None
    parts = [k for k in map(kebab, bare.split("/")) if k]
    return parts[-1] if parts and not re.fullmatch("[0-9-]+", parts[-1]) else None


def pair_key(a: str, b: str) -> str:
    return f"merge:{min(a, b)}|{max(a, b)}"


def place_key(tag: str, path: list[str]) -> str:
    return f"place:{tag}>{'/'.join(path)}"


def pages_noun(n: int) -> str:
    return f"{n} page" if n == 1 else f"{n} pages"
