"""Text, tag-name and number expressions.  Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
RESERVED = "status/"


def _nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def one_line(c: Column) -> Column:
    """Unicode white space collapsed to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def kebab(c: Column) -> Column:
    return _nonempty(F.regexp_replace(F.regexp_replace(F.lower(c), NON_WORD, "-"), "^-+|-+$", ""))


def normalize_name(c: Column) -> Column:
    """Flat kebab-case tag name; null for reserved, empty or digit-only tags."""
    bare = F.trim(F.regexp_replace(F.trim(c), "^#+", ""))
    parts = F.filter(F.transform(F.split(bare, "/"), kebab), lambda x: x.isNotNull())
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(~F.lower(bare).startswith(RESERVED) & ~last.rlike("^[0-9-]+$"), last)


def squash(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def plural_variants(name: Column) -> Column:
    """Singular or plural spellings of the last word of a name, as an array without nulls."""
    last = F.regexp_extract(name, "([^-]*)$", 1)
    head = F.left(name, F.char_length(name) - F.char_length(last))
    plural = (F.char_length(last) > 3) & last.endswith("s") & ~last.rlike("(ss|us|is)$")
    single = ~last.endswith("s")
    options = F.array(
        F.when(plural & last.endswith("ies"), F.regexp_replace(last, "ies$", "y")),
        F.when(plural & last.endswith("es"), F.regexp_replace(last, "es$", "")),
        F.when(plural, F.regexp_replace(last, "s$", "")),
        F.when(single, F.concat(last, F.lit("s"))),
        F.when(single & last.rlike("(x|z|ch|sh)$"), F.concat(last, F.lit("es"))),
        F.when(single & last.endswith("y"), F.regexp_replace(last, "y$", "ies")),
    )
    return F.transform(F.filter(F.array_compact(options), lambda w: (w != last) & (w != "")), lambda w: F.concat(head, w))


def slug(c: Column, limit: int = 80) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.lower(c), NON_WORD, "-"), "^-+", "")
    return F.coalesce(_nonempty(F.regexp_replace(F.left(flat, F.lit(limit)), "-+$", "")), F.lit("page"))


def clean_text(c: Column) -> Column:
    """White space collapsed in each line; runs of blank lines become one, none at the ends."""
    lines = F.array_join(F.transform(F.split(c, "\r?\n"), one_line), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def truncated(c: Column, limit: int) -> tuple[Column, Column]:
    """(first ``limit`` characters, whether that cut the text)."""
    return F.left(c, F.lit(limit)), F.char_length(c) > limit


def title_words(c: Column) -> Column:
    """Lower-case words, each between single spaces, for containment tests."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), NON_WORD, " ")), F.lit(" "))


def contains_words(haystack: Column, needle: Column) -> Column:
    """Whether the words of ``needle`` stand side by side in ``haystack``; false for no words."""
    words = title_words(needle)
    return (F.trim(words) != "") & F.contains(title_words(haystack), words)


def own_title(c: Column) -> Column:
    return F.when(c.rlike(r"[\p{IsAlphabetic}\p{N}]"), F.trim(c))


def display_title(own: Column, title: Column, style: str = "both") -> Column:
    """The note's title: ``summary``, ``page``, or both where they differ."""
    mine = own_title(own)
    same = contains_words(mine, title) | contains_words(title, mine)
    if style == "summary":
        return one_line(title)
    if style == "page":
        return one_line(F.coalesce(mine, title))
    return one_line(F.when(mine.isNull(), title).when(same, mine).otherwise(F.concat(mine, F.lit(" ("), F.trim(title), F.lit(")"))))


def json_string(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":', ""), r"\}$", "")


def link_text(c: Column) -> Column:
    return F.regexp_replace(one_line(c), r"([\\\[\]])", r"\\$1")


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def duration(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    )


def noun(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.lit("merge:"), F.least(a, b), F.lit("|"), F.greatest(a, b))


def decode_entities(c: Column) -> Column:
    """The named entities; ampersand last, so that nothing is decoded twice.  Unknown ones stay."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def html_title(html: Column) -> Column:
    """Decoded title of the head, null if blank."""
    head = F.regexp_extract(html, r"(?is)\A(.*?)(</head[\s>]|<body[\s>]|\z)", 1)
    return _nonempty(one_line(decode_entities(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1))))
