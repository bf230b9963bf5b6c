"""URL normalisation and filter rules as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only say where a visit came from; also every name that starts with ``utm_``.
TRACKING = ["fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi"]

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _is_tracking(param: Column) -> Column:
    key = F.regexp_extract(param, "^([^=]*)", 1)
    return key.startswith("utm_") | key.isin(*TRACKING)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def rejection(u: Column) -> Column:
    """``invalid``, ``not_web`` or null for a web address."""
    return F.when(scheme(u) == "", "invalid").when(~scheme(u).isin("http", "https"), "not_web").when(~F.trim(u).rlike(_URL), "invalid")


def normalize_url(u: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters; null unless a web address."""
    part = lambda i: F.regexp_extract(F.trim(u), _URL, i)
    host = F.regexp_replace(F.lower(part(2)), F.when(scheme(u) == "http", F.lit(":80$")).otherwise(F.lit(":443$")), F.lit(""))
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    query = F.substring(part(4), 2, 1 << 30)
    params = F.split(query, "&")
    kept = F.filter(params, lambda p: ~_is_tracking(p) & (p != ""))
    rebuilt = F.concat(F.lit("?"), F.replace(F.array_join(kept, "&"), F.lit("%20"), F.lit("+")))
    dropped = F.exists(params, _is_tracking)
    tail = F.when((query == "") | (F.size(kept) == 0), F.lit("")).when(dropped, rebuilt).otherwise(part(4))
    return F.when(rejection(u).isNull(), F.concat(scheme(u), F.lit("://"), host, path, tail))


def host(u: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d+$", "")), F.lit(""))


def bare_host(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^(www\.)+", "")


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob; ``*`` also crosses slashes.

    ``{a,b}`` stands for either part, which may hold globs, and a backslash takes
    the next character as it is.  Raises ValueError for braces that don't match.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"nothing after the backslash in {pattern!r}")
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"an open brace in {pattern!r}")
    return "^" + "".join(out) + "$"


def _check_pattern(value: str) -> None:
    """Raises ValueError for a pattern that the JVM, which runs it, doesn't take."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(value)
    except (IllegalArgumentException, Py4JJavaError) as e:
        raise ValueError(f"bad pattern {value!r}: {e}") from e


def rule(text: str, url: Column) -> Column:
    """A ``kind:value`` rule as a predicate; raises ValueError for an unknown kind, an empty value or a bad pattern."""
    kind, sep, value = text.partition(":")
    value = value.strip()
    if not sep or not value:
        raise ValueError(f"a rule needs a kind and a value: {text!r}")
    if kind == "domain":
        name = value.removeprefix("*.").strip(".").lower()
        if not name:
            raise ValueError(f"no domain in {text!r}")
        return (host(url) == name) | host(url).endswith("." + name)
    if kind == "glob":
        return url.rlike(glob_regex(value))
    if kind == "regex":
        _check_pattern(value)
        return url.rlike(value)
    if kind == "prefix":
        return url.startswith(value)
    raise ValueError(f"unknown rule kind in {text!r}")


def allowed(url: Column, allow: list[str], deny: list[str]) -> Column:
    """(no allow rule or any allow rule) and no deny rule."""
    some = lambda rules: reduce(lambda a, b: a | b, [rule(r, url) for r in rules])
    out = some(allow) if allow else F.lit(True)
    return out & ~some(deny) if deny else out
