"""Expressions on small tables of cases."""

import pytest
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.functions import urls as U
from loomtide.functions.html import readable
from loomtide.operators.hierarchy import closure


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "name"),
    [("#Rust  Lang", "rust-lang"), ("tech/Web Dev", "web-dev"), ("tech/ /", "tech"), ("Status/failed", None), ("2024", None), ("20-24", None), ("Ça va!", "ça-va"), ("##", None), ("a/2024", None)],
)
def test_normalize_name(spark, raw, name):
    assert value(spark, T.normalize_name(F.lit(raw))) == name


@pytest.mark.parametrize(
    ("name", "forms"),
    [("board-games", ["board-gam", "board-game"]), ("box", ["boxs", "boxes"]), ("city", ["citys", "cities"]), ("cities", ["city", "citi", "citie"]), ("glass", []), ("bus", []), ("gas", [])],
)
def test_plural_variants(spark, name, forms):
    assert value(spark, T.plural_variants(F.lit(name))) == forms


@pytest.mark.parametrize(
    ("url", "norm"),
    [
        ("HTTP://Example.COM:80/a?utm_source=x&b=1#top", "http://example.com/a?b=1"),
        ("https://a.org", "https://a.org/"),
        ("https://a.org/?utm_medium=x", "https://a.org/"),
        ("https://a.org/p?q=a%20b", "https://a.org/p?q=a%20b"),
        ("https://a.org/p?q=a%20b&gclid=1", "https://a.org/p?q=a+b"),
        ("ftp://a.org/", None),
        ("not a url", None),
    ],
)
def test_normalize_url(spark, url, norm):
    assert value(spark, U.normalize_url(F.lit(url))) == norm


def test_rules(spark):
    url = F.lit("https://docs.example.org/a/b?x=1")
    for rule, hit in (("domain:*.example.org", True), ("domain:ample.org", False), ("glob:https://*/b*", True), ("regex:a/[b-c]", True), ("prefix:http://", False)):
        assert value(spark, U.rule(rule, url)) is hit
    assert value(spark, U.allowed(url, [], ["domain:example.org"])) is False
    for bad in ("domain:", "what:x", "regex:(", "plain"):
        with pytest.raises(ValueError):
            U.rule(bad, url)


def test_text(spark):
    assert value(spark, T.clean_text(F.lit("\n\n a  b \n\n\n\nc\t d\n"))) == "a b\n\nc d"
    assert value(spark, T.slug(F.lit("  --  "))) == "page"
    assert value(spark, T.html_title(F.lit("<head><title> A &amp;amp; B </title></head><body><title>x</title>"))) == "A &amp; B"
    assert value(spark, T.html_title(F.lit("<head></head><body><title>x</title>"))) is None
    assert value(spark, T.display_title(F.lit("Rust book"), F.lit("The Rust Book, online"))) == "Rust book"
    assert value(spark, T.display_title(F.lit("—"), F.lit("Own"))) == "Own"
    assert [value(spark, T.duration(F.lit(s))) for s in (5.4, 75.0, 6120.0)] == ["5s", "1m 15s", "1h 42m"]
    assert readable("<nav>menu</nav><article><p>One</p>two<script>x</script></article>") == "One\ntwo"


def test_globs_and_patterns(spark):
    url = spark.createDataFrame([(u,) for u in ("https://a.org/x.html", "https://b.org/x.htm", "https://c.org/x*y", "https://a.org/{z}")], "u string")
    found = lambda r: [x.u[8] for x in url.where(U.rule(r, F.col("u"))).collect()]
    assert found("glob:https://{a,b}.org/*.htm{,l}") == ["a", "b"] and found("glob:*/x\\*y") == ["c"] and found("glob:*/\\{?\\}") == ["a"]
    assert found("glob:https://{a,{b,c}}.org/x*") == ["a", "b", "c"]
    for bad in ("glob:{a,b", "glob:a\\", "regex:(?P<x>a)", "regex:["):
        with pytest.raises(ValueError):
            U.rule(bad, F.col("u"))


def test_closure_of_a_deep_tree(spark):
    tree = spark.createDataFrame([(k, k - 1 if k else None, f"n{k}") for k in range(12)] + [(50, 51, "a"), (51, 50, "b")], "id long, parent_id long, name string")
    got = closure(tree, max_depth=20).where("id < 50").collect()
    assert sorted((r.id, r.ancestor, r.up) for r in got) == sorted((k, a, k - a) for k in range(12) for a in range(k + 1))
