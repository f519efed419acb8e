from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlake.functions import keys, text


@pytest.mark.parametrize(
    "url, discovery, vault",
    [("HTTPS://X/1//", "https://x/1//", "https://x/1"), ("http://x", "http://x", "http://x")],
)
def test_keys(value, url, discovery, vault):
    assert value(keys.discovery_key, url) == discovery
    assert value(keys.vault_key, url) == vault


def test_entities(value):
    fixed = lambda t: text.decode_entities(text.repair_entities(t))
    assert value(fixed, "a &8211; b &x2F;") == "a – b /"
    assert value(text.repair_entities, "&cafe;") == "&#cafe;"
    assert value(text.decode_entities, "no entity") == "no entity"
    assert value(text.decode_entities, "&rsquo;&amp;&#x41;") == "’&A"


@pytest.mark.parametrize(
    "title, expected",
    [
        ("A: B / C", "A– B – C"),
        ('q?*"<>|\\', "q" + "–" * 7),
        ("  a   b\t\n", "a b"),
        ("x" * 199 + " " + "y" * 50, "x" * 199),
        ("z" * 250, "z" * 200),
        ("w" * 200, "w" * 200),
    ],
)
def test_sanitize_title(value, title, expected):
    assert value(text.sanitize_title, title) == expected


@pytest.mark.parametrize(
    "note, link",
    [
        ('---\nauthor: x\nlink: "HTTPS://X/1/"\n---\nlink: no', "https://x/1"),
        ("---\n  LINK:  'http://a:80/b'  \n---", "http://a:80/b"),
        ("---\nlink:\nlink: second\n---", None),
        ("---\nno link\n---\nlink: x", None),
        ("link: x\n---", None),
        ("---\nlink: http://never-closed", None),
        ("---\nlink: http://x/a---b\n---", "http://x/a"),
    ],
)
def test_frontmatter_link(value, note, link):
    assert value(lambda t: keys.vault_key(text.frontmatter_link(t)), note) == link


def test_categories(value):
    line = "- [Real-Time Intelligence](/en-us/blog/category/real-time-intelligence)"
    md = f"a\n\n{line}\n\n\nb\n- [x](/a/b/blog/category/no)\n {line}"
    assert value(text.category_slugs, md) == ["real-time-intelligence"]
    assert value(text.without_categories, md) == f"a\n\nb\n- [x](/a/b/blog/category/no)\n {line}"


def test_headings_and_blank_lines(value):
    assert value(text.without_empty_headings, "# \n# Real Heading") == "# Real Heading"
    assert value(text.without_empty_headings, "# x\n## \ny") == "# x\ny"
    assert value(text.squeeze_blank_lines, "a\n\n\n\n\nb\n\nc") == "a\n\nb\n\nc"


def test_iso_time(value):
    at = datetime(2026, 3, 20, 12, 0, 0)
    assert value(text.iso_time, at) == "2026-03-20T12:00:00+00:00"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Fri, 20 Mar 2026 12:00:00 GMT", "2026-03-20T12:00:00+00:00"),
        ("Fri, 20 Mar 2026 14:00:00 +0200", "2026-03-20T12:00:00+00:00"),
        ("2 Jan 2024 03:04:05 EST", "2024-01-02T08:04:05+00:00"),
        ("20 Mar 2026 12:00 +0000", "2026-03-20T12:00:00+00:00"),
        ("Friday, 20 Mar 2026 12:00 UT", "2026-03-20T12:00:00+00:00"),
        ("31 Feb 2026 12:00:00 GMT", "31 Feb 2026 12:00:00 GMT"),
        ("1 Foo 2026 12:00:00 GMT", "1 Foo 2026 12:00:00 GMT"),
        ("2026-03-20T12:00:00Z", "2026-03-20T12:00:00+00:00"),
        ("2026-03-20T14:00:00+02:00", "2026-03-20T12:00:00+00:00"),
        ("last week", "last week"),
        (None, ""),
    ],
)
def test_published(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "raw string").select(
        text.published_text(text.parse_feed_time(F.col("raw")), F.col("raw")).alias("v")
    )
    assert row.first()["v"] == expected


@pytest.mark.parametrize(
    "author, authors, expected",
    [
        ("a", [("b",)], "a"),
        ("", [("b",), ("c",)], "b"),
        (None, [], ""),
        (None, None, ""),
        (None, [(None,)], ""),
    ],
)
def test_author(spark, author, authors, expected):
    rows = spark.createDataFrame([(author, authors)], "a string, s array<struct<name string>>")
    assert rows.select(text.pick_author(F.col("a"), F.col("s")).alias("v")).first()["v"] == expected


def test_tag_union(spark):
    rows = spark.createDataFrame(
        [([" A ", "b"], ["a", "", " ", "C"])], "page array<string>, md array<string>"
    )
    assert rows.select(text.union_tags(F.col("page"), F.col("md")).alias("v")).first()["v"] == ["A", "b", "C"]


def test_note(spark):
    def note(tags):
        column = F.array(*map(F.lit, tags)).cast("array<string>")
        args = [F.lit(x) for x in ("u", "a", "p", "c", "s", "k")]
        return spark.range(1).select(text.note_text(*args, column, F.lit("body")).alias("v")).first()["v"]

    head = "---\nlink: u\nauthor: a\npublished: p\nclipped: c\nsource: s\nfeed_kind: k\n"
    assert note([]) == head + "tags:\n---\n\n# Content\n\nbody\n"
    assert note(["x", "y z"]) == head + 'tags:\n  - "x"\n  - "y z"\n---\n\n# Content\n\nbody\n'


def test_absolute_links(value):
    page = "<img alt=a src='//c/x.png'><a href=\"//d\">//e</a><a href=//f>g</a><a href='/h'>"
    assert value(text.absolute_links, page) == (
        "<img alt=a src='https://c/x.png'><a href=\"https://d\">//e</a><a href=https://f>g</a><a href='/h'>"
    )


def test_record_json(spark):
    rows = spark.createDataFrame([("ü", None)], "a string, b string")
    assert rows.select(text.record_json("a", "b").alias("v")).first()["v"] == '{"a":"ü","b":null}'
