"""Whole runs on small hand-made tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlake import schemas
from feedlake.functions import text
from feedlake.operators.queue import PENDING
from feedlake.plans import discover, drain, sync
from feedlake.sources.feeds import with_feed

NOW = datetime(2026, 3, 20, 12)
LONG, SHORT = "word " * 400, "teaser"


@pytest.fixture
def feeds(spark):
    rows = [
        (0, "A one", "A", "default", "u", "vault/a", 90),
        (1, "A two", "A", "khoros", "u", "vault/a", 90),
        (2, "B", "B", "default", "u", "vault/b", 90),
        (3, "silent", "C", None, "u", "vault/c", 90),
    ]
    return spark.createDataFrame(rows, schemas.FEEDS)


def entries(spark, feeds, rows):
    """Entries of ``(feed_ord, entry_ord, link, title, summary)``."""
    full = [
        (feed, at, link, title, None, [("W",)], "raw", datetime(2026, 1, 1), None, summary)
        for feed, at, link, title, summary in rows
    ]
    return with_feed(spark.createDataFrame(full, schemas.ENTRY), feeds)


def pages(spark, *urls):
    rows = [(url, f"<article><p>page {url}</p></article>") for url in urls]
    return spark.createDataFrame(rows, schemas.PAGE)


def no_notes(spark, *keys):
    rows = [(folder, key, name) for folder, key, name in keys]
    return spark.createDataFrame(rows, "vault_folder string, url_key string, note_name string")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_sync(spark, feeds):
    found = entries(
        spark,
        feeds,
        [
            (0, 0, "http://p1", "Same &amp; title", SHORT),
            (0, 1, "http://p2/", "Same & title", SHORT),
            (0, 2, "http://stub", "Stub", SHORT),
            (0, 3, "http://stored/", "Stored", LONG),
            (0, 4, "", "No link", LONG),
            (1, 0, "http://P1", "Later feed", LONG),
            (1, 1, "http://stub", "Later stub", LONG),
            (2, 0, "http://full", None, LONG),
            (2, 1, "http://full/", "Twice in one feed", LONG),
        ],
    )
    stored = no_notes(spark, ("vault/a", "http://stored", "Old"), ("vault/b", "x", "Untitled"))
    run = sync.sync(
        feeds, found, stored, pages(spark, "http://p1", "http://p2/"), empty(spark, schemas.MANIFEST), NOW
    )
    written = {(r.feed_ord, r.entry_ord): r for r in run["notes"].collect()}
    # A note of the first feed blocks the second one, its held-back stub does not.
    assert {k: r.rel_path for k, r in written.items()} == {
        (0, 0): "vault/a/Same & title",
        (0, 1): "vault/a/Same & title (2)",
        (1, 1): "vault/a/Later stub",
        (2, 0): "vault/b/Untitled (2)",
        (2, 1): "vault/b/Twice in one feed",
    }
    first = written[0, 0]
    assert first.note_text == (
        "---\nlink: http://p1\nauthor: W\npublished: 2026-01-01T00:00:00+00:00\n"
        "clipped: 2026-03-20T12:00:00+00:00\nsource: A\nfeed_kind: default\ntags:\n---\n\n# Content\n\npage http://p1\n"
    )
    assert [(r.url, r.body_chars) for r in run["stubs"].collect()] == [("http://stub", len(SHORT))]
    # Its key has a note now (by the second feed), so the manifest is empty.
    assert run["manifest"].count() == 0
    counts = {r.name: r.new_count for r in run["feed_counts"].collect()}
    assert counts == {"A one": 2, "A two": 1, "B": 2, "silent": 0}
    assert run["total"].first().total_new == 5
    assert run["log"].filter("part = 3").count() == 5


def test_sync_keeps_stubs_in_the_manifest(spark, feeds):
    found = entries(spark, feeds, [(0, 0, "http://s/", "S", SHORT)])
    run = sync.sync(feeds, found, no_notes(spark), pages(spark), empty(spark, schemas.MANIFEST), NOW)
    assert [(r.url_key, r.vault_folder, r.first_seen) for r in run["manifest"].collect()] == [("http://s", "vault/a", NOW)]
    assert run["notes"].count() == 0 and run["total"].first().total_new == 0
    size = run["manifest_size"].first()
    assert (size.n_stubs, size.generated) == (1, "2026-03-20T12:00:00+00:00")


def test_sync_cap_and_preview(spark, feeds):
    rows = [(0, n, f"http://e{n}", f"T{n}", LONG) for n in range(5)] + [(2, 0, "http://b", "B", LONG)]
    found = entries(spark, feeds, rows)
    args = (feeds, found, no_notes(spark), pages(spark), empty(spark, schemas.MANIFEST), NOW)
    live = sync.sync(*args, max_articles=2)["notes"]
    plan = sync.preview(found, no_notes(spark), max_articles=2)
    assert {r.rel_path for r in live.collect()} == {r.rel_path for r in plan.collect()} == {
        "vault/a/T0", "vault/a/T1", "vault/b/B",
    }
    assert sync.sync(*args, max_articles=0)["notes"].count() == 0


def one_feed_after_the_other(rows, cap):
    """What feeds of one folder write in turn; teasers count for the cap but block nothing."""
    written, out = set(), set()
    for feed in sorted({row[0] for row in rows}):
        taken = [row for row in rows if row[0] == feed and row[2] not in written][:cap]
        notes = [row for row in taken if row[4] == LONG]
        written |= {row[2] for row in notes}
        out |= {(feed, row[1]) for row in notes}
    return out


@pytest.mark.parametrize("cap", [1, 2])
def test_only_written_rows_block_a_later_feed(spark, cap):
    # Each feed's cut decides the next one's: a chain over all of them.
    links = [["x", "y", "s"], ["y", "z", "x"], ["s", "z", "w"], ["w", "v", "z"]]
    rows = [
        (feed, at, f"http://{link}", link, SHORT if link == "s" else LONG)
        for feed, own in enumerate(links) for at, link in enumerate(own)
    ]
    feeds = spark.createDataFrame([(n, f"f{n}", "A", "default", "u", "vault/a", 90) for n in range(4)], schemas.FEEDS)
    args = (feeds, entries(spark, feeds, rows), no_notes(spark), pages(spark), empty(spark, schemas.MANIFEST), NOW)
    found = {(r.feed_ord, r.entry_ord) for r in sync.sync(*args, max_articles=cap)["notes"].collect()}
    assert found == one_feed_after_the_other(rows, cap)


def test_retention_is_the_configured_one(spark, feeds):
    assert discover.configured_days(feeds) == 90
    assert discover.configured_days(feeds.withColumn("keep_synced_days", F.lit(7))) == 7
    assert discover.configured_days(feeds.limit(0)) == discover.configured_days(feeds.select("name")) == 90


def test_khoros_labels_stay_with_the_feed_text(spark, feeds):
    page = '<div class="LabelsForArticle"><a class="label-link">News</a></div>'
    found = entries(spark, feeds, [(1, 0, "http://k", "K", LONG + "<ul><li><a href='/x/blog/category/news'>N</a></li><li><a href='/x/blog/category/more'>M</a></li></ul>")])
    landed = spark.createDataFrame([("http://k", page)], schemas.PAGE)
    note = sync.sync(feeds, found, no_notes(spark), landed, empty(spark, schemas.MANIFEST), NOW)["notes"].first()
    assert note.tags == ["News", "more"] and "blog/category" not in note.note_text


def test_sync_localises_images(spark, feeds):
    found = entries(spark, feeds, [(0, 0, "http://p", "T", LONG)])
    landed = spark.createDataFrame([("http://p", '<article><img src="//i/a.png" alt="x"></article>')], schemas.PAGE)
    config = spark.createDataFrame([("A", "vault/a", "assets")], schemas.ASSET_CONFIG)
    fetched = spark.createDataFrame([("https://i/a.png", True, None, 9)], schemas.FETCH_RESULT)
    run = sync.sync(
        feeds, found, no_notes(spark), landed, empty(spark, schemas.MANIFEST), NOW, asset_cfg=config, fetch_result=fetched
    )
    assert "![x](assets/T/a.png)" in run["notes"].first().note_text
    assert [(r.assets_dir, r.asset_name) for r in run["assets"].collect()] == [("vault/a/assets/T", "a.png")]


def queue(spark, rows):
    """Queue of ``(queue_ord, url, title, feed, parser, status)``."""
    full = [(n, url, title, None, None, feed, parser, NOW, status, None) for n, url, title, feed, parser, status in rows]
    return spark.createDataFrame(full, schemas.QUEUE)


QUEUE = [
    (0, "http://p1", "One", "A", "default", "pending"),
    (1, "http://P1/", "One again", "A", None, "pending"),
    (2, "http://gone", "Gone", "A", "default", "pending"),
    (3, "http://stored", "Stored", "B", "default", "pending"),
    (4, "http://x", "Unknown feed", "Z", "default", "pending"),
    (5, "http://old", "Old", "A", "default", "synced"),
    (6, "http://p2", "One", "A", "zzz", "pending"),
]


def test_drain(spark, feeds):
    stored = no_notes(spark, ("vault/b", "http://stored", "S"))
    run = drain.drain(queue(spark, QUEUE), feeds, stored, pages(spark, "http://p1", "http://p2", "http://x"), NOW)
    status = {r.queue_ord: (r.status, r.synced_at) for r in run["queue"].collect()}
    done, waits = ("synced", NOW), ("pending", None)
    assert status == {0: done, 1: done, 2: waits, 3: done, 4: waits, 5: ("synced", None), 6: done}
    written = {r.seq: (r.rel_path, r.feed_kind) for r in run["notes"].collect()}
    assert written == {0: ("vault/a/One", "default"), 6: ("vault/a/One (2)", "zzz")}
    assert {r.seq for r in run["already_present"].collect()} == {1, 3}
    assert {r.name: r.new_count for r in run["feed_counts"].collect()} == {"A one": 2}


def test_drain_preview_writes_nothing_and_agrees(spark, feeds):
    stored = no_notes(spark, ("vault/b", "http://stored", "S"))
    plan = drain.preview(queue(spark, QUEUE), feeds, stored, kind="default", max_articles=3)
    assert {r.seq for r in plan["would_create"].collect()} == {0, 2}
    assert {r.seq for r in plan["already_present"].collect()} == {3}


def test_drain_falls_back_to_current_entries(spark, feeds):
    rows = [(n, f"http://e{n}", f"T{n}", "A", "default", "pending") for n in range(3)]
    current = entries(spark, feeds, [(0, 0, "http://E0/", "t", LONG), (0, 1, "http://e1", "t", SHORT)])
    run = drain.drain(
        queue(spark, rows), feeds, no_notes(spark), pages(spark), NOW,
        on_miss=drain.FALLBACK, entries=current, manifest=empty(spark, schemas.MANIFEST),
    )
    # Full text becomes a note, a teaser is held back, one that aged out just waits.
    assert {r.queue_ord: r.status for r in run["queue"].collect()} == {0: "synced", 1: PENDING, 2: PENDING}
    assert [r.url_key for r in run["manifest"].collect()] == ["http://e1"]
    assert [r.seq for r in run["notes"].collect()] == [0]


def test_discover_then_discover_again(spark, feeds):
    found = entries(spark, feeds, [(0, 0, "http://a", "A", ""), (1, 0, "HTTP://A", "dup", ""), (2, 0, "http://b", "B", "")])
    found = found.withColumn("published_parsed", text.parse_feed_time(F.col("published_raw")))
    first = discover.discover(feeds, found, empty(spark, schemas.QUEUE), NOW)
    assert [(r.queue_ord, r.url, r.feed, r.parser) for r in first["queue"].orderBy("queue_ord").collect()] == [
        (0, "http://a", "A", "default"), (1, "http://b", "B", "default"),
    ]
    assert {r.name: r.new_count for r in first["feed_counts"].collect()} == {"A one": 1, "A two": 0, "B": 1, "silent": 0}
    again = discover.discover(feeds, found, first["queue"], NOW)
    assert tuple(again["total"].first()) == (0, "2026-03-20T12:00:00+00:00")
    assert again["queue"].count() == 2


def test_pruned_rows_still_count_as_known_in_their_run(spark, feeds):
    old = queue(spark, [(0, "http://a", "A", "A", "default", "synced")])
    found = entries(spark, feeds, [(0, 0, "http://a", "A", "")])
    run = discover.discover(feeds, found, old, NOW)
    assert run["queue"].count() == 0 and run["pruned"].first().n_removed == 1
    assert discover.discover(feeds, found, run["queue"], NOW)["total"].first().total_new == 1


def test_one_url_with_a_third_of_all_rows(spark, feeds):
    rows = [(0, n, "http://hot" if n % 3 == 0 else f"http://e{n}", "Hot" if n % 3 == 0 else f"T{n}", LONG) for n in range(90)]
    found = entries(spark, feeds, rows)
    run = sync.sync(feeds, found, no_notes(spark), pages(spark, "http://hot"), empty(spark, schemas.MANIFEST), NOW)
    names = [r.note_name for r in run["notes"].collect()]
    assert len(names) == len(set(names)) == 90 and "Hot (30)" in names
