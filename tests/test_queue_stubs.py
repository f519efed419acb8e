from datetime import datetime

from pyspark.sql import functions as F

from feedlake import schemas
from feedlake.operators import dedup, joins, lookup, queue as q, reports, stubs
from feedlake.operators.ranking import sequence_of

NOW = datetime(2026, 3, 20, 12)


def queue_rows(spark, rows):
    """Queue of ``(queue_ord, status, synced_at)`` with plain other fields."""
    full = [
        (n, f"http://u/{n}", f"t{n}", None, "", "S", parser, NOW, status, at)
        for n, status, at, parser in rows
    ]
    return spark.createDataFrame(full, schemas.QUEUE)


def test_retention(spark):
    day = lambda n: datetime.fromtimestamp(NOW.timestamp() - n * 86400)
    queue = queue_rows(
        spark,
        [
            (0, "synced", day(91), None),
            (1, "synced", day(89), None),
            (2, "pending", day(400), None),
            (3, "synced", None, None),
            (4, "pending", None, None),
        ],
    )
    assert {r.queue_ord for r in q.prune(queue, NOW, 90).collect()} == {1, 2, 4}
    counts = q.prune_counts(queue, NOW, 90).first()
    assert (counts.n_before, counts.n_removed, counts.n_kept) == (5, 2, 3)
    assert q.prune(queue, NOW, 0).count() == 5


def test_kind_comes_before_cap(spark):
    kinds = ["khoros", None, "wordpress", "khoros", None]
    queue = queue_rows(spark, [(n, "pending", None, kind) for n, kind in enumerate(kinds)])
    take = lambda kind, cap: [r.queue_ord for r in q.take_pending(queue, kind, cap).orderBy("queue_ord").collect()]
    assert take("wordpress", 2) == [1, 2]
    assert take("khoros", 1) == [0]
    assert take(None, 0) == []
    assert take(None, None) == [0, 1, 2, 3, 4]
    counts = q.take_counts(queue, "wordpress", 2).first()
    assert (counts.n_skipped, counts.n_taken, counts.n_remaining) == (2, 2, 1)


def test_append_numbers_on(spark):
    records = q.queue_records(
        spark.createDataFrame(
            [(n, f"u{n}", None, None, None, None, None, "S", None) for n in (5, 3, 9)],
            "seq long, link string, title string, author string, authors array<struct<name string>>, "
            "published_parsed timestamp, published_raw string, source string, parser string",
        ),
        NOW,
        keep=["seq"],
    )
    for last, queue in ((-1, queue_rows(spark, [])), (7, queue_rows(spark, [(7, "synced", None, None)]))):
        new = {r.url: r.queue_ord for r in q.append(queue, records, "seq").collect() if r.url.startswith("u")}
        assert new == {"u3": last + 1, "u5": last + 2, "u9": last + 3}
    row = records.first()
    assert (row.title, row.author, row.published, row.parser, row.status) == ("Untitled", "", "", "wordpress", "pending")


def test_mark_synced_leaves_the_rest(spark):
    queue = queue_rows(spark, [(0, "pending", None, None), (1, "pending", None, None)])
    marked = {r.queue_ord: (r.status, r.synced_at) for r in q.mark_synced(queue, queue.filter("queue_ord = 1"), NOW).collect()}
    assert marked == {0: ("pending", None), 1: ("synced", NOW)}


FEEDS = [
    (0, "w", "A", "wordpress"), (1, "k", "A", "khoros"), (2, "d", "B", "default"),
    (3, "z", "B", "zzz"), (4, "w2", "A", None),
]


def test_feed_lookup(spark):
    feeds = spark.createDataFrame(
        [(*f, "u", "folder") for f in FEEDS],
        "feed_ord long, name string, source string, parser string, rss_url string, vault_folder string",
    )
    asked = [("A", "khoros"), ("A", "zzz"), ("A", None), ("B", "wordpress"), ("B", "zzz"), ("C", "x"), (None, None)]
    rows = spark.createDataFrame([(n, *a) for n, a in enumerate(asked)], "n long, feed string, parser string")
    found = lookup.lookup_feeds(rows, feeds, "feed", "parser", ["n"]).orderBy("n").collect()
    names = [r.feed_cfg and r.feed_cfg.name for r in found]
    # The second (A, wordpress) replaces the first one, in its place.
    assert names == ["k", "w2", "w2", "d", "z", None, None]


def test_dispatch(spark):
    rows = spark.createDataFrame([("khoros",), ("odd",), (None,)], "p string")
    runs = [r.v for r in rows.select(lookup.dispatched_parser(F.col("p"), ["wordpress", "khoros"]).alias("v")).collect()]
    assert runs == ["khoros", "default", "wordpress"]


def entries(spark, rows):
    return spark.createDataFrame(rows, "feed_ord long, entry_ord long, link string")


def test_discovery_takes_the_first_of_each_unknown_url(spark):
    batch = entries(spark, [(1, 0, "http://A"), (0, 1, "HTTP://a"), (0, 0, "http://b"), (0, 2, ""), (0, 3, None), (2, 0, "http://a/")])
    known = spark.createDataFrame([("HTTP://B",)], "url string")
    new = dedup.discover_new(batch, known, ["feed_ord", "entry_ord"])
    assert {r.link for r in new.collect()} == {"HTTP://a", "http://a/"}
    again = new.select(F.col("link").alias("url")).union(known)
    assert dedup.discover_new(batch, again, ["feed_ord", "entry_ord"]).count() == 0


def test_stored_keys_block_but_duplicates_stay(spark):
    rows = spark.createDataFrame(
        [(n, "f", "hot" if n < 50 else f"k{n}") for n in range(80)], "seq long, vault_folder string, url_key string"
    )
    notes = spark.createDataFrame([("f", "k60"), ("g", "hot"), ("f", "k60")], "vault_folder string, url_key string")
    assert {r.seq for r in dedup.unseen(rows, notes, ["seq"]).collect()} == set(range(80)) - {60}
    assert [r.seq for r in dedup.already_stored(rows, notes, ["seq"]).collect()] == [60]
    flags = dedup.with_stored_flag(rows, notes, ["seq"]).collect()
    assert len(flags) == 80 and {r.seq for r in flags if r.is_stored} == {60}


def test_only_written_notes_block_later_feeds(spark):
    rows = spark.createDataFrame(
        [(0, 0, "f", "a", "stub"), (1, 1, "f", "a", "note"), (2, 1, "f", "a", "note"), (3, 2, "f", "a", "note"), (4, 2, "g", "a", "note")],
        "seq long, feed_ord long, vault_folder string, url_key string, route string",
    )
    assert {r.seq for r in dedup.free_of_earlier_notes(rows, ["seq"]).collect()} == {0, 1, 2, 4}


def test_counts_list_feeds_without_news(spark):
    feeds = spark.createDataFrame([(0, "a"), (1, "b")], "feed_ord long, name string")
    counted = reports.feed_counts(feeds, spark.createDataFrame([(1,), (1,)], "feed_ord long"), ["feed_ord"])
    assert {r.name: r.new_count for r in counted.collect()} == {"a": 0, "b": 2}
    assert reports.total(counted).first().total_new == 2
    assert reports.total(counted.filter("false")).first().total_new == 0


def test_stub_guard(spark):
    rows = spark.createDataFrame(
        [("page", None), (None, "x" * 1499), (None, "x" * 1500)], "page_md string, fallback_md string"
    )
    assert [r.v for r in rows.select(stubs.route(F.col("page_md"), F.col("fallback_md")).alias("v")).collect()] == ["note", "stub", "note"]


def manifest_after(spark, manifest, seen, captured, at):
    records = spark.createDataFrame(
        [(url, "t", "S", "khoros", "p", folder, chars, 0, n) for n, (url, folder, chars) in enumerate(seen)],
        "url string, title string, source string, parser string, published string, vault_folder string, "
        "body_chars long, feed_ord long, entry_ord long",
    )
    notes = spark.createDataFrame(captured, "vault_folder string, url_key string")
    return spark.createDataFrame(
        stubs.update_manifest(manifest, records, notes, at).collect(), schemas.MANIFEST
    )


def test_stub_lifecycle(spark):
    runs = [datetime(2026, 1, day) for day in (1, 2, 3, 4)]
    manifest = spark.createDataFrame([], schemas.MANIFEST)
    manifest = manifest_after(spark, manifest, [("http://U/", "f", 100), ("http://u", "f", 120)], [], runs[0])
    assert [(r.url_key, r.url, r.body_chars, r.first_seen) for r in manifest.collect()] == [("http://u", "http://U/", 120, runs[0])]
    manifest = manifest_after(spark, manifest, [("http://u", "moved", 130)], [], runs[1])
    row = manifest.first()
    assert (row.first_seen, row.last_seen, row.body_chars, row.vault_folder) == (runs[0], runs[1], 130, "f")
    manifest = manifest_after(spark, manifest, [], [("g", "http://u")], runs[2])
    assert manifest.first().last_seen == runs[1]
    assert manifest_after(spark, manifest, [], [("f", "http://u")], runs[3]).count() == 0


def test_added_this_run_and_captured_is_dropped(spark):
    empty = spark.createDataFrame([], schemas.MANIFEST)
    assert manifest_after(spark, empty, [("http://u", None, 1)], [("", "http://u")], NOW).count() == 0


def test_replaying_a_run_keeps_first_seen(spark):
    empty = spark.createDataFrame([], schemas.MANIFEST)
    once = manifest_after(spark, empty, [("http://u", "f", 5)], [], datetime(2026, 1, 1))
    twice = manifest_after(spark, once, [("http://u", "f", 5)], [], datetime(2026, 1, 1))
    assert once.collect() == twice.collect()


def test_a_small_batch_leaves_the_stored_side_unshuffled(spark, tmp_path):
    stored, batch = str(tmp_path / "stored"), str(tmp_path / "batch")
    spark.range(50_000).select((F.col("id") % 9_000).cast("string").alias("k")).write.parquet(stored)
    spark.createDataFrame([("5",), ("5",), ("x",), (None,)], "k string").write.parquet(batch)
    found = joins.present_keys(spark.read.parquet(batch), spark.read.parquet(stored), ["k"])
    assert [r.k for r in found.collect()] == ["5"]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_append_keeps_rows_of_every_feed_number(spark):
    feeds = [0, (1 << 23) - 1, 1 << 23, (1 << 24) - 1, 1 << 24]
    schema = "url string, feed_ord long"
    rows = spark.createDataFrame([(f"u{n}", feed) for n, feed in enumerate(feeds)], schema).repartition(3)
    rows = rows.withColumn("seq", sequence_of(F.col("feed_ord"), F.lit(0)))
    queue = queue_rows(spark, [(7, "synced", None, None)])
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in queue.schema if f.name not in ("url", "queue_ord")]
    found = q.append(queue, rows.select("seq", "url", *missing), "seq").collect()
    assert {r.url: r.queue_ord for r in found if r.queue_ord > 7} == {f"u{n}": 8 + n for n in range(5)}
