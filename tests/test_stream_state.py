"""Streams with keyed state over several batches, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F
from pyspark.sql.streaming import DataStreamWriter

from feedlake import session
from feedlake.queries import streams
from feedlake.streaming import jobs, state

START = datetime(2026, 1, 1)
ENTRY = "link string, feed_ord long, entry_ord long, seen_at timestamp"
DONE = "url string, synced_at timestamp"
SIGHTING = "url_key string, kind string, ts timestamp, event_id long, body_chars long"
WAIT = "url_key string, kind string, ts timestamp, queue_ord long"


def at(day, hour=0):
    return START + timedelta(days=day, hours=hour)


def land(spark, rows, schema, path, number):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/batch{number}")


def source(spark, schema, path):
    return spark.readStream.schema(schema).parquet(f"{path}/*")


def state_rows(spark, checkpoint, variable):
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return reader.load(f"{checkpoint}").count()


def plain_discovery(events, keep_days):
    """New URLs by a loop over events in order of time; retention counts from a row's sync."""
    known, found = {}, []
    for ts, kind, feed, entry, link in sorted(events, key=lambda e: (e[0], e[1], e[2] or 0, e[3] or 0)):
        key = link.lower()
        status, until = known.get(key, (None, None))
        if until is not None and ts >= until:
            status = None
        if kind == "entry" and status is None:
            found.append((link, feed, entry, ts))
            known[key] = ("pending", None)
        elif kind == "synced" and status is not None:
            known[key] = ("synced", ts + timedelta(days=keep_days) if keep_days > 0 else None)
    return found


def test_urls_are_found_once_until_their_retention_is_over(spark, tmp_path):
    random.seed(31)
    for keep_days in (10, 0):
        landed, done, out = (str(tmp_path / f"{name}{keep_days}") for name in ("landed", "done", "out"))
        events = []
        for poll in range(4):
            now = at(7 * poll)
            rows = {(f"http://{random.choice('AaBbc')}/{random.randrange(6)}", random.randrange(3), n, now) for n in range(25)}
            rows |= {("http://hot", 0, n, now) for n in range(100, 160)} | {("", 0, 200, now), (None, 0, 201, now)}
            synced = [(f"HTTP://{random.choice('abc')}/{random.randrange(6)}", at(7 * poll, 2)) for _ in range(8)]
            land(spark, list(rows), ENTRY, landed, poll)
            land(spark, synced, DONE, done, poll)
            events += [(r[3], "entry", r[1], r[2], r[0]) for r in rows if r[0]]
            events += [(s[1], "synced", None, None, s[0]) for s in synced]
            jobs.discover(source(spark, ENTRY, landed), source(spark, DONE, done), out, keep_days)
            found = jobs.written(spark, f"{out}/found", state.FOUND).collect()
            mine = {(r.url, r.feed_ord, r.entry_ord, r.discovered) for r in found}
            assert len(mine) == len(found) and mine == set(plain_discovery(events, keep_days))


def test_retention_takes_events_without_time_or_user_as_its_sql_does(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    random.seed(33)
    events = [
        (n, None if random.random() < 0.1 else at(random.randrange(31), random.randrange(24)), random.choice([None, *range(12)]),
         random.choice(["purchase", "view", "view", None]))
        for n in range(400)
    ]
    landed = f"{tmp_path}/events.parquet"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    dated = [(n, ts and ts.replace(year=2024), user, kind) for n, ts, user, kind in events]
    spark.createDataFrame(dated, schema).withColumns({"value": F.lit(1.0), "props": F.lit("")}).write.parquet(landed)
    found = streams.stream_retention(spark, str(tmp_path))
    mine = sorted(tuple(map(str, r)) for r in found.select("url_key", "entry_ord", "discovered", "status").collect())
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{landed}/*.parquet'")
    theirs = duckdb.execute(f"SELECT url_key, entry_ord, discovered, status FROM ({streams.ORACLES['stream_retention']})").fetchall()
    assert mine == sorted(tuple(map(str, r)) for r in theirs)
    assert any(r[2] == "None" for r in mine)


def test_timers_free_what_is_past_retention(spark, tmp_path):
    landed, done, out = (str(tmp_path / name) for name in ("landed", "done", "out"))
    for poll, (link, synced) in enumerate([("http://a", "http://a"), ("http://b", "http://none"), ("http://c", "http://none"), ("http://d", "http://none")]):
        land(spark, [(link, 0, 0, at(20 * poll))], ENTRY, landed, poll)
        land(spark, [(synced, at(20 * poll, 1))], DONE, done, poll)
        jobs.discover(source(spark, ENTRY, landed), source(spark, DONE, done), out, 10)
    # a was synced and is past its retention; the others are pending and stay known.
    assert state_rows(spark, f"{out}/checkpoint", "known") == 3


def test_a_batch_reads_no_files_of_earlier_ones(spark, tmp_path):
    landed, done, out = (str(tmp_path / name) for name in ("landed", "done", "out"))
    for poll in range(3):
        land(spark, [(f"http://{n}", 0, n, at(poll)) for n in range(10 * (poll + 1))], ENTRY, landed, poll)
        land(spark, [("http://none", at(poll))], DONE, done, poll)
        progress = jobs.discover(source(spark, ENTRY, landed), source(spark, DONE, done), out, 90)
        # 10 more links per poll: the batch reads this poll's rows alone, and only new ones come out.
        assert progress["rows_read"] == 10 * (poll + 1) + 1
        assert jobs.written(spark, f"{out}/found", state.FOUND).count() == 10 * (poll + 1)


def test_stubs_leave_the_state_when_they_are_captured(spark, tmp_path):
    random.seed(32)
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    events, nr = [], 0
    for batch in range(4):
        rows = []
        for _ in range(60):
            nr += 1
            kind = "captured" if random.random() < 0.15 else "seen"
            rows.append((f"u{random.randrange(25)}", kind, at(batch, nr % 20), nr, nr * 10))
        rows += [("hot", "seen", at(batch, n % 24), 1000 * (batch + 1) + n, n) for n in range(200)]
        events += rows
        land(spark, rows, SIGHTING, landed, batch)
        jobs.hold_stubs(source(spark, SIGHTING, landed), out)
        gone = {key for key, kind, *_ in events if kind == "captured"}
        expected = {}
        for key, kind, ts, event, chars in sorted(events, key=lambda e: (e[2], e[3])):
            if kind == "seen" and key not in gone:
                expected[key] = (expected.get(key, (ts,))[0], ts, chars)
        stubs = {r.url_key: (r.first_seen, r.last_seen, r.body_chars) for r in jobs.held_stubs(spark, out).collect()}
        assert stubs == expected
    assert state_rows(spark, f"{out}/checkpoint", "stub") == len(expected)


def test_stubs_that_share_a_bucket_are_held_and_captured_on_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SHELVES", 1)
    monkeypatch.setattr(state, "BUCKETS", 2)
    random.seed(34)
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    urls, events = [f"u{n}" for n in range(40)], []
    for batch in range(4):
        rows = [(random.choice(urls), random.choice(["seen"] * 7 + ["captured"]), at(batch, n % 6), 100 * batch + n, n) for n in range(60)]
        if batch == 3:
            rows += [(url, "captured", at(batch), 1000 + n, 0) for n, url in enumerate(urls) if n % 2]
        events += rows
        land(spark, rows, SIGHTING, landed, batch)
        jobs.hold_stubs(source(spark, SIGHTING, landed), out)
        gone = {url for url, kind, *_ in events if kind == "captured"}
        expected = {}
        for url, kind, ts, event, chars in sorted(events, key=lambda e: (e[2], e[3])):
            if kind == "seen" and url not in gone:
                expected[url] = (expected.get(url, (ts,))[0], ts, chars)
        stubs = [(r.url_key, (r.first_seen, r.last_seen, r.body_chars)) for r in jobs.held_stubs(spark, out).collect()]
        assert dict(stubs) == expected and len(stubs) == len(expected)
    assert len(expected) > 2 and state_rows(spark, f"{out}/checkpoint", "stub") == 2
    land(spark, [(url, "captured", at(4), 2000, 0) for url in urls], SIGHTING, landed, 4)
    jobs.hold_stubs(source(spark, SIGHTING, landed), out)
    assert state_rows(spark, f"{out}/checkpoint", "stub") == jobs.held_stubs(spark, out).count() == 0


def test_a_row_completes_once_when_its_page_lands(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    batches = [
        [("a", "row", at(0), 1), ("b", "row", at(0), 2), ("c", "page", at(0), None)],
        [("a", "row", at(1), 3), ("c", "row", at(1), 4)],
        [("a", "page", at(2), None), ("a", "page", at(2, 1), None)],
        [("a", "page", at(3), None), ("a", "row", at(3), 5), ("x", "page", at(3), None)],
    ]
    for number, rows in enumerate(batches):
        land(spark, rows, WAIT, landed, number)
        jobs.complete_rows(source(spark, WAIT, landed), out)
    done = {(r.url_key, r.queue_ord): (r.done_at, r.batch_id) for r in jobs.written(spark, f"{out}/done", state.DONE).collect()}
    assert done == {
        ("c", 4): (at(0), 1),
        ("a", 1): (at(2), 2),
        ("a", 3): (at(2), 2),
        ("a", 5): (at(2), 3),
    }
    assert state_rows(spark, f"{out}/checkpoint", "landed") == 3


def test_jobs_run_in_a_session_with_another_state_store(spark, tmp_path):
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    former = spark.conf.get(session.STATE_STORE)
    landing = tmp_path / "feeds"
    landing.mkdir()
    (landing / "0.xml").write_text("<rss><channel><item><title>t</title><link>http://a</link></item></channel></rss>")
    paths = {name: str(tmp_path / name) for name in ("waits", "seen", "links", "done", "o1", "o2", "o3", "o4")}
    land(spark, [("a", "row", at(0), 1), ("a", "page", at(0), None)], WAIT, paths["waits"], 0)
    land(spark, [("u", "seen", at(0), 1, 10)], SIGHTING, paths["seen"], 0)
    land(spark, [("http://a", 0, 0, at(0))], ENTRY, paths["links"], 0)
    land(spark, [("http://a", at(0, 1))], DONE, paths["done"], 0)
    spark.conf.set(session.STATE_STORE, other)
    try:
        jobs.complete_rows(source(spark, WAIT, paths["waits"]), paths["o1"])
        jobs.hold_stubs(source(spark, SIGHTING, paths["seen"]), paths["o2"])
        jobs.discover(source(spark, ENTRY, paths["links"]), source(spark, DONE, paths["done"]), paths["o3"], 10)
        jobs.poll_feeds(spark, str(landing), f"{at(0)}", paths["o4"], 10)
        assert spark.conf.get(session.STATE_STORE) == other
        assert jobs.written(spark, f"{paths['o1']}/done", state.DONE).count() == 1
        assert [r.url_key for r in jobs.held_stubs(spark, paths["o2"]).collect()] == ["u"]
        assert jobs.written(spark, f"{paths['o3']}/found", state.FOUND).count() == 1
        assert jobs.written(spark, f"{paths['o4']}/found", state.FOUND).count() == 1
    finally:
        spark.conf.set(session.STATE_STORE, former)


class Store:
    """A state variable that notes what it is asked."""

    def __init__(self, value=None):
        self.value, self.asked = value, []

    def get(self):
        self.asked.append("get")
        return self.value

    def __getattr__(self, name):
        return lambda *_: self.asked.append(name)


def test_a_key_asks_the_store_no_more_than_it_needs():
    noon = 12 * 60 * 60 * 1_000_000
    entry = Row(url_key="a", kind="entry", ts=noon, feed_ord=None, entry_ord=2, url="A")
    undated = Row(url_key="a", kind="synced", ts=None, feed_ord=None, entry_ord=None, url=None)
    for held, rows, found, asked in (
        (None, [entry], 1, ["get", "update"]),
        (("pending", None), [entry], 0, ["get"]),
        (("synced", noon + 1), [entry, entry], 0, ["get"]),
        (("synced", noon), [entry], 1, ["get", "update"]),
        (None, [undated], 0, ["get"]),
        (("pending", None), [undated], 0, ["get", "update"]),
    ):
        known = state.KnownUrls(10)
        known.known, known.handle = Store(held), Store()
        assert len(list(known.handleInputRows(("a",), iter(rows), None))) == found and known.known.asked == asked
    waiting = state.WaitingRows()
    waiting.landed, waiting.waiting = Store((noon,)), Store([])
    done = list(waiting.handleInputRows(("a",), iter([Row(url_key="a", kind="row", ts=noon, queue_ord=n) for n in (3, 1, 3)]), None))
    assert [(r.queue_ord, r.done_at) for r in done] == [(1, noon), (3, noon)]
    assert waiting.landed.asked == ["get"] and waiting.waiting.asked == []


class Shelf(dict):
    """Map state that notes what it is asked."""

    def __init__(self, values):
        super().__init__(values)
        self.asked = []

    def iterator(self):
        self.asked.append("iterator")
        return iter([((bucket,), value) for bucket, value in self.items()])

    def getValue(self, key):
        self.asked.append("getValue")
        return self.get(*key)

    def updateValue(self, key, value):
        self.asked.append("updateValue")
        self[key[0]] = value

    def removeKey(self, key):
        self.asked.append("removeKey")
        del self[key[0]]


def test_the_store_is_asked_by_bucket_not_by_stub():
    row = Row("shelf", "bucket", "url_key", "captured", "first_seen", "last_seen", "body_chars", "event_id")
    hour = 60 * 60 * 1_000_000
    held = {0: (["a", "b"], [hour, hour], [hour, 2 * hour], [10, None], [1, 2]), 1: (["z"], [0], [0], [9], [9])}
    seen = [row(0, 0, "c", False, 3 * hour, 4 * hour, 30, 5), row(0, 0, "a", False, 0, hour, 11, 1), row(0, 0, "c", False, hour, hour, 31, 3)]
    gone = [row(0, 0, url, True, None, None, None, None) for url in "abx"]
    lost = ("x", None, None, None, True)
    for rows, changed, asked, after in (
        # What is held stays where a sighting is no later; of c the earlier row is its first sighting, the later one its length.
        (seen, [("c", hour, 4 * hour, 30, False), ("a", 0, hour, 10, False)], "updateValue",
         {0: (["a", "b", "c"], [0, hour, hour], [hour, 2 * hour, 4 * hour], [10, None, 30], [1, 2, 5]), 1: held[1]}),
        (gone, [("a", hour, hour, 10, True), ("b", hour, 2 * hour, None, True), lost], "removeKey", {1: held[1]}),
        (gone[2:], [lost], None, held),
        ([*seen, gone[0], gone[1]], [("c", hour, 4 * hour, 30, False), ("a", 0, hour, 10, True), ("b", hour, 2 * hour, None, True)], "updateValue",
         {0: (["c"], [hour], [4 * hour], [30], [5]), 1: held[1]}),
    ):
        for buckets, read in ((3, "iterator"), (4, "getValue")):
            stubs = state.HeldStubs(buckets)
            stubs.stub = Shelf(held)
            assert [tuple(r) for r in stubs.handleInputRows((0,), iter(rows), None)] == changed
            assert stubs.stub == after and stubs.stub.asked == [read, *([asked] if asked else [])]


def test_stores_reserve_no_disk(spark, tmp_path, monkeypatch):
    start, seen = DataStreamWriter.start, []

    def noted(writer, *args, **kwargs):
        seen.append(spark.conf.get(session.RESERVES, None))
        return start(writer, *args, **kwargs)

    monkeypatch.setattr(DataStreamWriter, "start", noted)
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    land(spark, [("a", "row", at(0), 1), ("a", "page", at(0), None)], WAIT, landed, 0)
    jobs.complete_rows(source(spark, WAIT, landed), out)
    assert seen == ["false"] and spark.conf.get(session.RESERVES, None) is None


FEED = "<rss><channel><title>f</title>{}</channel></rss>"
ITEM = "<item><title>T{0}</title><link>http://site/{0}</link></item>"


def test_feed_files_are_polled_item_by_item_once(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    polls = [
        {"0.xml": FEED.format(ITEM.format(1) + ITEM.format(2)), "1.xml": "<rss><channel>"},
        {"2.xml": FEED.format(ITEM.format(2) + ITEM.format(3))},
        {"3.xml": FEED.format(ITEM.format("1") + "<item><title>no link</title></item>"), "4.xml": "not a feed"},
    ]
    health = []
    for poll, files in enumerate(polls):
        for name, text in files.items():
            (landing / name).write_text(text)
        health.append(jobs.poll_feeds(spark, str(landing), f"{at(poll)}", out, 90))
    found = jobs.written(spark, f"{out}/found", state.FOUND).collect()
    assert {(r.url, r.feed_ord, r.entry_ord, r.discovered) for r in found} == {
        ("http://site/1", 0, 0, at(0)), ("http://site/2", 0, 1, at(0)), ("http://site/3", 2, 1, at(1)),
    }
    assert [(h["n_files"], h["n_unreadable"]) for h in health] == [(2, 1), (1, 0), (2, 1)]
    assert [h["n_items"] for h in health] == [2, 2, 2]
