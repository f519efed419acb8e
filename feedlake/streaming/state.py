"""Keyed state of the streams: what is known of a URL, kept from batch to batch.

Each stream is a keyed processor with its own state in the state store: known URLs with
their retention, held-back stubs, and rows that wait for their page. A batch reads its own
rows and the state of their keys, nothing of earlier batches; stubs are kept and read by the bucket, of
some URLs each. State that has served its purpose is cleared, so the store holds open cases only.

Rows of one key are folded per Arrow batch before the shuffle: the task that owns a hot
key gets one row per batch and moment for it, not all of them.

A processor is called once per key, and most keys have one or two rows in a batch, so processors
take plain rows and ask the store no more than they need: a frame per key, or a question to the store,
costs more than all else. Within a processor and in its state, times are microseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

from feedlake.functions import keys
from feedlake.operators.queue import PENDING, SYNCED, with_url

ENTRY = "entry"  # kind of a row that brings a URL; SYNCED is the kind of one that reports its note
SEEN, CAPTURED = "seen", "captured"
ROW, PAGE = "row", "page"

KEYED = "url_key string, kind string, ts timestamp, feed_ord long, entry_ord long, url string"
FOUND = "url_key string, url string, feed_ord long, entry_ord long, discovered timestamp, status string"
SIGHTING = "url_key string, first_seen timestamp, last_seen timestamp, body_chars long, event_id long, captured boolean"
STUB = "url_key string, first_seen timestamp, last_seen timestamp, body_chars long, captured boolean"
DONE = "url_key string, queue_ord long, done_at timestamp"

DAY = 24 * 60 * 60 * 1_000_000

# --- Fixed values: a job finds the state of its held-back stubs only by the numbers it began with -----
SHELVES, BUCKETS = 1 << 12, 1 << 4  # calls of the processor at most, and buckets of stubs for each of them
# -------------------------------------------------------------------------------------------------------


def keyed(events: DataFrame, processor: StatefulProcessor, out: str, mode: str, time_mode: str = "None", by: str = "url_key") -> DataFrame:
    """Events through a processor by key; it sees and returns times as microseconds, outside they are time stamps."""
    times = [field.name for field in events.schema if field.dataType == TimestampType()]
    fields = StructType.fromDDL(out)
    plain = ", ".join(f"{f.name} {'long' if f.dataType == TimestampType() else f.dataType.simpleString()}" for f in fields)
    rows = events.withColumns({name: F.unix_micros(name) for name in times})
    found = rows.groupBy(by).transformWithState(processor, plain, mode, time_mode)
    return found.withColumns({f.name: F.timestamp_micros(f.name) for f in fields if f.dataType == TimestampType()})


# --- Known URLs: found once, known until their retention is over ------------------


def entry_events(entries: DataFrame, seen_at: str = "seen_at") -> DataFrame:
    """Landed entries (link, feed_ord, entry_ord and the time of their poll) as keyed events."""
    link = F.col("link")
    return with_url(entries, "link").select(
        keys.discovery_key(link).alias("url_key"),
        F.lit(ENTRY).alias("kind"),
        F.col(seen_at).cast("timestamp").alias("ts"),
        F.col("feed_ord").cast("long").alias("feed_ord"),
        F.col("entry_ord").cast("long").alias("entry_ord"),
        link.alias("url"),
    )


def synced_events(done: DataFrame, url: str = "url", synced_at: str = "synced_at") -> DataFrame:
    """Rows that became notes, as keyed events."""
    none = F.lit(None)
    return with_url(done, url).select(
        keys.discovery_key(F.col(url)).alias("url_key"),
        F.lit(SYNCED).alias("kind"),
        F.col(synced_at).cast("timestamp").alias("ts"),
        none.cast("long").alias("feed_ord"),
        none.cast("long").alias("entry_ord"),
        none.cast("string").alias("url"),
    )


def first_of_moment(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key, kind and time: the first in feed order."""
    for rows in frames:
        rows = rows.sort_values(["feed_ord", "entry_ord"], kind="stable")
        yield rows.drop_duplicates(["url_key", "kind", "ts"])


def last_if_missing(*values) -> tuple:
    """Key of an order in which missing values come last."""
    return tuple((value is None, 0 if value is None else value) for value in values)


class KnownUrls(StatefulProcessor):
    """Finds each URL once; a synced one is forgotten when its retention is over.

    Events of a key are taken in the order of their time, then of feeds. An entry is new if its URL is
    not known at its time. A pending URL stays known; a synced one until ``keep_days`` after.
    Whether that is over is told by the event's own time, so results do not depend on where
    batches end; a timer at that time frees the state. An event without a time comes last of its
    batch, when every retention is over.
    """

    def __init__(self, keep_days: int):
        self.keep = keep_days * DAY if keep_days > 0 else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "status string, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: last_if_missing(r["ts"], r["kind"], r["feed_ord"], r["entry_ord"]))
        held = self.known.get()
        before = status, until = tuple(held) if held else (None, None)
        found = []
        for event in events:
            at = event["ts"]
            if status == SYNCED and until is not None and (at is None or at >= until):
                status, until = None, None
            if event["kind"] == ENTRY and status is None:
                found.append(Row(url_key=key[0], url=event["url"], feed_ord=event["feed_ord"], entry_ord=event["entry_ord"], discovered=at, status=PENDING))
                status = PENDING
            elif event["kind"] == SYNCED and status is not None:
                status, until = SYNCED, at + self.keep if self.keep and at is not None else None
        if before[1] != until:
            if before[1] is not None:
                self.handle.deleteTimer(before[1] // 1000)
            if until is not None:
                self.handle.registerTimer(until // 1000)
        if status is None and held:
            self.known.clear()
        elif (status, until) != before:
            self.known.update((status, until))
        return iter(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def new_urls(events: DataFrame, keep_days: int, lateness: str = "1 day") -> DataFrame:
    """New URLs of a stream of entry and synced events, each with the first row that brought it.

    Events may come up to ``lateness`` behind the newest of earlier batches; older ones are left out.
    """
    folded = events.withWatermark("ts", lateness).mapInPandas(first_of_moment, KEYED)
    return keyed(folded, KnownUrls(keep_days), FOUND, "Append", "EventTime")


# --- Held-back stubs: kept until captured ---------------------------------------


def folded_sightings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key: first and last sighting, the latest length, and whether it was captured."""
    for rows in frames:
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        seen = rows[rows["kind"] == SEEN].groupby("url_key")
        out = pd.DataFrame(
            {
                "first_seen": seen["ts"].first(),
                "last_seen": seen["ts"].last(),
                "body_chars": seen["body_chars"].last(),
                "event_id": seen["event_id"].last(),
            }
        )
        captured = rows.assign(captured=rows["kind"] == CAPTURED).groupby("url_key")["captured"].any()
        yield captured.to_frame().join(out).reset_index()[[c.split()[0] for c in SIGHTING.split(", ")]]


def later(held: tuple | None, seen: tuple | None) -> tuple | None:
    """Two states of a stub as one: the first sighting of both, and all else of the latest; ``held`` if they are equally late."""
    if held is None or seen is None:
        return seen if held is None else held
    latest = max(held, seen, key=lambda s: (s[1], s[3]))
    return (min(held[0], seen[0]), *latest[1:])


class HeldStubs(StatefulProcessor):
    """Held-back stubs from their first sighting until they are captured, which takes them out of the state.

    The key is a shelf of buckets of URLs, and the state of a bucket all stubs that are held back in it, as
    one array per column, so that a call and its questions to the store serve many URLs. Only buckets with a
    row in the batch are written, and only these are read, unless they are a good part of the shelf:
    then one question reads it whole.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = "url_key array<string>, first_seen array<long>, last_seen array<long>, body_chars array<long>, event_id array<long>"
        self.stub = handle.getMapState("stub", "bucket int", arrays)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: dict[int, dict] = {}
        gone = set()
        for _, bucket, url, captured, first, last, chars, event in rows:
            urls = seen.setdefault(bucket, {})
            urls[url] = later(urls.get(url), None if first is None else (first, last, chars, event))
            if captured:
                gone.add(url)
        if 4 * len(seen) > self.buckets:
            shelf = {bucket: arrays for (bucket,), arrays in self.stub.iterator()}
        else:
            shelf = {bucket: self.stub.getValue((bucket,)) for bucket in seen}
        changes = []
        for bucket, urls in seen.items():
            before = shelf.get(bucket)
            stubs = {url: tuple(one) for url, *one in zip(*before)} if before else {}
            changed = False
            for url, sighting in urls.items():
                held = stubs.get(url)
                now = later(held, sighting)
                captured = now is None or url in gone
                if not captured:
                    stubs[url], changed = now, True
                elif held:
                    del stubs[url]
                    changed = True
                first, last, chars, _ = now or (None,) * 4
                changes.append(Row(url_key=url, first_seen=first, last_seen=last, body_chars=chars, captured=captured))
            if changed and stubs:
                self.stub.updateValue((bucket,), ([*stubs], *map(list, zip(*stubs.values()))))
            elif changed:
                self.stub.removeKey((bucket,))
        return iter(changes)

    def close(self) -> None:
        pass


def stub_changes(events: DataFrame) -> DataFrame:
    """State of each key that a batch touches, after it.

    Sightings of keys that have a note must be left out before, as the vault lookup of a sync
    leaves them out: a captured key has no state that would tell.
    """
    folded = events.select("url_key", "kind", "ts", "event_id", "body_chars").mapInPandas(folded_sightings, SIGHTING)
    place = F.pmod(F.xxhash64("url_key"), F.lit(SHELVES * BUCKETS))
    rows = folded.select(
        (place % SHELVES).cast("int").alias("shelf"), F.floor(place / SHELVES).cast("int").alias("bucket"),
        "url_key", "captured", "first_seen", "last_seen", "body_chars", "event_id",
    )
    return keyed(rows, HeldStubs(BUCKETS), STUB, "Update", by="shelf")


# --- Rows that wait for their page ------------------------------------------------


class WaitingRows(StatefulProcessor):
    """Keeps a row until its page lands, however many batches later, and completes it once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "queue_ord long")
        self.landed = handle.getValueState("landed", "ts long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own, pages = set(), []
        for row in rows:
            if row["kind"] == ROW:
                own.add(row["queue_ord"])
            elif row["kind"] == PAGE:
                pages.append(row["ts"])
        held = self.landed.get()
        if not held and not pages:
            if own:
                self.waiting.appendList([(n,) for n in sorted(own, key=last_if_missing)])
            return iter(())
        if held:
            landed = held[0]
        else:
            landed = min((ts for ts in pages if ts is not None), default=None)
            self.landed.update((landed,))
            # Rows wait only until the page lands, so there are none in later batches.
            waited = {one[0] for one in self.waiting.get()}
            if waited:
                self.waiting.clear()
            own |= waited
        return iter([Row(url_key=key[0], queue_ord=n, done_at=landed) for n in sorted(own, key=last_if_missing)])

    def close(self) -> None:
        pass


def completed_rows(events: DataFrame) -> DataFrame:
    """Rows whose page has landed, from a stream of both (url_key, kind, ts, queue_ord).

    Only the fact that a page landed is state; its text is read when the row is built.
    """
    return keyed(events.select("url_key", "kind", "ts", "queue_ord"), WaitingRows(), DONE, "Append")

