"""Queries over streams with keyed state: three polls each, over what landed in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake import session
from feedlake.functions import keys, text
from feedlake.queries import inputs as i
from feedlake.queries.articles import SHOWN, shown
from feedlake.queries.discovery import rendered_feeds
from feedlake.streaming import jobs, state

POLLS = 3
RETENTION_DAYS = 3
POLL_DAY = "2026-03-2{} 12:00:00"


def polled(spark: SparkSession, rows: DataFrame, poll: Column, run: Callable[[DataFrame, int, str], object]) -> str:
    """Land the rows of one poll after the other and run a job on the landing folder each time."""
    path = session.state_dir(spark, "stream-polls")
    marked = rows.withColumn("_poll", poll.cast("int"))
    for number in range(POLLS):
        marked.filter(F.col("_poll") == number).drop("_poll").write.parquet(f"{path}/landed/poll={number}")
        landed = spark.readStream.schema(rows.schema).parquet(f"{path}/landed/*")
        run(landed, number, f"{path}/job")
    return f"{path}/job"


def third_of_month(ts: str) -> Column:
    """Poll of an event: the third of January 2024 it fell in."""
    return F.least(F.floor((F.dayofmonth(ts) - 1) / 10), F.lit(POLLS - 1))


def feed_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Feed files by the poll they land in; each also lands again in the next one, as feeds keep items."""
    first = F.regexp_extract("xml", r"https?://[^<\"]*?/[a-z]+/(\d+)", 1)
    files = rendered_feeds(spark, sf_dir).select(
        F.conv(F.substring(F.sha2(F.concat_ws("/", "source", "lang", "window"), 256), 1, 12), 16, 10).cast("long").alias("feed_ord"),
        "xml",
        F.explode(F.array(F.col("window") % POLLS, F.col("window") % POLLS + 1)).alias("poll"),
    )
    return files.filter(first != ""), F.col("poll")


def stream_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files polled as they land; every item is found once, by the poll that saw it first."""
    files, poll = feed_files(spark, sf_dir)
    run = lambda landed, number, path: jobs.poll_files(landed, "xml", POLL_DAY.format(number), path, 90)
    path = polled(spark, files, poll, run)
    found = jobs.written(spark, f"{path}/found", state.FOUND)
    return found.select("url_key", "url", "feed_ord", "entry_ord", text.iso_time(F.col("discovered")).alias("discovered"))


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL per user: purchases report it as synced, all else as seen; it is new again after its retention.

    Events without a time land in the last poll; those without a user have no URL.
    """

    def run(landed: DataFrame, number: int, path: str) -> None:
        link = F.concat(F.lit("https://e.example/User-"), F.col("user_id").cast("string"))
        events = landed.select(link.alias("link"), (F.col("event_type") == "purchase").alias("done"), F.lit(0).alias("feed_ord"),
                               F.col("event_id").alias("entry_ord"), F.col("ts").alias("seen_at"))
        synced = events.filter("done").select(F.upper("link").alias("url"), F.col("seen_at").alias("synced_at"))
        jobs.discover(events.filter("NOT done"), synced, path, RETENTION_DAYS)

    events = i.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = polled(spark, events, F.coalesce(third_of_month("ts"), F.lit(POLLS - 1)), run)
    found = jobs.written(spark, f"{path}/found", state.FOUND)
    return found.select("url_key", "entry_ord", text.iso_time(F.col("discovered")).alias("discovered"), "status")


def stream_stub_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stubs held back after three polls, read from the state store; captured ones have left it."""
    path = polled(
        spark, i.sightings(spark, sf_dir), third_of_month("ts"), lambda landed, number, path: jobs.hold_stubs(landed, path)
    )
    return shown(jobs.held_stubs(spark, path))


def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows that complete in the poll by which both they and their page have come."""
    pages = i.table(spark, sf_dir, "pages").select("page_id", keys.discovery_key(F.col("url")).alias("url_key"), "url")
    at = F.lit("2026-03-20 12:00:00").cast("timestamp")
    rows = pages.select("url_key", F.lit(state.ROW).alias("kind"), at.alias("ts"), F.col("page_id").alias("queue_ord"), (F.col("page_id") % 3).alias("poll"))
    again = rows.withColumns({"queue_ord": F.col("queue_ord") + 1_000_000_000, "poll": F.col("poll") + 1}).filter("poll < 3")
    landed = pages.filter(F.col("url").startswith("https:")).select(
        "url_key", F.lit(state.PAGE).alias("kind"), at.alias("ts"), F.lit(None).cast("long").alias("queue_ord"), (F.floor(F.col("page_id") / 3) % 3).alias("poll")
    )
    events = rows.unionByName(again).unionByName(landed)
    path = polled(spark, events, F.col("poll"), lambda landed, number, path: jobs.complete_rows(landed, path))
    done = jobs.written(spark, f"{path}/done", state.DONE)
    return done.select("url_key", "queue_ord", F.col("batch_id").alias("poll"))


QUERIES = {f.__name__: f for f in (stream_poll, stream_retention, stream_stub_polls, stream_retry)}

ORACLES = {
    "stream_poll": i.with_cte(i.SITE_PAGES) + """,
files AS (
  SELECT page_id, url, page_id // 20 AS "window",
    CAST('0x' || substr(sha256(source || '/' || lang || '/' || (page_id // 20)), 1, 12) AS BIGINT) AS feed_ord,
    row_number() OVER (PARTITION BY source, lang, page_id // 20 ORDER BY page_id) - 1 AS entry_ord
  FROM site_pages),
landed AS (
  SELECT *, "window" % 3 + again AS poll FROM files CROSS JOIN (SELECT unnest([0, 1]) AS again) WHERE "window" % 3 + again < 3)
SELECT lower(url) AS url_key, url, feed_ord, entry_ord, '2026-03-2' || poll || 'T12:00:00+00:00' AS discovered
FROM landed QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY poll, feed_ord, entry_ord) = 1""",
    "stream_retention": f"""
WITH RECURSIVE ordered AS (
  SELECT user_id, event_id, ts, event_type = 'purchase' AS done,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id) AS nr
  FROM events),
steps AS (
  SELECT user_id, 0::BIGINT AS nr, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS status,
    NULL::TIMESTAMP AS until, false AS fresh
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, nr, event_id, ts,
    CASE WHEN NOT done AND held IS NULL THEN 'pending' WHEN done AND held IS NOT NULL THEN 'synced' ELSE held END,
    CASE WHEN done AND held IS NOT NULL THEN ts + INTERVAL {RETENTION_DAYS} DAY WHEN held IS NOT NULL THEN until END,
    NOT done AND held IS NULL
  FROM (
    SELECT o.*, s.until, CASE WHEN s.until IS NULL OR o.ts < s.until THEN s.status END AS held
    FROM steps s JOIN ordered o ON o.user_id = s.user_id AND o.nr = s.nr + 1))
SELECT lower('https://e.example/User-' || user_id) AS url_key, event_id AS entry_ord,
  strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS discovered, 'pending' AS status
FROM steps WHERE fresh""",
    "stream_stub_polls": SHOWN,
    "stream_retry": """
WITH rows_ AS (
  SELECT lower(url) AS url_key, url, page_id AS queue_ord, page_id % 3 AS poll, page_id // 3 % 3 AS landed FROM pages
  UNION ALL
  SELECT lower(url), url, page_id + 1000000000, page_id % 3 + 1, page_id // 3 % 3 FROM pages WHERE page_id % 3 < 2)
SELECT url_key, queue_ord, greatest(poll, landed) AS poll FROM rows_ WHERE url LIKE 'https:%'""",
}
