"""Whole runs: discovery, direct sync and drain, and the two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake import session
from feedlake.functions import text
from feedlake.plans import discover as discover_plan, drain as drain_plan, sync as sync_plan
from feedlake.queries import inputs as i
from feedlake.queries.articles import SHOWN, shown
from feedlake.queries.discovery import PUBLISHED
from feedlake.queries.texts import SAFE
from feedlake.streaming import discover as discover_stream, stubs as stub_stream


def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = i.site_entries(spark, sf_dir)
    return entries.withColumn("published_parsed", text.parse_feed_time(F.col("published_raw")))


def stored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the Spanish pages, their links in capitals."""
    pages = i.site_pages(spark, sf_dir).filter(F.col("lang") == "es")
    return pages.select(
        F.format_string("vault/%s", "source").alias("vault_folder"),
        text.sanitize_title(F.col("title")).alias("note_name"),
        F.concat(F.lit("---\nlink: "), F.upper("url"), F.lit("/\n---\n")).alias("note_text"),
    )


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that could be fetched: those behind https."""
    return i.table(spark, sf_dir, "pages").filter(F.col("url").startswith("https:"))


def discover_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue after discovery: orders pruned, English pages known, all others appended."""
    pages = i.site_pages(spark, sf_dir).filter(F.col("lang") == "en")
    known = pages.select(
        (F.col("page_id") - 1_000_000_000).alias("queue_ord"),
        F.upper("url").alias("url"),
        "title",
        F.lit("").alias("author"),
        F.lit("").alias("published"),
        F.col("source").alias("feed"),
        F.lit(None).cast("string").alias("parser"),
        F.lit(i.RUN_TS).cast("timestamp").alias("discovered"),
        F.lit("synced").alias("status"),
        F.lit(None).cast("timestamp").alias("synced_at"),
    )
    queue = i.order_queue(spark, sf_dir).unionByName(known)
    feeds = i.site_feeds(spark, sf_dir)
    run = discover_plan.discover(feeds, parsed_entries(spark, sf_dir), queue, i.RUN_TS, i.KEEP_DAYS)
    return run["queue"].select("queue_ord", "url", "status", "feed")


def sync_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a direct sync of all entries writes and holds back."""
    empty = spark.createDataFrame([], "url_key string, url string, title string, source string, parser string, "
                                      "published string, vault_folder string, body_chars long, "
                                      "first_seen timestamp, last_seen timestamp")  # fmt: skip
    run = sync_plan.sync(
        i.site_feeds(spark, sf_dir),
        parsed_entries(spark, sf_dir),
        stored_notes(spark, sf_dir),
        landed_pages(spark, sf_dir),
        empty,
        i.PAGE_RUN_TS,
    )
    notes = run["notes"].select(
        "feed_ord",
        "entry_ord",
        F.lit("note").alias("route"),
        F.col("rel_path").alias("path"),
        F.substring_index("note_text", "\n# Content\n", 1).alias("head"),
        F.lit(-1).cast("long").alias("body_chars"),
    )
    held = run["stubs"].select(
        "feed_ord", "entry_ord", F.lit("stub").alias("route"), F.col("vault_folder").alias("path"), F.lit("").alias("head"), "body_chars"
    )
    return notes.unionByName(held)


def sync_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = sync_plan.preview(i.site_entries(spark, sf_dir), stored_notes(spark, sf_dir))
    return planned.select("feed_ord", "entry_ord", "rel_path")


def page_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page queued twice, asking for parsers known, missing and unheard of."""
    url = F.col("url")
    asked = (
        F.when(url.endswith(".html"), "default").when(url.endswith("#top"), "khoros")
        .when(url.contains("utm_source"), F.lit(None)).otherwise("unheard-of")
    )
    rows = i.site_pages(spark, sf_dir).select(
        F.col("page_id").alias("queue_ord"),
        "url",
        "title",
        F.lit(None).cast("string").alias("author"),
        F.lit("2024").alias("published"),
        F.col("source").alias("feed"),
        asked.alias("parser"),
        F.lit(i.RUN_TS).cast("timestamp").alias("discovered"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("synced_at"),
    )
    return rows.unionByName(rows.withColumn("queue_ord", F.col("queue_ord") + 1_000_000_000))


def drained(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    feeds = i.site_feeds(spark, sf_dir).join(
        landed_pages(spark, sf_dir).select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source")), "source", "left_semi"
    )
    return drain_plan.drain(
        page_queue(spark, sf_dir), feeds, stored_notes(spark, sf_dir), landed_pages(spark, sf_dir), i.PAGE_RUN_TS
    )


def drain_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = drained(spark, sf_dir)["queue"]
    return queue.select(
        "queue_ord", "status", F.coalesce(text.iso_time(F.col("synced_at")), F.lit("")).alias("synced_at")
    )


def drain_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = drained(spark, sf_dir)["notes"]
    return notes.select("seq", "rel_path", F.substring_index("note_text", "\n# Content\n", 1).alias("head"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; as a pattern, the path may name a file or a folder."""
    schema = i.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed entries, found once per URL by the streaming job."""
    stream = event_stream(spark, sf_dir)
    loud = F.col("event_type").isin("click", "view")
    url = F.format_string("https://e.example/%d/Item-%d", "user_id", F.floor("value"))
    entries = stream.select(
        F.when(loud, F.upper(url)).otherwise(url).alias("link"),
        F.lit(0).cast("long").alias("feed_ord"),
        F.col("event_id").alias("entry_ord"),
        F.col("ts").cast("timestamp").alias("seen_at"),
    )
    state = session.state_dir(spark, "stream-discover")
    discover_stream.discover_stream(entries, f"{state}/found", f"{state}/checkpoint").awaitTermination()
    return discover_stream.discovered(spark, f"{state}/found").select("url_key", "url", "entry_ord", "status")


def stream_stub_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stub life cycle kept as streaming state; the same rows as the batch manifest."""
    stream = event_stream(spark, sf_dir)
    state = session.state_dir(spark, "stream-stubs")
    stub_stream.stub_stream(i.sightings_of(stream), f"{state}/changes", f"{state}/checkpoint").awaitTermination()
    return shown(stub_stream.open_stubs(stub_stream.current_state(spark, f"{state}/changes")))


QUERIES = {
    f.__name__: f
    for f in (
        discover_run, sync_preview, sync_run, drain_queue, drain_notes, stream_discover, stream_stub_state,
    )
}

TITLES = SAFE.format("title")

HEAD = """'---' || chr(10) || 'link: ' || url || chr(10) || 'author: ' || {author} || chr(10)
    || 'published: ' || {published} || chr(10) || 'clipped: 2026-03-20T12:00:00+00:00' || chr(10)
    || 'source: ' || source || chr(10) || 'feed_kind: ' || {kind} || chr(10) || 'tags:' || chr(10) || '---' || chr(10)"""

# The feed's own text of a page is '<lang> text ', up to 400 times. French
# feeds name a parser that finds no body in these pages, so they use that text too.
SYNCED = f"""
fresh AS (
  SELECT p.*, f.feed_ord, f.vault_folder, {TITLES} AS safe,
    CASE WHEN (url LIKE 'https:%' AND p.lang <> 'fr') OR 8 * least(number, 400) - 1 >= 1500 THEN 'note' ELSE 'stub' END AS route,
    {HEAD.format(author="CASE WHEN p.lang IN ('en', 'fr') THEN 'writer-' || number ELSE '' END",
                 published=PUBLISHED.replace("lang", "p.lang"),
                 kind="CASE p.lang WHEN 'fr' THEN 'khoros' WHEN 'de' THEN 'default' ELSE 'wordpress' END")
            .replace("|| source ||", "|| p.source ||")} AS head
  FROM site_pages p JOIN site_feeds f ON f.source = p.source AND f.lang = p.lang WHERE p.lang <> 'es'),
spanish AS (
  SELECT DISTINCT 'vault/' || source AS vault_folder, {TITLES} AS safe FROM site_pages WHERE lang = 'es')"""

DRAINED = f"""
asked AS (
  SELECT *, 'vault/' || source AS vault_folder, {TITLES} AS safe,
    source IN (SELECT source FROM site_pages WHERE url LIKE 'https:%') AS known,
    CASE WHEN url LIKE '%.html' THEN 'default' WHEN url LIKE '%#top' THEN 'khoros'
      WHEN url LIKE '%utm_source%' THEN 'wordpress' ELSE 'unheard-of' END AS kind,
    url LIKE 'https:%' AND url NOT LIKE '%#top' AS has_body
  FROM site_pages)"""

ORACLES = {
    "discover_run": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS, i.ORDER_QUEUE) + """,
kept AS (
  SELECT queue_ord, url, status, feed FROM order_queue
  WHERE status = 'pending' OR synced_at >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY)
SELECT * FROM kept
UNION ALL
SELECT (SELECT max(queue_ord) FROM kept) + row_number() OVER (ORDER BY f.feed_ord, p.page_id), p.url, 'pending', p.source
FROM site_pages p JOIN site_feeds f ON f.source = p.source AND f.lang = p.lang WHERE p.lang <> 'en'""",
    "sync_preview": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS, SYNCED) + """
SELECT feed_ord, page_id AS entry_ord, vault_folder || '/' || safe AS rel_path FROM fresh""",
    "drain_queue": i.with_cte(i.SITE_PAGES, DRAINED) + """,
done AS (SELECT *, known AND (lang = 'es' OR has_body) AS synced FROM asked)
SELECT page_id + o AS queue_ord, CASE WHEN synced THEN 'synced' ELSE 'pending' END AS status,
  CASE WHEN synced THEN '2026-03-20T12:00:00+00:00' ELSE '' END AS synced_at
FROM done CROSS JOIN (SELECT unnest([0, 1000000000]) AS o)""",
    "drain_notes": i.with_cte(i.SITE_PAGES, DRAINED) + f""",
taken AS (SELECT DISTINCT vault_folder, safe FROM asked WHERE lang = 'es'),
written AS (
  SELECT a.*, row_number() OVER (PARTITION BY a.vault_folder, a.safe ORDER BY page_id)
    + CASE WHEN t.safe IS NULL THEN 0 ELSE 1 END AS n
  FROM asked a LEFT JOIN taken t ON t.vault_folder = a.vault_folder AND t.safe = a.safe
  WHERE known AND lang <> 'es' AND has_body)
SELECT page_id AS seq, vault_folder || '/' || safe || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS rel_path,
  {HEAD.format(author="''", published="'2024'", kind="kind")} AS head
FROM written""",
    "sync_run": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS, SYNCED) + """,
named AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.vault_folder, f.safe ORDER BY feed_ord, page_id)
    + CASE WHEN s.safe IS NULL THEN 0 ELSE 1 END AS n
  FROM fresh f LEFT JOIN spanish s ON s.vault_folder = f.vault_folder AND s.safe = f.safe WHERE route = 'note')
SELECT feed_ord, page_id AS entry_ord, route,
  vault_folder || '/' || safe || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS path, head, -1 AS body_chars
FROM named
UNION ALL
SELECT feed_ord, page_id, route, vault_folder, '', 8 * least(number, 400) - 1 FROM fresh WHERE route = 'stub'""",
    "stream_discover": """
SELECT url_key, url, entry_ord, 'pending' AS status FROM (
  SELECT lower(u) AS url_key, CASE WHEN event_type IN ('click', 'view') THEN upper(u) ELSE u END AS url,
    event_id AS entry_ord, row_number() OVER (PARTITION BY lower(u) ORDER BY event_id) AS rn
  FROM (SELECT *, 'https://e.example/' || user_id || '/Item-' || CAST(floor(value) AS BIGINT) AS u FROM events))
WHERE rn = 1""",
    "stream_stub_state": SHOWN,
}
