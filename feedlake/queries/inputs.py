"""Feed, entry, queue and sighting tables, derived by Spark from the given tables.

Each derivation has its SQL twin, which the oracles build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake.operators.joins import spread_join

RUN_TS = "2001-08-02 00:00:00"
KEEP_DAYS = 90
PAGE_RUN_TS = "2026-03-20 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row.

    A table in a few files would leave cores idle, so its rows are spread over
    them. One with as many splits as cores is read as it is, without a shuffle.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def by_lang(en, fr, de, es) -> Column:
    """Value by the language of a page's URL."""
    lang = F.col("lang")
    return F.when(lang == "en", en).when(lang == "fr", fr).when(lang == "de", de).otherwise(es)


def site_pages(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Pages with the parts of their URL: host as source, language, number."""
    if spread:
        pages = spread_table(spark, sf_dir, "pages", "page_id", "url", "html")
    else:
        pages = table(spark, sf_dir, "pages")
    part = r"^https?://([^/]+)/([a-z]+)/([0-9]+)"
    url = F.col("url")
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract(url, part, 1).alias("source"),
        F.regexp_extract(url, part, 2).alias("lang"),
        F.regexp_extract(url, part, 3).cast("long").alias("number"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        "html",
    )


SITE_PAGES = r"""
site_pages AS (
  SELECT page_id, url,
    regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS source,
    regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 2) AS lang,
    CAST(regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 3) AS BIGINT) AS number,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    html
  FROM pages)"""


def lang_ord() -> Column:
    return by_lang(F.lit(0), F.lit(1), F.lit(2), F.lit(3)).cast("long")


def lang_parser() -> Column:
    return by_lang("wordpress", "khoros", "default", F.lit(None))


def lang_parser_or_default() -> Column:
    return by_lang("wordpress", "khoros", "default", "wordpress")


LANG_ORD = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END"
LANG_PARSER = "CASE lang WHEN 'en' THEN 'wordpress' WHEN 'fr' THEN 'khoros' WHEN 'de' THEN 'default' END"


def site_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed per host and language, in the order of their first page."""
    grouped = (
        site_pages(spark, sf_dir).groupBy("source", "lang").agg(F.min("page_id").alias("feed_ord"))
    )
    return grouped.select(
        "feed_ord",
        F.format_string("%s (%s)", "source", "lang").alias("name"),
        "source",
        lang_parser().alias("parser"),
        F.format_string("https://%s/%s/feed", "source", "lang").alias("rss_url"),
        F.format_string("vault/%s", "source").alias("vault_folder"),
        "lang",
    )


SITE_FEEDS = f"""
site_feeds AS (
  SELECT min(page_id) AS feed_ord, source || ' (' || lang || ')' AS name, source,
    {LANG_PARSER} AS parser, 'https://' || source || '/' || lang || '/feed' AS rss_url,
    'vault/' || source AS vault_folder, lang
  FROM site_pages GROUP BY source, lang)"""


def site_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries; date and author forms differ by language."""
    pages = site_pages(spark, sf_dir)
    feeds = site_feeds(spark, sf_dir).select("source", "lang", "feed_ord", "vault_folder")
    when = F.timestamp_add("DAY", F.col("number"), F.lit("2023-01-01 08:30:00").cast("timestamp"))
    rfc = F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    iso = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    writer = F.format_string("writer-%d", "number")
    no_people = F.array().cast("array<struct<name:string>>")
    # The feed's own text: from a few words to well above the stub threshold.
    summary = F.repeat(F.concat("lang", F.lit(" text ")), F.least(F.col("number"), F.lit(400)).cast("int"))
    return spread_join(pages, feeds, ["source", "lang"], ["page_id"], "inner").select(
        "page_id",
        "lang",
        "feed_ord",
        F.col("page_id").alias("entry_ord"),
        "source",
        lang_parser().alias("parser"),
        "vault_folder",
        F.col("url").alias("link"),
        "title",
        by_lang(writer, F.lit(""), F.lit(None), F.lit("")).alias("author"),
        by_lang(no_people, F.array(F.struct(writer.alias("name"))), no_people, F.lit(None)).alias("authors"),
        by_lang(rfc, iso, F.lit("last week"), F.lit(None)).alias("published_raw"),
        F.lit(None).cast("array<struct<value:string>>").alias("content"),
        summary.alias("summary"),
    )


def order_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a queue: F synced, O synced without a time, P pending."""
    orders = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("queue_ord"),
        F.format_string("https://q.example/%d", "o_orderkey").alias("url"),
        F.format_string("Order %d", "o_orderkey").alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.lit("").alias("published"),
        F.concat(F.lit("src"), F.substring(priority, 1, 1)).alias("feed"),
        F.when(priority.startswith("1"), "khoros").when(priority.startswith("2"), "default")
        .when(priority.startswith("3"), "wordpress").alias("parser"),
        F.col("o_orderdate").cast("timestamp").alias("discovered"),
        F.when(status == "P", "pending").otherwise("synced").alias("status"),
        F.when(status == "F", F.col("o_orderdate").cast("timestamp")).alias("synced_at"),
    )


ORDER_QUEUE = """
order_queue AS (
  SELECT o_orderkey AS queue_ord, 'https://q.example/' || o_orderkey AS url,
    'Order ' || o_orderkey AS title, CAST(NULL AS VARCHAR) AS author, '' AS published,
    'src' || substring(o_orderpriority, 1, 1) AS feed,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'khoros' WHEN o_orderpriority LIKE '2%' THEN 'default'
      WHEN o_orderpriority LIKE '3%' THEN 'wordpress' END AS parser,
    o_orderdate AS discovered,
    CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'synced' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS synced_at
  FROM orders)"""


def sightings_of(events: DataFrame) -> DataFrame:
    """Events, as a table or a stream, as stub sightings; large purchases as captures."""
    captured = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    return events.select(
        F.format_string("https://s.example/%d/%d", "user_id", F.floor("value")).alias("url_key"),
        F.when(captured, "captured").otherwise("seen").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.floor(F.col("value") * 10).cast("long").alias("body_chars"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings_of(table(spark, sf_dir, "events"))


SIGHTINGS = """
sightings AS (
  SELECT 'https://s.example/' || user_id || '/' || CAST(floor(value) AS BIGINT) AS url_key,
    CASE WHEN event_type = 'purchase' AND value > 60 THEN 'captured' ELSE 'seen' END AS kind,
    ts, event_id, CAST(floor(value * 10) AS BIGINT) AS body_chars
  FROM events)"""


def with_cte(*parts: str) -> str:
    return "WITH " + ",".join(parts)
