"""Queries over feeds, keys, the queue and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake import schemas
from feedlake.functions import keys, text
from feedlake.functions.html import PARSERS
from feedlake.operators import dedup, joins, lookup, queue as q, reports
from feedlake.operators.ranking import first_n, numbered, sequence_of
from feedlake.queries import inputs as i
from feedlake.sources import feeds as feed_source


def feed_config_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration text per host, read as config files are."""
    listed = i.site_feeds(spark, sf_dir).withColumn("pos", i.lang_ord())
    entry = F.struct("pos", "name", "source", "parser", "rss_url", "vault_folder")
    days = F.when(~F.col("source").endswith(".org"), F.lit(30))
    # A host has at most one feed per language, so the list is short by nature.
    files = listed.groupBy("source").agg(F.array_sort(F.collect_set(entry)).alias("feeds")).select(
        F.to_json(F.struct("feeds", F.struct(days.alias("keep_synced_days")).alias("settings"))).alias("json")
    )
    config = files.select(F.from_json("json", schemas.FEED_CONFIG).alias("c")).select("c.*")
    return feed_source.explode_config(config, "/vault-root").withColumn(
        "keep_synced_days", F.col("keep_synced_days").cast("long")
    )


def rendered_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files of at most 20 items: RSS, Atom (fr), cut short (de), items without end tags (es)."""
    pages = i.site_pages(spark, sf_dir).withColumn("window", F.floor(F.col("page_id") / 20))
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    rss = F.concat(
        F.lit("<item><title>"), "title", F.lit("</title><link>"), link,
        F.lit("</link><dc:creator>w"), F.col("number").cast("string"),
        F.lit("</dc:creator><pubDate>Tue, 05 Mar 2024 10:20:30 +0200</pubDate><description><![CDATA["),
        article, F.lit("]]></description></item>\n"),
    )
    atom = F.concat(
        F.lit('<entry xml:lang="fr"><title type="html">'), "title", F.lit('</title><link rel="self" href="x"/><link href="'),
        link, F.lit('"/><author><name>w'), F.col("number").cast("string"),
        F.lit("</name></author><published>2024-03-05T08:20:30Z</published><summary><![CDATA["),
        article, F.lit("]]></summary></entry>\n"),
    )
    item = i.by_lang(rss, atom, rss, F.replace(rss, F.lit("</item>"), F.lit("")))
    head = i.by_lang(
        F.lit('<?xml version="1.0"?><rss><channel><title>f</title>'),
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'),
        F.lit("<rss><channel><title>a & b</title>"),
        F.lit("<rss><channel>"),
    )
    foot = i.by_lang(F.lit("</channel></rss>"), F.lit("</feed>"), F.lit(""), F.lit("</channel></rss>"))
    return (
        pages.groupBy("source", "lang", "window")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))).alias("items"))
        .select("source", "lang", "window", F.concat(head, F.array_join("items.item", ""), foot).alias("xml"))
    )


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rendered_feeds(spark, sf_dir)
    entries = feed_source.parse_feed_files(files, "xml", ["source", "lang", "window"])
    return entries.select(
        "source",
        "lang",
        "window",
        "entry_ord",
        "link",
        "title",
        text.pick_author(F.col("author"), F.col("authors")).alias("author"),
        text.published_text(F.col("published_parsed"), F.col("published_raw")).alias("published"),
        F.length("summary").cast("long").alias("summary_chars"),
    )


def marked_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files as they should not be: items within comments, bare markup, XHTML (fr), a cut-off end (de)."""
    pages = i.site_pages(spark, sf_dir).withColumn("window", F.floor(F.col("page_id") / 20))
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    number = F.col("number").cast("string")
    rss = F.concat(
        F.lit("<!-- <item><title>no</title><link>http://no.example</link></item> --><item><title>"), "title", F.lit("</title><link>"), link,
        F.lit("</link><description>w <b>"), number, F.lit("</b><br> &amp; <![CDATA[<i>]]></description></item>"),
    )
    atom = F.concat(
        F.lit("<entry><title>"), "title", F.lit('</title><link href="'), link,
        F.lit('"/><content type="xhtml"><div><p>w '), number, F.lit(" &amp; more</p></div></content></entry>"),
    )
    body = F.array_join("items.item", "")
    return (
        pages.groupBy("source", "lang", "window")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", i.by_lang(rss, atom, rss, rss).alias("item")))).alias("items"))
        .select(
            "source", "lang", "window",
            i.by_lang(
                F.concat(F.lit("<rss><channel>"), body, F.lit("</channel></rss>")),
                F.concat(F.lit("<feed>"), body, F.lit("</feed>")),
                F.concat(F.lit("<rss><channel>"), F.regexp_replace(body, r"<br> &amp; <!\[CDATA\[<i>\]\]></description></item>$", "")),
                F.concat(F.lit("<rss><channel><item><title>broken <b></item>"), body),
            ).alias("xml"),
        )
    )


def feed_items_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = feed_source.parse_feed_files(marked_feeds(spark, sf_dir), "xml", ["source", "lang", "window"])
    return q.with_url(entries, "link").select(
        "source", "lang", "window", "link", "title", F.coalesce("summary", F.get("content", 0)["value"]).alias("body")
    )


def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_source.healthy_feeds(rendered_feeds(spark, sf_dir), "xml", ["source", "lang", "window"])


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    forms = F.array(url, F.concat(F.upper(url), F.lit("/")), F.concat(url, F.lit("//")))
    return (
        i.table(spark, sf_dir, "pages")
        .select("page_id", F.posexplode(forms).alias("form", "url"))
        .select(
            "page_id",
            F.col("form").cast("long").alias("form"),
            keys.discovery_key(url).alias("discovery_key"),
            keys.vault_key(url).alias("vault_key"),
        )
    )


def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = i.table(spark, sf_dir, "pages").select("url")
    return joins.distinct_keys(
        url.unionByName(url.select(F.upper("url").alias("url"))), keys.discovery_key(F.col("url")), "url_key"
    )


def queue_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = i.site_entries(spark, sf_dir).withColumn(
        "published_parsed", text.parse_feed_time(F.col("published_raw"))
    )
    return (
        q.queue_records(entries, i.PAGE_RUN_TS)
        .withColumn("discovered", text.iso_time(F.col("discovered")))
        .drop("synced_at")
    )


def repeated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page twice: as it is, and in capitals in the feed of the next language."""
    pages = i.site_pages(spark, sf_dir).select("page_id", "lang", "url", i.lang_ord().alias("feed_ord"))
    loud = pages.select("page_id", "lang", F.upper("url").alias("url"), ((F.col("feed_ord") + 3) % 4).alias("feed_ord"))
    return pages.unionByName(loud).select(
        "feed_ord", F.col("page_id").alias("entry_ord"), F.col("url").alias("link"), "lang"
    )


def discover_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New URLs; the queue holds those of the English pages, in capitals."""
    known = i.site_pages(spark, sf_dir).filter(F.col("lang") == "en").select(F.upper("url").alias("url"))
    return dedup.discover_new(
        repeated_entries(spark, sf_dir), known, ["feed_ord", "entry_ord"]
    ).select("feed_ord", "entry_ord", "link")


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = i.site_pages(spark, sf_dir).select(
        F.lower("title").alias("title_key"), i.lang_ord().alias("feed_ord"), F.col("page_id").alias("entry_ord"), "url"
    )
    return joins.first_per_key(pages, ["title_key"], ["feed_ord", "entry_ord"])


def vault_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All entries, repeated ones included, and stored notes for the English pages."""
    pages = i.site_pages(spark, sf_dir)
    folder = F.format_string("vault/%s", "source").alias("vault_folder")
    rows = pages.select("page_id", folder, keys.vault_key(F.col("url")).alias("url_key"))
    notes = pages.filter(F.col("lang") == "en").select(
        folder, keys.vault_key(F.concat(F.upper("url"), F.lit("//"))).alias("url_key")
    )
    return rows.unionByName(rows), notes


def vault_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, notes = vault_rows(spark, sf_dir)
    return dedup.unseen(rows, notes, ["page_id"]).select("page_id", "vault_folder", "url_key")


def vault_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, notes = vault_rows(spark, sf_dir)
    return dedup.already_stored(rows, notes, ["page_id"]).select("page_id", "vault_folder", "url_key")


def per_feed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.site_pages(spark, sf_dir).select("source", "page_id", "url")
    capped = first_n(rows, ["source"], ["page_id"], 3)
    size = capped.groupBy("source").agg(F.count("*").alias("n_in_run"))
    return numbered(capped, ["source"], ["page_id"], "position").join(size, "source")


def kind_then_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.take_pending(i.order_queue(spark, sf_dir), "wordpress", 50).select("queue_ord", "url", "parser")


def take_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.take_counts(i.order_queue(spark, sf_dir), "wordpress", 50)


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.prune(i.order_queue(spark, sf_dir), i.RUN_TS, i.KEEP_DAYS).select("queue_ord", "url", "status")


def prune_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.prune_counts(i.order_queue(spark, sf_dir), i.RUN_TS, i.KEEP_DAYS)


def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.counts(i.order_queue(spark, sf_dir))


def queue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = i.site_entries(spark, sf_dir).withColumn(
        "published_parsed", text.parse_feed_time(F.col("published_raw"))
    )
    placed = entries.withColumn("seq", sequence_of(F.col("feed_ord"), F.col("entry_ord")))
    records = q.queue_records(placed, i.PAGE_RUN_TS, keep=["seq"])
    return q.append(i.order_queue(spark, sf_dir), records, "seq").select(
        "queue_ord", "url", "title", "feed", "status"
    )


def queue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = i.site_entries(spark, sf_dir).withColumn("published_parsed", F.lit(None).cast("timestamp"))
    records = q.queue_records(entries, i.PAGE_RUN_TS)
    return records.select(
        "url", text.record_json("url", "title", "author", "published", "feed", "parser", "status").alias("record")
    )


def mark_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = i.order_queue(spark, sf_dir)
    done = q.pending(queue).filter(q.is_kind("khoros")).select("queue_ord")
    marked = q.mark_synced(queue, done, i.RUN_TS)
    return marked.select("queue_ord", "status", text.iso_time(F.col("synced_at")).alias("synced_at"))


def counted_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows per feed when only https pages are new; other feeds count zero."""
    feeds = i.site_feeds(spark, sf_dir).select("source", "lang", "name")
    new = i.site_pages(spark, sf_dir).filter(F.col("url").startswith("https:")).select("source", "lang")
    return reports.feed_counts(feeds, new, ["source", "lang"])


def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_feeds(spark, sf_dir).select("name", "new_count")


def total_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.total(counted_feeds(spark, sf_dir))


def target_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = i.site_pages(spark, sf_dir)
    return joins.distinct_keys(pages, F.format_string("vault/%s", "source"), "vault_folder")


def asked_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows that ask for a source and a parser, known or not."""
    url = F.col("url")
    asked = (
        F.when(url.endswith(".html"), "default").when(url.endswith("#top"), "khoros")
        .when(url.contains("utm_source"), F.lit(None)).otherwise("unheard-of")
    )
    return i.site_pages(spark, sf_dir).select("page_id", F.col("source").alias("feed"), asked.alias("parser"))


def feed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured are the feeds with an https page, those with a Spanish twin twice."""
    feeds = i.site_feeds(spark, sf_dir).join(
        i.site_pages(spark, sf_dir).filter(F.col("url").startswith("https:")).select("source", "lang"),
        ["source", "lang"],
        "left_semi",
    )
    found = lookup.known_feed(lookup.lookup_feeds(asked_feeds(spark, sf_dir), feeds, "feed", "parser", ["page_id"]))
    return found.select("page_id", "feed_cfg.name", F.col("feed_cfg.parser").alias("cfg_parser"), "feed_cfg.vault_folder")


def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_feeds(spark, sf_dir).select(
        "page_id", lookup.dispatched_parser(F.col("parser"), PARSERS).alias("runs")
    )


QUERIES = {
    f.__name__: f
    for f in (
        feed_config_explode, feed_items, feed_items_marked, feed_health, url_keys, known_keys, queue_projection,
        discover_new, first_wins, vault_anti, vault_semi, per_feed_cap, kind_then_cap, take_counts,
        retention_prune, prune_counts, queue_counts, queue_append, queue_json, mark_synced,
        feed_counts, total_new, target_folders, feed_lookup, parser_dispatch,
    )
}

FEED_FILES = r"""
feed_files AS (
  SELECT source, lang, page_id // 20 AS "window", page_id, number, url,
    trim(replace(replace(title, '&quot;', '"'), '&amp;', '&')) AS title,
    length(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) AS summary_chars
  FROM site_pages)"""

PUBLISHED = """CASE WHEN lang IN ('en', 'fr')
      THEN strftime(TIMESTAMP '2023-01-01 08:30:00' + to_days(CAST(number AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00')
      WHEN lang = 'de' THEN 'last week' ELSE '' END"""

REPEATED = f"""
repeated AS (
  SELECT {i.LANG_ORD} AS feed_ord, page_id AS entry_ord, url AS link FROM site_pages
  UNION ALL
  SELECT ({i.LANG_ORD} + 3) % 4, page_id, upper(url) FROM site_pages)"""

VAULT = """
rows2 AS (
  SELECT page_id, 'vault/' || source AS vault_folder, rtrim(lower(url), '/') AS url_key FROM site_pages
  UNION ALL
  SELECT page_id, 'vault/' || source, rtrim(lower(url), '/') FROM site_pages),
notes AS (
  SELECT 'vault/' || source AS vault_folder, rtrim(lower(upper(url) || '//'), '/') AS url_key
  FROM site_pages WHERE lang = 'en')"""

FEED_COUNTS = """
counted AS (
  SELECT f.name, count(p.page_id) AS new_count
  FROM site_feeds f LEFT JOIN site_pages p
    ON p.source = f.source AND p.lang = f.lang AND p.url LIKE 'https:%'
  GROUP BY f.name)"""

ASKED = """
asked AS (
  SELECT page_id, source AS feed,
    CASE WHEN url LIKE '%.html' THEN 'default' WHEN url LIKE '%#top' THEN 'khoros'
      WHEN url LIKE '%utm_source%' THEN NULL ELSE 'unheard-of' END AS parser
  FROM site_pages)"""

ORACLES = {
    "feed_config_explode": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS) + f"""
SELECT row_number() OVER (PARTITION BY source ORDER BY {i.LANG_ORD}) - 1 AS feed_ord,
  name, source, coalesce(parser, 'wordpress') AS parser, rss_url,
  '/vault-root/' || vault_folder AS vault_folder,
  CAST(CASE WHEN source LIKE '%.org' THEN 90 ELSE 30 END AS BIGINT) AS keep_synced_days
FROM site_feeds""",
    "feed_items": i.with_cte(i.SITE_PAGES, FEED_FILES) + """
SELECT source, lang, "window",
  row_number() OVER (PARTITION BY source, lang, "window" ORDER BY page_id) - 1 AS entry_ord,
  url AS link, title, 'w' || number AS author, '2024-03-05T08:20:30+00:00' AS published, summary_chars
FROM feed_files""",
    "feed_items_marked": i.with_cte(i.SITE_PAGES) + """
SELECT source, lang, page_id // 20 AS "window", url AS link,
  trim(replace(replace(title, '&quot;', '"'), '&amp;', '&')) AS title,
  CASE WHEN lang = 'fr' THEN '<div><p>w ' || number || ' &amp; more</p></div>'
    WHEN lang <> 'de' OR page_id < max(page_id) OVER (PARTITION BY source, lang, page_id // 20)
    THEN 'w <b>' || number || '</b><br> &amp; <i>' END AS body
FROM site_pages""",
    "feed_health": i.with_cte(i.SITE_PAGES, FEED_FILES) + """
SELECT source, lang, "window", count(*) AS n_items FROM feed_files GROUP BY source, lang, "window\"""",
    "url_keys": """
SELECT page_id, CAST(form AS BIGINT) AS form, lower(u) AS discovery_key, rtrim(lower(u), '/') AS vault_key
FROM (
  SELECT page_id, 0 AS form, url AS u FROM pages
  UNION ALL SELECT page_id, 1, upper(url) || '/' FROM pages
  UNION ALL SELECT page_id, 2, url || '//' FROM pages)""",
    "known_keys": "SELECT DISTINCT lower(url) AS url_key FROM pages",
    "queue_projection": i.with_cte(i.SITE_PAGES) + f"""
SELECT url, title,
  CASE WHEN lang IN ('en', 'fr') THEN 'writer-' || number ELSE '' END AS author,
  {PUBLISHED} AS published, source AS feed,
  coalesce({i.LANG_PARSER}, 'wordpress') AS parser,
  '2026-03-20T12:00:00+00:00' AS discovered, 'pending' AS status
FROM site_pages""",
    "discover_new": i.with_cte(i.SITE_PAGES, REPEATED) + """,
fresh AS (
  SELECT * FROM repeated r WHERE NOT EXISTS (
    SELECT 1 FROM site_pages k WHERE k.lang = 'en' AND lower(upper(k.url)) = lower(r.link)))
SELECT CAST(feed_ord AS BIGINT) AS feed_ord, entry_ord, link FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(link) ORDER BY feed_ord, entry_ord) AS rn FROM fresh)
WHERE rn = 1""",
    "first_wins": i.with_cte(i.SITE_PAGES) + f"""
SELECT title_key, CAST(feed_ord AS BIGINT) AS feed_ord, entry_ord, url FROM (
  SELECT lower(title) AS title_key, {i.LANG_ORD} AS feed_ord, page_id AS entry_ord, url,
    row_number() OVER (PARTITION BY lower(title) ORDER BY {i.LANG_ORD}, page_id) AS rn
  FROM site_pages) WHERE rn = 1""",
    "vault_anti": i.with_cte(i.SITE_PAGES, VAULT) + """
SELECT page_id, vault_folder, url_key FROM rows2 r WHERE NOT EXISTS (
  SELECT 1 FROM notes n WHERE n.vault_folder = r.vault_folder AND n.url_key = r.url_key)""",
    "vault_semi": i.with_cte(i.SITE_PAGES, VAULT) + """
SELECT page_id, vault_folder, url_key FROM rows2 r WHERE EXISTS (
  SELECT 1 FROM notes n WHERE n.vault_folder = r.vault_folder AND n.url_key = r.url_key)""",
    "per_feed_cap": i.with_cte(i.SITE_PAGES) + """
SELECT source, page_id, url, position, least(n, 3) AS n_in_run FROM (
  SELECT source, page_id, url, row_number() OVER (PARTITION BY source ORDER BY page_id) AS position,
    count(*) OVER (PARTITION BY source) AS n FROM site_pages) WHERE position <= 3""",
    "kind_then_cap": i.with_cte(i.ORDER_QUEUE) + """
SELECT queue_ord, url, parser FROM order_queue
WHERE status = 'pending' AND coalesce(parser, 'wordpress') = 'wordpress' ORDER BY queue_ord LIMIT 50""",
    "take_counts": i.with_cte(i.ORDER_QUEUE) + """
SELECT count(*) FILTER (coalesce(parser, 'wordpress') <> 'wordpress') AS n_skipped,
  least(count(*) FILTER (coalesce(parser, 'wordpress') = 'wordpress'), 50) AS n_taken,
  greatest(count(*) FILTER (coalesce(parser, 'wordpress') = 'wordpress') - 50, 0) AS n_remaining
FROM order_queue WHERE status = 'pending'""",
    "retention_prune": i.with_cte(i.ORDER_QUEUE) + """
SELECT queue_ord, url, status FROM order_queue
WHERE status = 'pending' OR synced_at >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY""",
    "prune_counts": i.with_cte(i.ORDER_QUEUE) + """
SELECT count(*) AS n_before,
  count(*) FILTER (status = 'synced' AND (synced_at IS NULL OR synced_at < TIMESTAMP '2001-08-02' - INTERVAL 90 DAY)) AS n_removed,
  count(*) FILTER (status = 'pending' OR synced_at >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY) AS n_kept
FROM order_queue""",
    "queue_counts": i.with_cte(i.ORDER_QUEUE) + """
SELECT count(*) AS n_tracked, count(*) FILTER (status = 'pending') AS n_pending FROM order_queue""",
    "queue_append": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS, i.ORDER_QUEUE) + """
SELECT queue_ord, url, title, feed, status FROM order_queue
UNION ALL
SELECT (SELECT max(queue_ord) FROM order_queue) + row_number() OVER (ORDER BY f.feed_ord, p.page_id),
  p.url, p.title, p.source, 'pending'
FROM site_pages p JOIN site_feeds f ON f.source = p.source AND f.lang = p.lang""",
    "queue_json": i.with_cte(i.SITE_PAGES) + f"""
SELECT url, CAST(to_json(struct_pack(url := url, title := title,
  author := CASE WHEN lang IN ('en', 'fr') THEN 'writer-' || number ELSE '' END,
  published := CASE WHEN lang = 'en' THEN strftime(d, '%a, %d %b %Y %H:%M:%S GMT')
    WHEN lang = 'fr' THEN strftime(d, '%Y-%m-%dT%H:%M:%SZ') WHEN lang = 'de' THEN 'last week' ELSE '' END,
  feed := source, parser := coalesce({i.LANG_PARSER}, 'wordpress'), status := 'pending')) AS VARCHAR) AS record
FROM (SELECT *, TIMESTAMP '2023-01-01 08:30:00' + to_days(CAST(number AS INTEGER)) AS d FROM site_pages)""",
    "mark_synced": i.with_cte(i.ORDER_QUEUE) + """
SELECT queue_ord,
  CASE WHEN status = 'pending' AND parser = 'khoros' THEN 'synced' ELSE status END AS status,
  strftime(CASE WHEN status = 'pending' AND parser = 'khoros' THEN TIMESTAMP '2001-08-02' ELSE synced_at END,
    '%Y-%m-%dT%H:%M:%S+00:00') AS synced_at
FROM order_queue""",
    "feed_counts": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS, FEED_COUNTS) + "\nSELECT name, new_count FROM counted",
    "total_new": "SELECT count(*) AS total_new FROM pages WHERE url LIKE 'https:%'",
    "target_folders": i.with_cte(i.SITE_PAGES) + "\nSELECT DISTINCT 'vault/' || source AS vault_folder FROM site_pages",
    "feed_lookup": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS, ASKED) + """,
cfg AS (
  SELECT f.*, coalesce(parser, 'wordpress') AS kind,
    min(feed_ord) OVER (PARTITION BY source, coalesce(parser, 'wordpress')) AS place,
    row_number() OVER (PARTITION BY source, coalesce(parser, 'wordpress') ORDER BY feed_ord DESC) AS rn
  FROM site_feeds f
  WHERE EXISTS (SELECT 1 FROM site_pages p WHERE p.source = f.source AND p.lang = f.lang AND p.url LIKE 'https:%')),
ranked AS (
  SELECT a.page_id, c.name, c.kind AS cfg_parser, c.vault_folder,
    row_number() OVER (PARTITION BY a.page_id ORDER BY
      CASE WHEN c.kind = coalesce(a.parser, 'wordpress') THEN 0 WHEN c.kind = 'wordpress' THEN 1 ELSE 2 END,
      c.place) AS pick
  FROM asked a JOIN cfg c ON c.source = a.feed AND c.rn = 1)
SELECT page_id, name, cfg_parser, vault_folder FROM ranked WHERE pick = 1""",
    "parser_dispatch": i.with_cte(i.SITE_PAGES, ASKED) + """
SELECT page_id, CASE WHEN parser IS NULL THEN 'wordpress' WHEN parser IN ('wordpress', 'khoros', 'default')
  THEN parser ELSE 'default' END AS runs FROM asked""",
}
