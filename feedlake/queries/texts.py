"""Queries over titles, dates, frontmatter, Markdown clean-up, notes and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake.functions import keys, text
from feedlake.operators import articles, reports
from feedlake.operators.ranking import NoteNames, assign_names
from feedlake.queries import inputs as i
from feedlake.sources.notes import note_keys


def sanitize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles, and a long one per page with a lost ``#`` and unsafe characters."""
    pages = i.site_pages(spark, sf_dir)
    long = F.concat(F.lit("A: &8211; b/c \t"), "title", F.lit(' | "'), F.repeat(F.concat("title", F.lit(" ")), 4))
    return pages.select(
        "page_id",
        text.sanitize_title(F.col("title")).alias("safe_name"),
        text.sanitize_title(long).alias("long_name"),
    )


def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, decoded; they state the entities amp, quot, copy and middot."""
    pages = i.spread_table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", text.decode_entities(F.col("html")).alias("decoded"))


def iso_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in the forms that feeds state, read back and written as ISO text."""
    orders = i.table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    form = F.substring("o_orderpriority", 1, 1)
    raw = (
        F.when(form == "1", F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(form == "2", F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(form == "3", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .otherwise(F.concat(F.lit("about "), F.col("o_orderpriority")))
    )
    rows = orders.select("o_orderkey", raw.alias("raw")).withColumn("parsed", text.parse_feed_time(F.col("raw")))
    return rows.select("o_orderkey", text.published_text(F.col("parsed"), F.col("raw")).alias("published"))


def rendered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per page, its article text as body and its language as tag."""
    pages = i.site_pages(spark, sf_dir, spread=True)
    body = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    tags = F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(
        F.array("lang", F.col("number").cast("string"))
    )
    return pages.select(
        "page_id",
        "source",
        F.format_string("vault/%s", "source").alias("vault_folder"),
        text.note_text(
            F.col("url"),
            F.lit("w"),
            F.lit("2024-01-01T00:00:00+00:00"),
            text.iso_time(F.lit(i.PAGE_RUN_TS).cast("timestamp")),
            F.col("source"),
            i.lang_parser_or_default(),
            tags,
            body,
        ).alias("note_text"),
    )


def note_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_notes(spark, sf_dir).select("page_id", "note_text")


def frontmatter_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links read from notes: as built, quoted in capitals (fr), and not at all (de)."""
    notes = rendered_notes(spark, sf_dir)
    note = F.col("note_text")
    quoted = F.regexp_replace(note, r"(?m)\Alink: |^link: (.*)$", "  LINK: \"'$1/'\" ")
    form = (
        F.when(note.contains("\nfeed_kind: khoros"), quoted)
        .when(note.contains("\nfeed_kind: default"), F.regexp_replace(note, r"\nlink: ", "\nlin: "))
        .otherwise(note)
    )
    return notes.select("page_id", keys.vault_key(text.frontmatter_link(form)).alias("url_key"))


def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_keys(rendered_notes(spark, sf_dir))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with category lines, empty headings and blank lines put in."""
    documents = i.spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    source = F.col("source")
    lines = F.concat(
        F.lit("# \n# Head\n\n- [L]("), F.lit("/en-us/blog/category/"), source, F.lit(")\n\n\n\n"),
        F.col("text"),
        F.lit("\n##  \n- [not one](/a/b/blog/category/x)\n- [C d](/"), "lang", F.lit("/blog/category/"), "lang", F.lit("-news)  \n\n\n\nend"),
    )
    return documents.select("doc_id", lines.alias("md"))


def category_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.col("md")
    return marked_documents(spark, sf_dir).select(
        "doc_id",
        F.array_join(text.category_slugs(md), "|").alias("slugs"),
        text.without_categories(md).alias("cleaned"),
    )


def empty_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_documents(spark, sf_dir).select("doc_id", text.without_empty_headings(F.col("md")).alias("cleaned"))


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = i.spread_table(spark, sf_dir, "documents", "doc_id", "text")
    spaced = F.regexp_replace("text", r"\n", "\n\n\n\n")
    return documents.select("doc_id", text.squeeze_blank_lines(spaced).alias("cleaned"))


def protocol_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links were made protocol-relative; script text keeps its own ``//``."""
    pages = i.spread_table(spark, sf_dir, "pages", "page_id", "html")
    page = F.replace(F.replace("html", F.lit('href="/'), F.lit('href="//cdn.example/')), F.lit("track("), F.lit("src='//x';track("))
    return pages.select("page_id", text.absolute_links(page).alias("html"))


def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links of each page as its tags, in two spellings and with blanks."""
    pages = i.spread_table(spark, sf_dir, "pages", "page_id", "html")
    links = F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)">'), F.lit(1))
    loud = F.transform(links, lambda tag: F.concat(F.lit(" "), F.lower(tag), F.lit("\t")))
    tags = text.union_tags(links, F.array(F.lit(" "), F.lit("News ")), loud, F.array(F.lit("news")))
    return pages.select("page_id", F.array_join(tags, "|").alias("tags"))


def markdown_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page tags before those of category lines, and the text without these lines."""
    rows = marked_documents(spark, sf_dir).withColumn("page_tags", F.array(F.lit("EN-news"), F.lit("Other")))
    return articles.tagged(rows, "md", "page_tags").select(
        "doc_id", F.array_join("tags", "|").alias("tags"), F.length("md").cast("long").alias("md_chars")
    )


def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all pages as notes of one folder per language; the Spanish are stored already."""
    pages = i.site_pages(spark, sf_dir).select(
        "page_id", F.when(F.col("lang") == "es", "en").otherwise(F.col("lang")).alias("folder"), "title"
    )
    stored = i.site_pages(spark, sf_dir).filter(F.col("lang") == "es").select(F.lit("en").alias("folder"), "title")
    return assign_names(pages, stored, "folder", "title", ["page_id"], NoteNames(), "note_name")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log section of a run in which the https pages were new."""
    feeds = i.site_feeds(spark, sf_dir).select("feed_ord", "source", "lang", "name")
    new = i.site_pages(spark, sf_dir).filter(F.col("url").startswith("https:")).join(feeds, ["source", "lang"])
    path = F.format_string("vault/%s/%s.md", "source", "title")
    notes = new.select("feed_ord", F.col("page_id").alias("entry_ord"), text.path_without_suffix(path).alias("rel_path"))
    counted = reports.feed_counts(feeds, notes.select("feed_ord"), ["feed_ord"])
    lines = reports.log_lines(counted, notes, i.PAGE_RUN_TS, "scheduled")
    return lines.select(
        F.col("part").cast("long").alias("part"),
        F.coalesce("feed_ord", F.lit(-1)).alias("feed_ord"),
        F.coalesce("entry_ord", F.lit(-1)).alias("entry_ord"),
        "line",
    )


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_title, entity_decode, iso_published, note_build, frontmatter_link, stored_keys,
        category_extract, empty_headings, blank_lines, protocol_fix, tag_union, markdown_tags,
        collision_suffix, run_log,
    )
}

# RE2's \s is ASCII: the lines put in hold no other blanks.
MARKED = r"""
marked AS (
  SELECT doc_id, lang, source, '# ' || chr(10) || '# Head' || chr(10) || chr(10) || '- [L](/en-us/blog/category/' || source || ')'
    || repeat(chr(10), 4) || text || chr(10) || '##  ' || chr(10) || '- [not one](/a/b/blog/category/x)' || chr(10)
    || '- [C d](/' || lang || '/blog/category/' || lang || '-news)  ' || repeat(chr(10), 4) || 'end' AS md
  FROM documents)"""

CATEGORY = r"(?m)^- \[.*?\]\(/[\w-]+/blog/category/([\w-]+)\)\s*$"

NOTES = rf"""
rendered AS (
  SELECT page_id, url, lang, source, '---' || chr(10) || 'link: ' || url || chr(10) || 'author: w' || chr(10)
    || 'published: 2024-01-01T00:00:00+00:00' || chr(10) || 'clipped: 2026-03-20T12:00:00+00:00' || chr(10)
    || 'source: ' || source || chr(10) || 'feed_kind: ' || coalesce({i.LANG_PARSER}, 'wordpress') || chr(10)
    || 'tags:' || CASE WHEN lang = 'en' THEN '' ELSE chr(10) || '  - "' || lang || '"' || chr(10) || '  - "' || number || '"' END
    || chr(10) || '---' || chr(10) || chr(10) || '# Content' || chr(10) || chr(10)
    || regexp_extract(html, '(?s)<article>(.*?)</article>', 1) || chr(10) AS note_text
  FROM site_pages)"""

SAFE = r"""trim(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace({0}, '&8211;', '–'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
    '[/\\:|?*"<>]', '–', 'g'), '\s+', ' ', 'g'))"""

ORACLES = {
    "sanitize_title": i.with_cte(i.SITE_PAGES) + f""",
safe AS (
  SELECT page_id, {SAFE.format("title")} AS a,
    {SAFE.format("'A: &8211; b/c ' || chr(9) || title || ' | \"' || repeat(title || ' ', 4)")} AS b
  FROM site_pages)
SELECT page_id,
  CASE WHEN length(a) > 200 THEN regexp_replace(substring(a, 1, 200), ' [^ ]*$', '') ELSE a END AS safe_name,
  CASE WHEN length(b) > 200 THEN regexp_replace(substring(b, 1, 200), ' [^ ]*$', '') ELSE b END AS long_name
FROM safe""",
    "entity_decode": """
SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS decoded
FROM pages""",
    "iso_published": """
SELECT o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '2' THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN '4' THEN 'about ' || o_orderpriority WHEN '5' THEN 'about ' || o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') END AS published
FROM orders""",
    "note_build": i.with_cte(i.SITE_PAGES, NOTES) + "\nSELECT page_id, note_text FROM rendered",
    "frontmatter_link": i.with_cte(i.SITE_PAGES) + """
SELECT page_id, CASE WHEN lang <> 'de' THEN rtrim(lower(url), '/') END AS url_key FROM site_pages""",
    "stored_keys": i.with_cte(i.SITE_PAGES, NOTES) + r"""
SELECT DISTINCT 'vault/' || source AS vault_folder,
  rtrim(lower(regexp_extract(note_text, '(?m)^link: (.*)$', 1)), '/') AS url_key FROM rendered""",
    "category_extract": i.with_cte(MARKED) + rf"""
SELECT doc_id, array_to_string(regexp_extract_all(md, '{CATEGORY}', 1), '|') AS slugs,
  regexp_replace(regexp_replace(md, '{CATEGORY}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS cleaned
FROM marked""",
    "empty_headings": i.with_cte(MARKED) + r"""
SELECT doc_id, regexp_replace(regexp_replace(md, '(?m)^#+\s*$\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS cleaned
FROM marked""",
    "blank_lines": "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS cleaned FROM documents",
    "protocol_fix": """
SELECT page_id, replace(replace(html, 'href="/', 'href="https://cdn.example/'), 'track(', 'src=''//x'';track(') AS html FROM pages""",
    "tag_union": r"""
WITH t AS (
  SELECT page_id, list_concat(l, ['', 'News'], list_transform(l, lambda x: lower(x)), ['news']) AS tags
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS l FROM pages)),
u AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM t),
f AS (SELECT page_id, tag, pos, row_number() OVER (PARTITION BY page_id, lower(tag) ORDER BY pos) AS rn FROM u WHERE tag <> '')
SELECT page_id, string_agg(tag, '|' ORDER BY pos) AS tags FROM f WHERE rn = 1 GROUP BY page_id""",
    "markdown_tags": i.with_cte(MARKED) + rf"""
SELECT doc_id, 'EN-news|Other|' || source || CASE WHEN lang = 'en' THEN '' ELSE '|' || lang || '-news' END AS tags,
  length(regexp_replace(regexp_replace(md, '{CATEGORY}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS md_chars
FROM marked""",
    "collision_suffix": i.with_cte(i.SITE_PAGES) + """,
named AS (
  SELECT page_id, CASE WHEN lang = 'es' THEN 'en' ELSE lang END AS folder, title FROM site_pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY folder, title ORDER BY page_id)
    + CASE WHEN folder = 'en' AND title IN (SELECT title FROM site_pages WHERE lang = 'es') THEN 1 ELSE 0 END AS n
  FROM named)
SELECT page_id, folder, title, title || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS note_name FROM ranked""",
    "run_log": i.with_cte(i.SITE_PAGES, i.SITE_FEEDS) + """,
new AS (
  SELECT f.feed_ord, p.page_id AS entry_ord, 'vault/' || p.source || '/' || p.title AS rel_path
  FROM site_pages p JOIN site_feeds f ON f.source = p.source AND f.lang = p.lang WHERE p.url LIKE 'https:%')
SELECT CAST(part AS BIGINT) AS part, CAST(coalesce(feed_ord, -1) AS BIGINT) AS feed_ord,
  CAST(coalesce(entry_ord, -1) AS BIGINT) AS entry_ord, line FROM (
  SELECT 0 AS part, NULL AS feed_ord, NULL AS entry_ord, chr(10) || '## 2026-03-20T12:00:00+00:00' || chr(10) AS line
  UNION ALL
  SELECT 1, f.feed_ord, NULL, '- Feed: ' || f.name || ' — ' || (SELECT count(*) FROM new n WHERE n.feed_ord = f.feed_ord) || ' new articles'
  FROM site_feeds f
  UNION ALL SELECT 2, NULL, NULL, '- New articles:'
  UNION ALL SELECT 3, feed_ord, entry_ord, '  - [[' || rel_path || ']]' FROM new
  UNION ALL SELECT 4, NULL, NULL, '- Trigger: scheduled')""",
}
