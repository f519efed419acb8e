"""Queries over image references, their local names and rewritten notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedlake.functions import images
from feedlake.operators import images as ops, lookup
from feedlake.queries import inputs as i

# What each note shows: pairs of the text of a reference and of what stays of it.
# {n} is the page's number, {lang} its language; a second host folder gives a name twice.
REFERENCES = (
    '[![chart {n}](https://img.example/{lang}/c{n}.png "A title")](https://full.example/{n})',
    "![a b](https://img.example/pic.jpg)",
    "![inline](data:image/png;base64,AAAA)",
    "![](https://img.example/up/pic.jpg?resize=832%2C326&ssl=1)",
    "![kept](local/a.png)",
    "![again](https://img.example/pic.jpg)",
    "![no suffix](https://img.example/{lang}/view/)",
    "![host](https://h{n}.example)",
)


def illustrated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per page: its article text with image references between the words."""
    pages = i.site_pages(spark, sf_dir, spread=True)
    number = F.col("number").cast("string")
    pieces = []
    for reference in REFERENCES:
        text = F.lit(reference)
        text = F.replace(text, F.lit("{n}"), number)
        pieces += [F.replace(text, F.lit("{lang}"), F.col("lang")), F.lit(" words\n")]
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    return pages.select(
        F.col("page_id").alias("note_id"),
        F.col("lang").alias("source"),
        F.concat(F.lit("site/"), "lang").alias("vault_folder"),
        F.col("title").alias("safe_name"),
        "number",
        F.concat(article, F.lit("\n"), *pieces, article).alias("note_text"),
    )


def asset_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset settings for every language met but Spanish."""
    langs = i.site_pages(spark, sf_dir).select("lang").distinct().filter(F.col("lang") != "es")
    return langs.select(
        F.col("lang").alias("source"),
        F.concat(F.lit("site/"), "lang").alias("vault_folder"),
        F.concat("lang", F.lit(" - articleassets")).alias("assets_subfolder"),
    )


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = ops.references(illustrated_notes(spark, sf_dir), "note_text", ["note_id"])
    return refs.select(
        "note_id",
        F.col("ord").cast("long").alias("ord"),
        "full_match",
        "alt_text",
        "image_url",
        F.col("is_clickable").cast("int").cast("long").alias("clickable"),
    )


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = ops.references(illustrated_notes(spark, sf_dir), "note_text", ["note_id"])
    return ops.reference_counts(refs, ["note_id"])


def image_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names for page URLs, for an encoded path and for long names."""
    pages = i.site_pages(spark, sf_dir)
    encoded = F.concat(F.lit("https://i.example/a%20b/x%2F"), "source", F.lit("%C3%A9+1.JPG;v=2?q#f"))
    long = F.concat(F.lit("https://i.example/"), F.repeat("source", 12), F.lit("/"), F.repeat(F.concat("source", F.lit("é")), 12), F.lit(".gif"))
    bare = F.concat(F.lit("https://"), "source", F.lit("?"), F.col("number").cast("string"))
    return pages.select(
        "page_id",
        images.image_file_name(F.col("url")).alias("from_url"),
        images.image_file_name(encoded).alias("from_encoded"),
        images.image_file_name(bare).alias("from_host"),
        images.image_file_name(long).alias("from_long"),
    )


def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets folder per document; only some sources have one."""
    documents = i.table(spark, sf_dir, "documents").select("doc_id", "source", F.format_string("Doc %d", "doc_id").alias("title"))
    config = documents.select("source").distinct().filter(F.col("source").startswith("src1")).select(
        "source",
        F.format_string("vault/%s", "source").alias("vault_folder"),
        F.format_string("%s - articleassets", "source").alias("assets_subfolder"),
    )
    found = lookup.lookup_assets(documents, config, "source", "title", ["doc_id"])
    return found.select("doc_id", F.coalesce("assets_dir", F.lit("none")).alias("assets_dir"))


def localized(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All notes, with fetch results for every image they show and some stored files."""
    notes = illustrated_notes(spark, sf_dir)
    urls = ops.references(notes, "note_text", ["number"]).groupBy("image_url").agg(F.max("number").alias("number"))
    # Some images are too large, and none with a bare host could be fetched.
    fetched = urls.select(
        "image_url",
        (~F.col("image_url").rlike(r"^https://h\d+\.example$")).alias("ok"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(F.col("image_url").rlike(r"/c\d*7\.png$"), images.MAX_IMAGE_BYTES + 1).otherwise(F.col("number") + 1).cast("long").alias("n_bytes"),
    )
    stored = notes.filter(F.col("source") == "fr").select(
        images.assets_dir(F.col("vault_folder"), F.lit("fr - articleassets"), F.col("safe_name")).alias("assets_dir"),
        F.lit("pic.jpg").alias("file_name"),
    )
    return ops.localize_images(notes, asset_config(spark, sf_dir), fetched, stored)


def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localized(spark, sf_dir)["assets"].select("note_id", "assets_dir", "image_url", "asset_name")


def planned_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that would be fetched, each once per note."""
    notes = lookup.lookup_assets(illustrated_notes(spark, sf_dir), asset_config(spark, sf_dir), "source", "safe_name", ["note_id"])
    refs = ops.eligible(ops.references(notes, "note_text", ["note_id", "assets_dir"]))
    return ops.planned_assets(refs, "note_id").select(
        "note_id", "image_url", F.col("ord").cast("long").alias("ord"), "file_name"
    )


def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localized(spark, sf_dir)["notes"].select("note_id", "note_text")


QUERIES = {
    f.__name__: f
    for f in (
        image_refs, image_counts, image_filename, asset_lookup, planned_assets, asset_names, image_rewrite,
    )
}

IMAGE = r"""(?:\[!\[([^\]]*)\]\(([^)\s]+(?:\s+"[^"]*")?)\)\]\(([^)]+)\))|(?:!\[([^\]]*)\]\(([^)\s]+(?:\s+"[^"]*")?)\))"""
INNER = r"""!\[([^\]]*)\]\(([^)\s]+(?:\s+"[^"]*")?)\)"""

MARKDOWN = " || ".join(
    "replace(replace('" + reference + "', '{n}', CAST(number AS VARCHAR)), '{lang}', lang) || ' words' || chr(10)"
    for reference in REFERENCES
)

NOTES = rf"""
notes AS (
  SELECT page_id AS note_id, lang, number, title, 'site/' || lang || '/' || lang || ' - articleassets/' || title AS assets_dir,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art,
    art || chr(10) || {MARKDOWN} || art AS note_text
  FROM site_pages),
matches AS (
  SELECT note_id, lang, number, assets_dir, unnest(m) AS full_match, unnest(range(len(m))) AS ord
  FROM (SELECT *, regexp_extract_all(note_text, '{IMAGE}', 0) AS m FROM notes)),
refs AS (
  SELECT *, regexp_extract(full_match, '{INNER}', 1) AS alt_text,
    split_part(regexp_extract(full_match, '{INNER}', 2), ' "', 1) AS image_url,
    CASE WHEN full_match LIKE '[%' THEN 1 ELSE 0 END AS clickable
  FROM matches)"""

PLANNED = r"""
planned AS (
  SELECT note_id, lang, assets_dir, image_url, min(ord) AS ord, min(number) AS number,
    CASE WHEN image_url LIKE '%.png' OR image_url LIKE '%.jpg' THEN parse_filename(image_url, false, '/')
      WHEN image_url LIKE '%pic.jpg?%' THEN 'pic.jpg' WHEN image_url LIKE '%/view/' THEN 'view.png'
      ELSE 'image_' || substring(md5(image_url), 1, 10) || '.png' END AS file_name
  FROM refs WHERE lang <> 'es' AND image_url LIKE 'http%' GROUP BY note_id, lang, assets_dir, image_url)"""

NAMED = r"""
stored AS (SELECT DISTINCT assets_dir FROM notes WHERE lang = 'fr'),
named AS (
  SELECT note_id, assets_dir, image_url,
    CASE WHEN n = 0 THEN file_name ELSE regexp_replace(file_name, '^(.*)(\.[^.]*)$', '\1_' || n || '\2') END AS asset_name
  FROM (
    SELECT p.*, row_number() OVER (PARTITION BY p.assets_dir, file_name ORDER BY note_id, ord) - 1
      + CASE WHEN file_name = 'pic.jpg' AND s.assets_dir IS NOT NULL THEN 1 ELSE 0 END AS n
    FROM planned p LEFT JOIN stored s ON s.assets_dir = p.assets_dir
    WHERE NOT regexp_matches(image_url, '^https://h\d+\.example$') AND NOT regexp_matches(image_url, '/c\d*7\.png$')))"""

ORACLES = {
    "image_refs": i.with_cte(i.SITE_PAGES, NOTES) + """
SELECT note_id, ord, full_match, alt_text, image_url, CAST(clickable AS BIGINT) AS clickable FROM refs""",
    "image_counts": i.with_cte(i.SITE_PAGES, NOTES) + """
SELECT note_id, count(*) AS n_found, CAST(sum(clickable) AS BIGINT) AS n_clickable,
  count(*) FILTER (image_url LIKE 'http%') AS n_remote,
  count(DISTINCT image_url) FILTER (image_url LIKE 'http%') AS n_images
FROM refs GROUP BY note_id""",
    "image_filename": i.with_cte(i.SITE_PAGES) + r""",
n AS (
  SELECT page_id, source, number, regexp_extract(regexp_replace(url, '[?#].*', ''), '([^/]+)/?$', 1) AS last,
    repeat(source || 'é', 12) AS stem
  FROM site_pages)
SELECT page_id, last || '.png' AS from_url, source || 'é+1.JPG' AS from_encoded,
  'image_' || substring(md5('https://' || source || '?' || number), 1, 10) || '.png' AS from_host,
  list_filter(list_transform(range(0, length(stem) // 10 + 1), lambda k: substring(stem, 1, CAST(length(stem) - 10 * k AS INTEGER))),
    lambda s: strlen(s) <= 196)[1] || '.gif' AS from_long
FROM n""",
    "asset_lookup": """
SELECT doc_id, CASE WHEN source LIKE 'src1%'
  THEN 'vault/' || source || '/' || source || ' - articleassets/Doc ' || doc_id ELSE 'none' END AS assets_dir
FROM documents""",
    "planned_assets": i.with_cte(i.SITE_PAGES, NOTES, PLANNED) + "\nSELECT note_id, image_url, ord, file_name FROM planned",
    "asset_names": i.with_cte(i.SITE_PAGES, NOTES, PLANNED, NAMED) + "\nSELECT note_id, assets_dir, image_url, asset_name FROM named",
    "image_rewrite": i.with_cte(i.SITE_PAGES, NOTES, PLANNED, NAMED) + r""",
shown AS (
  SELECT r.note_id, string_agg(
    CASE WHEN a.asset_name IS NULL THEN full_match ELSE '![' || alt_text || '](<' || r.lang || ' - articleassets/'
      || substring(r.assets_dir, length('site/' || r.lang || '/' || r.lang || ' - articleassets/') + 1)
      || '/' || a.asset_name || '>)' END || ' words' || chr(10), '' ORDER BY ord) AS words
  FROM refs r LEFT JOIN named a ON a.note_id = r.note_id AND a.image_url = r.image_url GROUP BY r.note_id)
SELECT n.note_id, art || chr(10) || words || art AS note_text FROM notes n JOIN shown s ON s.note_id = n.note_id""",
}
