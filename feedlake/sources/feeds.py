"""Feed configuration and landed feed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake import schemas
from feedlake.functions import text
from feedlake.operators.joins import spread_join

# A marked section is one unit: no tag, comment or ampersand within it counts.
SECTION = r"<!\[CDATA\[.*?\]\]>"

# Comments, outside of marked sections, are no part of a feed.
COMMENT = r"(?s)(" + SECTION + r")|<!--.*?-->"

# One item (RSS) or entry (Atom), read by itself: a fault elsewhere in its file
# does not cost the other items. It ends at its end tag; one without ends where the
# next one begins, its feed ends or the file is cut off. The possessive loop neither
# backtracks nor recurses, however long the item is.
ITEM_BLOCK = (
    r"(?s)<(item|entry)(?:\s[^>]*)?(?<!/)>(?:[^<]++|" + SECTION + r"|<(?!/?\1[\s>]|/(?:channel|feed|rss)\s*>))*+(?:</\1\s*>)?"
)

# An item cut at its marked sections; an unfinished one is plain text.
ITEM_PIECES = r"(?s)" + SECTION + r"|(?:[^<]++|<(?!!\[CDATA\[))++|<"

# Elements whose text may be markup, and the others that an entry is made of.
TEXTS = "title|description|summary|content:encoded|content"
OTHERS = "link|guid|author|dc:creator|pubDate|published"


def element(names: str) -> str:
    """Pattern of a whole element with one of these names: its name and attributes, and what it holds."""
    return rf"<({names})(?=[\s>])([^>]*)(?<!/)>((?:[^<]++|{SECTION}|<(?!/\1\s*>))*+)</\1\s*>"


TEXT_ELEMENT = r"(?s)" + element(TEXTS)
# A text element or what stands before the next one.
TEXT_PIECES = TEXT_ELEMENT + rf"|(?:[^<]++|{SECTION}|<(?!(?:{TEXTS})[\s>]))++|<"
# What a text element holds has tags of its own.
HAS_TAGS = rf"(?s)^(?:[^<]++|{SECTION})*+<"
WHOLE_ELEMENTS = rf"(?s){element(TEXTS + '|' + OTHERS)}|<link\s[^>]*/>"

BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)"

ITEM_SCHEMA = """
    title struct<_VALUE string>,
    link array<struct<_VALUE string, _href string, _rel string>>,
    guid struct<_VALUE string, _isPermaLink string>,
    author array<struct<_VALUE string, name string>>,
    `dc:creator` string,
    pubDate string,
    published string,
    `content:encoded` array<string>,
    content array<struct<_VALUE string>>,
    description string,
    summary struct<_VALUE string>
"""


def explode_config(config: DataFrame, root: str | None = None) -> DataFrame:
    """One row per configured feed, in file order, with the defaults filled in."""
    folder = F.col("feed.vault_folder")
    if root is not None:
        folder = F.concat(F.lit(root.rstrip("/") + "/"), folder)
    days = F.coalesce("settings.keep_synced_days", F.lit(text.DEFAULT_KEEP_DAYS))
    carried = [name for name in config.columns if name not in ("feeds", "settings")]
    return config.select(
        *carried, F.posexplode("feeds").alias("feed_ord", "feed"), days.alias("keep_synced_days")
    ).select(
        *carried,
        F.col("feed_ord").cast("long").alias("feed_ord"),
        "feed.name",
        "feed.source",
        text.parser_or_default(F.col("feed.parser")).alias("parser"),
        "feed.rss_url",
        folder.alias("vault_folder"),
        "keep_synced_days",
    )


def if_present(load: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``load`` reads; None if there is nothing at its path."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_config(
    spark: SparkSession, path: str, root: str | None = None, defaults: DataFrame | None = None
) -> DataFrame:
    """Feeds of a configuration file; ``defaults`` if there is no such file."""
    reader = spark.read.schema(schemas.FEED_CONFIG).option("multiLine", True)
    if defaults is None:
        return explode_config(reader.json(path), root)
    config = if_present(lambda: reader.json(path))
    return defaults if config is None else explode_config(config, root)


def with_plain_ampersands(block: Column) -> Column:
    """Ampersands that start no XML entity as text; marked sections stay as they are."""
    pieces = F.regexp_extract_all(block, F.lit(ITEM_PIECES), F.lit(0))
    repaired = F.transform(
        pieces,
        lambda piece: F.when(piece.startswith("<![CDATA["), piece).otherwise(
            F.regexp_replace(piece, BARE_AMPERSAND, "&amp;")
        ),
    )
    return F.when(block.contains("&"), F.array_join(repaired, "")).otherwise(block)


def with_markup_as_text(block: Column) -> Column:
    """Text elements that hold tags, unescaped or as XHTML: what they hold as one marked section."""

    def wrapped(piece: Column) -> Column:
        held = F.regexp_extract(piece, TEXT_ELEMENT, 3)
        plain = F.replace(F.replace(held, F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
        name, attributes = F.regexp_extract(piece, TEXT_ELEMENT, 1), F.regexp_extract(piece, TEXT_ELEMENT, 2)
        whole = F.concat(F.lit("<"), name, attributes, F.lit("><![CDATA["), plain, F.lit("]]></"), name, F.lit(">"))
        return F.when(held.rlike(HAS_TAGS), whole).otherwise(piece)

    pieces = F.regexp_extract_all(block, F.lit(TEXT_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, wrapped), "")


def read_item(inner: Column) -> Column:
    item = F.concat(F.lit("<item>"), with_plain_ampersands(inner), F.lit("</item>"))
    return F.from_xml(item, ITEM_SCHEMA, {"rowTag": "item", "mode": "PERMISSIVE"})


def readable(item: Column) -> Column:
    """Whether an item has any field; what is rejected comes back without."""
    return F.to_json(item) != "{}"


def items_of(xml: Column) -> Column:
    """The items of a feed file that can be read: a list of place and fields ``i``.

    What is rejected as a whole, for a stray tag or a cut-off end, is read again from the
    elements in it that are whole.
    """
    blocks = F.regexp_extract_all(F.regexp_replace(xml, COMMENT, "$1"), F.lit(ITEM_BLOCK), F.lit(0))
    ends = r"(?s)^<(?:item|entry)(?:\s[^>]*)?>|</(?:item|entry)\s*>$"
    inner = F.transform(blocks, lambda block: with_markup_as_text(F.regexp_replace(block, ends, "")))
    # Each step is a list of its own, so that no item is read twice.
    tried = F.transform(inner, lambda one: F.struct(one.alias("inner"), read_item(one).alias("whole")))
    elements = lambda one: F.array_join(F.regexp_extract_all(one["inner"], F.lit(WHOLE_ELEMENTS), F.lit(0)), "")
    found = F.transform(
        tried,
        lambda one, place: F.struct(
            place.cast("long").alias("entry_ord"),
            F.when(readable(one["whole"]), one["whole"]).otherwise(read_item(elements(one))).alias("i"),
        ),
    )
    return F.filter(found, lambda one: readable(one["i"]))


def parsed_files(files: DataFrame, xml: str, carry: list[str]) -> DataFrame:
    """``items``: the readable items of each file."""
    return files.select(*carry, items_of(F.col(xml)).alias("items"))


def entries_of(parsed: DataFrame, carry: list[str]) -> DataFrame:
    """Entries of parsed files, one row each."""
    return parsed.select(*carry, F.inline("items")).select(*carry, "entry_ord", *_entry_columns())


def parse_feed_files(files: DataFrame, xml: str, carry: list[str]) -> DataFrame:
    """Entries of whole feed files, in file order.

    A malformed or cut-off file still gives its readable items; one without any gives none.
    Comments and what stands in them are no items. Markup in a title, summary or content is
    its text, escaped or not. What cannot be read of an item is null; without a link it is no
    entry. A file is one row, as it was landed: a feed has few items.
    """
    return entries_of(parsed_files(files, xml, carry), carry)


def _entry_columns() -> list[Column]:
    i = F.col("i")
    page_link = F.filter(
        i["link"],
        lambda one: one["_VALUE"].isNotNull()
        | (F.coalesce(one["_rel"], F.lit("alternate")) == "alternate"),
    )
    first = F.get(page_link, 0)
    permanent = F.when(
        F.lower(F.coalesce(i["guid"]["_isPermaLink"], F.lit("true"))) != "false", i["guid"]["_VALUE"]
    )
    people = F.transform(i["author"], lambda one: F.struct(F.coalesce(one["name"], one["_VALUE"]).alias("name")))
    published = F.coalesce(i["pubDate"], i["published"])
    content = F.transform(
        F.coalesce(i["content:encoded"], F.transform(i["content"], lambda one: one["_VALUE"])),
        lambda value: F.struct(value.alias("value")),
    )
    return [
        F.trim(F.coalesce(first["_VALUE"], first["_href"], permanent)).alias("link"),
        i["title"]["_VALUE"].alias("title"),
        F.coalesce(i["dc:creator"], F.get(people, 0)["name"]).alias("author"),
        people.alias("authors"),
        published.alias("published_raw"),
        text.parse_feed_time(published).alias("published_parsed"),
        content.alias("content"),
        F.coalesce(i["description"], i["summary"]["_VALUE"]).alias("summary"),
    ]


def read_feed_files(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """Entries of landed feed files ``<feed_ord>.xml``, with the settings of their feed."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"(\d+)\.[^/.]+$", 1).cast("long").alias("feed_ord"),
        F.col("value").alias("_xml"),
    )
    return with_feed(parse_feed_files(files, "_xml", ["feed_ord"]), feeds)


def with_feed(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Entries with the source, parser and folder of their feed, however many it has."""
    settings = feeds.select("feed_ord", "source", "parser", "vault_folder")
    return spread_join(entries, settings, ["feed_ord"], ["entry_ord"], "inner")


def healthy_feeds(files: DataFrame, xml: str, keys: list[str]) -> DataFrame:
    """``keys`` of feed files with the count of items that can be read, where there are any."""
    size = F.size("items").cast("long")
    counted = parsed_files(files, xml, keys).select(*keys, size.alias("n_items")).filter("n_items > 0")
    return counted.groupBy(*keys).agg(F.sum("n_items").alias("n_items"))
