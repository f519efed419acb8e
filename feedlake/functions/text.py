"""Text functions as Spark columns (titles, dates, frontmatter, Markdown clean-up)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from feedlake.functions.binding import let

# --- Fixed values: patterns, limits and formats that decide the results ---------
MALFORMED_ENTITY = r"&(x?[0-9A-Fa-f]+;)"
UNSAFE_CHARACTERS = '/\\:|?*"<>'
UNSAFE_REPLACEMENT = "–"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TITLE_LIMIT = 200
CATEGORY_LINE = r"(?dmU)^- \[.*?\]\(/[\w-]+/blog/category/([\w-]+)\)\s*$"
CATEGORY_MARK = "/blog/category/"
EMPTY_HEADING = r"(?dmU)^#+\s*$\n?"
BLANK_LINES = r"\n{3,}"
FRONTMATTER = r"(?s)\A---(.*?)---"
FRONTMATTER_LINK = r"(?imU)^[\s&&[^\n\r]]*link:(.*)$"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ssxxx"
DEFAULT_PARSER = "wordpress"
DEFAULT_TITLE = "Untitled"
DEFAULT_KEEP_DAYS = 90
# ---------------------------------------------------------------------------------

# Date forms found in feeds besides ISO-8601, by their shape after the week day. The shape
# picks one form per text: a failed attempt at parsing costs far more than a pattern.
FEED_DATE_FORMS = {
    r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$": "d MMM yyyy HH:mm:ss xx",
    r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [A-Za-z]+$": "d MMM yyyy HH:mm:ss zzz",
    r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d [+-]\d{4}$": "d MMM yyyy HH:mm xx",
    r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d [A-Za-z]+$": "d MMM yyyy HH:mm zzz",
}


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_unescape_udf = F.pandas_udf(_unescape, T.StringType())


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(BLANKS))


def repair_entities(text: Column) -> Column:
    """Put back the ``#`` that numeric entities lost."""
    return F.regexp_replace(text, MALFORMED_ENTITY, "&#$1")


def decode_entities(text: Column) -> Column:
    """Decode named and numeric HTML entities.

    Only texts with an ampersand carry their content into the Python worker; all
    others travel as null and keep their own value.
    """
    return F.coalesce(_unescape_udf(F.when(text.contains("&"), text)), text)


def safe_characters(text: Column) -> Column:
    """Replace each character that file names cannot hold by an en dash."""
    return F.translate(text, UNSAFE_CHARACTERS, UNSAFE_REPLACEMENT * len(UNSAFE_CHARACTERS))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))


def cut_title(text: Column) -> Column:
    """Cut at the limit and drop the last, partial word if there are several."""
    cut = F.regexp_replace(F.substring(text, 1, TITLE_LIMIT), " [^ ]*$", "")
    return F.when(F.length(text) > TITLE_LIMIT, cut).otherwise(text)


def sanitize_title(title: Column) -> Column:
    """File name (without suffix) of a title."""
    decoded = decode_entities(repair_entities(title))
    return cut_title(collapse_whitespace(safe_characters(decoded)))


def frontmatter_link(note_text: Column) -> Column:
    """Link stated in a note's frontmatter; null if there is none."""
    head = F.regexp_extract(note_text, FRONTMATTER, 1)
    value = strip(F.regexp_extract(head, FRONTMATTER_LINK, 1))
    value = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
    return F.when(note_text.startswith("---"), F.nullif(value, F.lit("")))


def absolute_links(page: Column) -> Column:
    """Give protocol-relative ``src`` and ``href`` attributes the https scheme."""
    for attribute in ("src", "href"):
        page = F.regexp_replace(
            page, rf"(?i)(<[a-z][^<>]*?\s{attribute}\s*=\s*[\"']?)//", "$1https://"
        )
    return page


# Most texts hold none of what the patterns below look for. A plain search tells so
# at a fraction of a pattern's cost.


def squeeze_blank_lines(markdown: Column) -> Column:
    return let(
        markdown,
        lambda md: F.when(
            md.contains("\n\n\n"), F.regexp_replace(md, BLANK_LINES, "\n\n")
        ).otherwise(md),
    )


def category_slugs(markdown: Column) -> Column:
    """Tags stated as category links on lines of their own."""
    found = F.regexp_extract_all(markdown, F.lit(CATEGORY_LINE), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when(markdown.contains(CATEGORY_MARK), found).otherwise(none)


def without_categories(markdown: Column) -> Column:
    cleaned = let(
        markdown,
        lambda md: F.when(
            md.contains(CATEGORY_MARK), F.regexp_replace(md, CATEGORY_LINE, "")
        ).otherwise(md),
    )
    return squeeze_blank_lines(cleaned)


def without_empty_headings(markdown: Column) -> Column:
    cleaned = let(
        markdown,
        lambda md: F.when(
            md.startswith("#") | md.contains("\n#"), F.regexp_replace(md, EMPTY_HEADING, "")
        ).otherwise(md),
    )
    return squeeze_blank_lines(cleaned)


def tidy_markdown(markdown: Column) -> Column:
    """Clean-up that follows the conversion from HTML."""
    return strip(without_empty_headings(squeeze_blank_lines(markdown)))


def iso_time(ts: Column) -> Column:
    """ISO-8601 text with a colon in the offset, to the second."""
    return F.date_format(ts, ISO_FORMAT)


def parse_feed_time(raw: Column) -> Column:
    """Timestamp of a feed date (RFC 822 or ISO-8601); null if it is neither."""
    text = F.trim(raw)
    day = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    tries = [
        F.when(day.rlike(shape), F.try_to_timestamp(day, F.lit(form)))
        for shape, form in FEED_DATE_FORMS.items()
    ]
    return F.coalesce(*tries, F.try_to_timestamp(text))


def published_text(parsed: Column, raw: Column) -> Column:
    """Published date as text: the parsed time, else the feed's text, else empty."""
    return F.coalesce(iso_time(parsed), raw, F.lit(""))


def pick_author(author: Column, authors: Column) -> Column:
    return F.coalesce(F.nullif(author, F.lit("")), F.get(authors, 0)["name"], F.lit(""))


def parser_or_default(parser: Column) -> Column:
    return F.coalesce(parser, F.lit(DEFAULT_PARSER))


def title_or_default(title: Column) -> Column:
    return F.coalesce(title, F.lit(DEFAULT_TITLE))


def union_tags(*tag_lists: Column) -> Column:
    """Union of tag lists in order, without regard to case; the first spelling stays.

    One pass carries the keys seen so far along with the tags kept, so that no
    step looks at the whole input again.
    """
    none = F.array().cast("array<string>")

    def keep_new(kept: Column, raw: Column) -> Column:
        tag = strip(raw)
        key = F.lower(tag)
        known = (key == "") | F.array_contains(kept["keys"], key)
        longer = F.struct(
            F.array_append(kept["keys"], key).alias("keys"),
            F.array_append(kept["tags"], tag).alias("tags"),
        )
        return F.when(known, kept).otherwise(longer)

    start = F.struct(none.alias("keys"), none.alias("tags"))
    return F.aggregate(F.concat(*tag_lists), start, keep_new, lambda kept: kept["tags"])


def tag_lines(tags: Column) -> Column:
    """The YAML lines of a tag list; the bare key when it is empty."""
    items = F.transform(tags, lambda tag: F.concat(F.lit('\n  - "'), tag, F.lit('"')))
    return F.concat(F.lit("tags:"), F.coalesce(F.array_join(items, ""), F.lit("")))


def note_text(
    link: Column,
    author: Column,
    published: Column,
    clipped: Column,
    source: Column,
    feed_kind: Column,
    tags: Column,
    markdown: Column,
) -> Column:
    """The assembled note: frontmatter, heading and body."""
    return F.concat(
        F.lit("---\nlink: "),
        link,
        F.lit("\nauthor: "),
        author,
        F.lit("\npublished: "),
        published,
        F.lit("\nclipped: "),
        clipped,
        F.lit("\nsource: "),
        source,
        F.lit("\nfeed_kind: "),
        feed_kind,
        F.lit("\n"),
        tag_lines(tags),
        F.lit("\n---\n\n# Content\n\n"),
        markdown,
        F.lit("\n"),
    )


def path_without_suffix(path: Column) -> Column:
    """Path of a note as links name it."""
    return F.replace(path, F.lit(".md"), F.lit(""))


def record_json(*columns: str) -> Column:
    """One record as JSON text; characters beyond ASCII stay as they are."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
