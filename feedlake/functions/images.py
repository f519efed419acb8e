"""Image references in Markdown and the names of their local copies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedlake.functions.binding import let

# --- Fixed values: suffixes, limits and patterns that decide the results ---------
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico")
DEFAULT_SUFFIX = ".png"
NAME_BYTES = 200
NAME_STEP = 10
MAX_IMAGE_BYTES = 10 * 1024 * 1024
CLICKABLE_IMAGE = r"\[!\[([^\]]*)\]\(([^)\s]+(?:\s+\"[^\"]*\")?)\)\]\(([^)]+)\)"
PLAIN_IMAGE = r"!\[([^\]]*)\]\(([^)\s]+(?:\s+\"[^\"]*\")?)\)"
# ---------------------------------------------------------------------------------

ANY_IMAGE = f"(?U)(?:{CLICKABLE_IMAGE})|(?:{PLAIN_IMAGE})"
SUFFIX = r"(?s)^\.*[^.].*(\.[^.]+)$"
UNKNOWN_SUFFIX = r"(?is)\A(?!\.*[^.].*(?:{})\z).*\z".format(
    "|".join(suffix.replace(".", r"\.") for suffix in IMAGE_SUFFIXES)
)


def image_refs(markdown: Column) -> Column:
    """All image references in reading order, as an array of structs."""
    matches = F.regexp_extract_all(markdown, F.lit(ANY_IMAGE), F.lit(0))
    inner = f"(?U){PLAIN_IMAGE}"
    return F.transform(
        matches,
        lambda text, at: F.struct(
            at.alias("ord"),
            text.alias("full_match"),
            F.regexp_extract(text, inner, 1).alias("alt_text"),
            without_link_title(F.regexp_extract(text, inner, 2)).alias("image_url"),
            text.startswith("[").alias("is_clickable"),
        ),
    )


def without_link_title(url: Column) -> Column:
    return F.substring_index(url, ' "', 1)


def is_remote(url: Column) -> Column:
    """True for what can be fetched: neither inline data nor a local path."""
    return url.startswith("http")


def name_suffix(name: Column) -> Column:
    return F.regexp_extract(name, SUFFIX, 1)


def name_stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(name_suffix(name)))


def percent_decoded(text: Column) -> Column:
    """Percent-decode; a plus sign and incomplete escapes stay as they are."""
    whole = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), text)


def url_file_name(url: Column) -> Column:
    """Last part of the URL's path; null if the path has none."""
    bare = F.regexp_replace(url, r"(?s)[?#].*", "")
    path = F.regexp_extract(bare, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1)
    path = percent_decoded(F.regexp_replace(path, r";[^/]*$", ""))
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    return F.try_element_at(parts, F.lit(-1))


def with_image_suffix(name: Column) -> Column:
    """Append the default suffix to names without a known one."""
    return F.regexp_replace(name, UNKNOWN_SUFFIX, f"$0{DEFAULT_SUFFIX}")


def shortened(name: Column) -> Column:
    """Shorten the stem in fixed steps until the name fits the byte limit."""

    def fit(part: Column) -> Column:
        stem, suffix = part["stem"], part["suffix"]
        room = NAME_BYTES - F.octet_length(suffix)
        lengths = F.sequence(F.length(stem), F.length(stem) % NAME_STEP, F.lit(-NAME_STEP))
        fitting = F.filter(
            lengths, lambda n: F.octet_length(F.substring(stem, F.lit(1), n)) <= room
        )
        return F.concat(F.substring(stem, F.lit(1), F.get(fitting, 0)), suffix)

    return let(F.struct(name_stem(name).alias("stem"), name_suffix(name).alias("suffix")), fit)


def bounded_name(name: Column) -> Column:
    return let(
        name, lambda n: F.when(F.octet_length(n) <= NAME_BYTES, n).otherwise(shortened(n))
    )


def image_file_name(url: Column) -> Column:
    """File name for an image URL; a name from the URL's hash if it states none."""
    hashed = F.concat(F.lit("image_"), F.substring(F.md5(url), 1, 10), F.lit(DEFAULT_SUFFIX))
    return bounded_name(with_image_suffix(F.coalesce(url_file_name(url), hashed)))


def acceptable_image(ok: Column, content_length: Column, n_bytes: Column) -> Column:
    """A fetched image counts if it is neither empty nor above the size limit."""
    return F.coalesce(
        ok
        & (F.coalesce(content_length, F.lit(0)) <= MAX_IMAGE_BYTES)
        & n_bytes.between(1, MAX_IMAGE_BYTES),
        F.lit(False),
    )


def assets_dir(folder: Column, subfolder: Column, title: Column) -> Column:
    return F.concat(folder, F.lit("/"), subfolder, F.lit("/"), title)


def relative_path(path: Column, folder: Column) -> Column:
    """Path seen from a folder; unchanged if it lies elsewhere."""
    inside = path.startswith(F.concat(folder, F.lit("/")))
    return F.when(
        inside, F.substring(path, F.length(folder) + 2, F.length(path))
    ).otherwise(path)


def markdown_path(path: Column) -> Column:
    """Angle brackets around paths that Markdown would otherwise break."""
    return F.when(path.rlike("[ ()]"), F.concat(F.lit("<"), path, F.lit(">"))).otherwise(path)


def local_image(alt_text: Column, path: Column) -> Column:
    return F.concat(F.lit("!["), alt_text, F.lit("]("), markdown_path(path), F.lit(")"))


def replace_images(markdown: Column, replacements: Column) -> Column:
    """Put the n-th replacement in place of the n-th image reference."""
    pieces = F.split(markdown, ANY_IMAGE, -1)
    joined = F.zip_with(
        pieces, replacements, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit("")))
    )
    return F.array_join(joined, "")
