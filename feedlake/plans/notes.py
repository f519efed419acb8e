"""Steps that the direct sync and the drain share: from routed articles to notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.functions import text
from feedlake.operators.articles import tagged
from feedlake.operators.images import localize_images
from feedlake.operators.queue import run_time
from feedlake.operators.ranking import NoteNames, assign_names


def named_notes(writers: DataFrame, stored: DataFrame) -> DataFrame:
    """``(seq, note_name)`` for narrow rows ``(seq, vault_folder, safe_name)``."""
    taken = stored.select("vault_folder", F.col("note_name").alias("safe_name"))
    return assign_names(
        writers, taken, "vault_folder", "safe_name", ["seq"], NoteNames(), "note_name"
    ).select("seq", "note_name")


def planned_names(rows: DataFrame) -> DataFrame:
    """What a preview reports: plain file names, without a look at stored notes."""
    path = F.concat_ws("/", "vault_folder", "safe_name")
    return rows.select("seq", "feed_ord", "entry_ord", "title", path.alias("rel_path"))


def built_notes(
    articles: DataFrame, names: DataFrame, published: Column, clipped
) -> DataFrame:
    """Notes of the articles that have a name; all their text is built in one projection."""
    stamp = run_time(clipped)
    rows = tagged(articles.join(names, "seq"), "md", "page_tags")
    rows = rows.withColumns({"published": published, "clipped": stamp})
    note = text.note_text(
        F.col("link"),
        F.col("author"),
        F.col("published"),
        text.iso_time(stamp),
        F.col("source"),
        F.col("parser"),
        F.col("tags"),
        F.col("md"),
    )
    path = F.concat(F.col("vault_folder"), F.lit("/"), F.col("note_name"), F.lit(".md"))
    return rows.select(
        "seq",
        "vault_folder",
        "url_key",
        "note_name",
        "safe_name",
        text.path_without_suffix(path).alias("rel_path"),
        "feed_ord",
        "entry_ord",
        "link",
        "title",
        "author",
        "published",
        "clipped",
        "source",
        F.col("parser").alias("feed_kind"),
        "tags",
        note.alias("note_text"),
    )


def with_local_images(
    notes: DataFrame,
    asset_cfg: DataFrame | None,
    fetch_result: DataFrame | None,
    asset_manifest: DataFrame | None,
) -> dict[str, DataFrame]:
    """Notes after image localisation; unchanged if no assets are configured."""
    if asset_cfg is None or fetch_result is None:
        return {"notes": notes}
    if asset_manifest is None:
        empty = "assets_dir string, file_name string"
        asset_manifest = notes.sparkSession.createDataFrame([], empty)
    return localize_images(notes, asset_cfg, fetch_result, asset_manifest, note="seq")
