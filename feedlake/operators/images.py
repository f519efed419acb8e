"""Local copies of images: references, names, fetch results and rewritten notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.functions import images
from feedlake.operators import joins
from feedlake.operators.lookup import lookup_assets
from feedlake.operators.ranking import AssetNames, assign_names
from feedlake.session import state_dir
from feedlake.sources.snapshots import stage


def references(notes: DataFrame, markdown: str, carry: list[str]) -> DataFrame:
    """One row per image reference, with its position in the note."""
    found = notes.select(*carry, F.posexplode(images.image_refs(F.col(markdown))).alias("_at", "_ref"))
    return found.select(*carry, "_ref.*")


def eligible(refs: DataFrame) -> DataFrame:
    """References of sources with asset settings that point to something remote."""
    return refs.filter(F.col("assets_dir").isNotNull() & images.is_remote(F.col("image_url")))


def reference_counts(refs: DataFrame, note: list[str]) -> DataFrame:
    remote = images.is_remote(F.col("image_url"))
    return refs.groupBy(*note).agg(
        F.count("*").alias("n_found"),
        F.count_if(F.col("is_clickable")).alias("n_clickable"),
        F.count_if(remote).alias("n_remote"),
        F.count_distinct(F.when(remote, F.col("image_url"))).alias("n_images"),
    )


def planned_assets(refs: DataFrame, note: str) -> DataFrame:
    """Each distinct image of a note once, at its first position, with its plain name."""
    return (
        refs.groupBy(note, "assets_dir", "image_url")
        .agg(F.min("ord").alias("ord"))
        .withColumn("file_name", images.image_file_name(F.col("image_url")))
    )


def accepted(planned: DataFrame, fetch_result: DataFrame, note: str) -> DataFrame:
    """Planned images whose fetch succeeded within the limits; one may be in any number of notes."""
    good = fetch_result.filter(
        images.acceptable_image(F.col("ok"), F.col("content_length"), F.col("n_bytes"))
    ).select("image_url")
    return joins.with_known(planned, good, ["image_url"], [note])


def named_assets(planned: DataFrame, asset_manifest: DataFrame, note: str) -> DataFrame:
    """Add ``asset_name``, unique within each assets folder, stored files included."""
    return assign_names(
        planned, asset_manifest, "assets_dir", "file_name", [note, "ord"], AssetNames(), "asset_name"
    )


def rewrite(
    notes: DataFrame, refs: DataFrame, named: DataFrame, note: str, markdown: str, folder: str
) -> DataFrame:
    """Point each localised reference to its file; all others stay as they are.

    The replacements of a note are as many as its text has references, so the
    list per note is bounded by the row it came from.
    """
    local = refs.join(named.select(note, "image_url", "asset_name"), [note, "image_url"], "left")
    path = images.relative_path(F.concat_ws("/", "assets_dir", "asset_name"), F.col(folder))
    new = F.when(F.col("asset_name").isNotNull(), images.local_image(F.col("alt_text"), path))
    replaced = local.groupBy(note).agg(
        F.array_sort(
            F.collect_list(F.struct("ord", F.coalesce(new, F.col("full_match")).alias("new")))
        ).alias("_new")
    )
    return (
        notes.join(replaced, note, "left")
        .withColumn(
            markdown,
            F.when(F.col("_new").isNull(), F.col(markdown)).otherwise(
                images.replace_images(F.col(markdown), F.col("_new.new"))
            ),
        )
        .drop("_new")
    )


def localize_images(
    notes: DataFrame,
    asset_cfg: DataFrame,
    fetch_result: DataFrame,
    asset_manifest: DataFrame,
    note: str = "note_id",
    markdown: str = "note_text",
    title: str = "safe_name",
    folder: str = "vault_folder",
) -> dict[str, DataFrame]:
    """Notes with local image paths, the assets behind them and counts per note.

    ``note`` is a long that sorts notes in writing order. Notes without assets
    settings or references pass through unchanged.
    """
    spark = notes.sparkSession
    placed = lookup_assets(notes, asset_cfg, "source", title, [note])
    # Texts are scanned once; all that follows works on narrow staged rows.
    refs = stage(
        references(placed, markdown, [note, "assets_dir", folder]), state_dir(spark, "image-refs")
    )
    planned = planned_assets(eligible(refs), note)
    fetched = stage(accepted(planned, fetch_result, note), state_dir(spark, "image-names"))
    named = named_assets(fetched, asset_manifest, note)
    configured = refs.filter(F.col("assets_dir").isNotNull())
    local = named.groupBy(note).agg(F.count("*").alias("n_localised"))
    counts = reference_counts(refs, [note]).join(local, note, "left")
    return {
        "notes": rewrite(notes, configured, named, note, markdown, folder),
        "assets": named,
        "planned": planned,
        "counts": counts.fillna(0, ["n_localised"]),
    }
