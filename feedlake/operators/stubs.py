"""Held-back teasers: the guard, the records and the manifest's life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.functions import keys, text
from feedlake.operators import joins
from feedlake.operators.queue import run_time

# --- Fixed value: shortest fallback text that counts as an article --------------
MIN_FALLBACK_CHARS = 1500
# ---------------------------------------------------------------------------------

NOTE, STUB = "note", "stub"

# Facts of a stub that stay as first recorded.
KEPT = ["url", "title", "source", "parser", "published", "vault_folder"]


def route(page_md: Column, fallback_md: Column) -> Column:
    """Where an article goes. Only the feed's own text is measured, never a page's."""
    return (
        F.when(page_md.isNotNull(), F.lit(NOTE))
        .when(F.length(fallback_md) < MIN_FALLBACK_CHARS, F.lit(STUB))
        .otherwise(F.lit(NOTE))
    )


def stub_records(rows: DataFrame) -> DataFrame:
    """Records of the rows routed to stubs; expects the entry and its feed's settings."""
    return rows.filter(F.col("route") == STUB).select(
        F.col("link").alias("url"),
        "title",
        "source",
        "parser",
        text.published_text(F.col("published_parsed"), F.col("published_raw")).alias("published"),
        "vault_folder",
        F.length("md").cast("long").alias("body_chars"),
        "feed_ord",
        "entry_ord",
    )


def fold_sightings(sightings: DataFrame, key: list[str], ts: str, order: list[str]) -> DataFrame:
    """First and last time and latest length per key; partial results before the shuffle."""
    return sightings.groupBy(*key).agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.max_by("body_chars", F.struct(*order)).alias("body_chars"),
    )


def run_stubs(records: DataFrame, run_ts) -> DataFrame:
    """One row per key of a run's stub records: facts of its first, length of its last."""
    seen = F.struct("feed_ord", "entry_ord")
    now = run_time(run_ts)
    return (
        records.withColumn("url_key", keys.vault_key(F.col("url")))
        .groupBy("url_key")
        .agg(
            F.min_by(F.struct(*KEPT), seen).alias("_first"),
            F.max_by("body_chars", seen).alias("body_chars"),
        )
        .select(
            "url_key",
            "_first.*",
            "body_chars",
            now.alias("first_seen"),
            now.alias("last_seen"),
        )
    )


def upsert(manifest: DataFrame, seen: DataFrame, key: str = "url_key") -> DataFrame:
    """Known keys keep their facts and first time; length and last time are renewed."""
    old, new = manifest.alias("old"), seen.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    renewed = {"body_chars", "last_seen"}
    known = F.col(f"old.{key}").isNotNull()

    def pick(name: str) -> Column:
        if name in renewed:
            return F.coalesce(F.col(f"new.{name}"), F.col(f"old.{name}"))
        return F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))

    return joined.select(*(pick(name).alias(name) for name in manifest.columns))


def drop_captured(manifest: DataFrame, notes: DataFrame) -> DataFrame:
    """Entries for which no note exists in their folder; no folder means the root."""
    here = F.coalesce("vault_folder", F.lit("")).alias("_folder")
    entries = manifest.withColumn("_folder", here)
    stored = notes.select(here, "url_key")
    present = joins.present_keys(entries, stored, ["_folder", "url_key"])
    return entries.join(present, ["_folder", "url_key"], "left_anti").select(*manifest.columns)


def update_manifest(manifest: DataFrame, records: DataFrame, notes: DataFrame, run_ts) -> DataFrame:
    """The manifest after a run: fold in its stubs, then drop what has been captured."""
    return drop_captured(upsert(manifest, run_stubs(records, run_ts)), notes)


def manifest_size(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("n_stubs"))


def oldest_first(manifest: DataFrame) -> DataFrame:
    """Presentation order; a missing time sorts first."""
    return manifest.orderBy(F.asc_nulls_first("first_seen"), "url_key")
