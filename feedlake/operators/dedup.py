"""Which entries are new, at discovery and against the stored notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.functions import keys
from feedlake.operators import joins
from feedlake.operators.queue import with_url
from feedlake.operators.stubs import NOTE


def discover_new(entries: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """First sighting of each URL that the queue does not know, pending or synced.

    The batch is reduced to one row per key first; its keys then pick what the anti
    join needs of the queue.
    """
    keyed = with_url(entries, "link").withColumn("_key", keys.discovery_key(F.col("link")))
    first = joins.first_per_key(keyed, ["_key"], order)
    tracked = known.select(keys.discovery_key(F.col("url")).alias("_key"))
    return first.join(joins.present_keys(keyed, tracked, ["_key"]), "_key", "left_anti").drop("_key")


def unseen(rows: DataFrame, notes: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows without a note in their folder; duplicates within the batch stay."""
    return joins.without_known(rows, notes, ["vault_folder", "url_key"], spread_by)


def already_stored(rows: DataFrame, notes: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows that have a note in their folder."""
    return joins.with_known(rows, notes, ["vault_folder", "url_key"], spread_by)


def with_stored_flag(rows: DataFrame, notes: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows with ``is_stored``: whether their folder has a note for their key."""
    return joins.flag_known(rows, notes, ["vault_folder", "url_key"], spread_by, "is_stored")


def free_of_earlier_notes(
    rows: DataFrame, spread_by: list[str], taken: DataFrame | None = None
) -> DataFrame:
    """Drop rows of a later feed whose key an earlier feed wrote in this run.

    Feeds run in their configured order and may share a folder. Only notes among the
    rows ``taken`` (all, if not given) block a later feed; a held-back stub does not.
    """
    key = ["vault_folder", "url_key"]
    written = (rows if taken is None else taken).filter(F.col("route") == NOTE)
    writers = written.groupBy(*key).agg(F.min("feed_ord").alias("_writer"))
    free = F.col("_writer").isNull() | (F.col("feed_ord") <= F.col("_writer"))
    return joins.spread_join(rows, writers, key, spread_by, "left").filter(free).drop("_writer")
