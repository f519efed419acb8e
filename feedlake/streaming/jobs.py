"""The streams as jobs: each call polls once, takes what has landed since, and stops.

A job keeps its checkpoint, with the keyed state, and what its batches wrote below one path.
A batch writes its own directory, so that one that is run again after a failure
replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedlake.operators.queue import run_time
from feedlake.session import RESERVES, ROCKS_DB, STATE_STORE, setting
from feedlake.sources.feeds import entries_of, parsed_files
from feedlake.sources.snapshots import read_snapshot
from feedlake.streaming import state

BATCH = "batch_id"


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that a job's batches wrote, with the number of their batch."""
    return read_snapshot(spark, path, StructType.fromDDL(schema).add(BATCH, "long"))


def _poll(rows: DataFrame, path: str, name: str, mode: str) -> dict:
    """Run a stream over what has landed and write each batch; rows read, and observed metrics."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={number}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    # Spark's default store knows no keyed processors, and the session may be another's; a stream copies its settings.
    spark = rows.sparkSession
    with setting(spark, STATE_STORE, ROCKS_DB), setting(spark, RESERVES, "false"):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    metrics: dict = {"rows_read": sum(p["numInputRows"] for p in progress)}
    for observed in (p["observedMetrics"] for p in progress):
        for values in observed.values():
            for key, value in values.asDict().items():
                metrics[key] = metrics.get(key, 0) + (value or 0)
    return metrics


def discover(entries: DataFrame, synced: DataFrame, path: str, keep_days: int) -> dict:
    """New URLs of the landed entries, each once until ``keep_days`` after it was synced."""
    events = state.entry_events(entries).unionByName(state.synced_events(synced))
    return _poll(state.new_urls(events, keep_days), path, "found", "append")


def poll_feeds(spark: SparkSession, landing: str, run_ts, path: str, keep_days: int, synced: DataFrame | None = None) -> dict:
    """Poll a folder of feed files ``<feed_ord>.xml`` or ``<feed_ord>-….xml`` for new URLs."""
    files = spark.readStream.option("wholetext", True).text(landing).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("feed_ord"),
        F.col("value").alias("_xml"),
    )
    return poll_files(files, "_xml", run_ts, path, keep_days, synced)


def poll_files(files: DataFrame, xml: str, run_ts, path: str, keep_days: int, synced: DataFrame | None = None) -> dict:
    """Read the feed files that have landed in a stream (feed_ord and text), and find new URLs.

    A file is read once, in the poll after it landed, and its entries are seen at that poll's time.
    Returns the health of the poll: files read, files without any readable item, items.
    """
    parsed = parsed_files(files, xml, ["feed_ord"]).observe(
        "feed_health",
        F.count("*").alias("n_files"),
        F.count_if(F.size("items") == 0).alias("n_unreadable"),
        F.sum(F.size("items")).alias("n_items"),
    )
    entries = entries_of(parsed, ["feed_ord"]).withColumn("seen_at", run_time(run_ts))
    events = state.entry_events(entries)
    if synced is not None:
        events = events.unionByName(state.synced_events(synced))
    return _poll(state.new_urls(events, keep_days), path, "found", "append")


def captured_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys that batches so far saw captured: narrow rows, read by key."""
    return written(spark, f"{path}/changes", state.STUB).filter("captured").select("url_key").distinct()


def hold_stubs(events: DataFrame, path: str, stored: DataFrame | None = None) -> dict:
    """Fold a poll's sightings and captures into the held-back stubs.

    Sightings of keys that have a note are left out: those in ``stored`` (url_key), if it is given,
    or else those that this job saw captured in earlier polls.
    """
    spark = events.sparkSession
    noted = captured_keys(spark, path) if stored is None else stored.select("url_key").distinct()
    fresh = events.join(noted.withColumn("_noted", F.lit(True)), "url_key", "left")
    fresh = fresh.filter(F.col("_noted").isNull() | (F.col("kind") == state.CAPTURED)).drop("_noted")
    return _poll(state.stub_changes(fresh), path, "changes", "update")


def held_stubs(spark: SparkSession, path: str) -> DataFrame:
    """Stubs that are held back now, straight from the state store."""
    reader = spark.read.format("statestore").option("stateVarName", "stub")
    stubs = F.arrays_zip(*(f"user_map_value.{name}" for name in ("url_key", "first_seen", "last_seen", "body_chars")))
    stored = reader.load(f"{path}/checkpoint").select(F.inline(stubs))
    return stored.withColumns({name: F.timestamp_micros(name) for name in ("first_seen", "last_seen")})


def complete_rows(events: DataFrame, path: str) -> dict:
    """Complete the queue rows whose page has landed, in this poll or before; the others wait."""
    return _poll(state.completed_rows(events), path, "done", "append")

