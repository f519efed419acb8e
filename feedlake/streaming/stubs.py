"""Life cycle of held-back stubs over a stream of sightings and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedlake.sources.snapshots import read_snapshot

SEEN, CAPTURED = "seen", "captured"

STATE = (
    "url_key string, first_seen timestamp, last_seen timestamp, body_chars long, captured boolean"
)


def stub_state(events: DataFrame) -> DataFrame:
    """State per key from ``(url_key, kind, ts, event_id, body_chars)``.

    The whole life cycle is an aggregate: first and last sighting, the latest
    length, and whether a capture ever came. Spark forms partial states before the
    shuffle and keeps them in its state store; batch and stream share the plan.
    """
    seen = F.col("kind") == SEEN
    return events.groupBy("url_key").agg(
        F.min(F.when(seen, F.col("ts"))).alias("first_seen"),
        F.max(F.when(seen, F.col("ts"))).alias("last_seen"),
        F.max_by("body_chars", F.when(seen, F.struct("ts", "event_id"))).alias("body_chars"),
        F.bool_or(~seen).alias("captured"),
    )


def open_stubs(state: DataFrame) -> DataFrame:
    """Keys seen as stubs and not captured yet."""
    still = F.col("first_seen").isNotNull() & ~F.col("captured")
    return state.filter(still).select("url_key", "first_seen", "last_seen", "body_chars")


def stub_stream(events: DataFrame, path: str, checkpoint: str):
    """Start a query that writes the changed states of each batch below ``path``."""

    def write_changes(changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stub_state(events)
        .writeStream.outputMode("update")
        .foreachBatch(write_changes)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest state per key from the written changes."""
    schema = StructType.fromDDL(STATE).add("batch_id", "long")
    names = [name for name in schema.names if name not in ("url_key", "batch_id")]
    latest = F.max_by(F.struct(*names), "batch_id").alias("_latest")
    changes = read_snapshot(spark, path, schema)
    return changes.groupBy("url_key").agg(latest).select("url_key", "_latest.*")
