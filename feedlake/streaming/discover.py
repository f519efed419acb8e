"""Discovery over a stream of landed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from feedlake.functions import keys
from feedlake.operators import dedup, queue as q
from feedlake.sources.snapshots import read_snapshot

RECORD = "url_key string, url string, feed_ord long, entry_ord long, discovered timestamp, status string"


def discovered(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows found so far; with ``before``, by earlier batches only."""
    schema = StructType.fromDDL(RECORD).add("batch_id", "long")
    rows = read_snapshot(spark, path, schema)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def discover_stream(entries: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch's new URLs below ``path``.

    Within a batch the first entry in feed order wins. A batch writes only its own
    directory and looks only at earlier ones, so that running it again after a
    failure gives the same rows. Entries carry ``seen_at``, the time they landed.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        known = discovered(batch.sparkSession, path, before=batch_id)
        new = dedup.discover_new(batch, known, ["feed_ord", "entry_ord"])
        new.select(
            keys.discovery_key(F.col("link")).alias("url_key"),
            F.col("link").alias("url"),
            "feed_ord",
            "entry_ord",
            F.col("seen_at").alias("discovered"),
            F.lit(q.PENDING).alias("status"),
        ).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        entries.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def within_retention(entries: DataFrame, keep: str) -> DataFrame:
    """Stream of entries whose URL was not seen within the retention time.

    State for a URL is dropped once the watermark passes it; an entry that comes
    back later counts as new, as it does after the queue was pruned.
    """
    keyed = q.with_url(entries, "link").withColumn("url_key", keys.discovery_key(F.col("link")))
    return keyed.withWatermark("seen_at", keep).dropDuplicatesWithinWatermark(["url_key"])
