"""Tables kept as snapshots: each run reads the last one and writes the next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from feedlake import schemas
from feedlake.functions import keys, text
from feedlake.operators.queue import run_time
from feedlake.operators.stubs import oldest_first
from feedlake.sources.feeds import if_present


def read_snapshot(
    spark: SparkSession, path: str | None, schema: T.StructType, required: bool = False
) -> DataFrame:
    """A written snapshot; empty where none exists, unless it is required."""
    found = None if path is None else if_present(lambda: spark.read.schema(schema).parquet(path))
    if found is None and required:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.createDataFrame([], schema) if found is None else found


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write the next snapshot; one that exists is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Python stages then run once, and a lost executor costs no more than its tasks.
    """
    write_snapshot(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json_queue(spark: SparkSession, path: str) -> DataFrame:
    """A queue kept as one JSON document ``{articles: […]}``, in its stored order."""
    record = T.StructType([f for f in schemas.QUEUE.fields if f.name != "queue_ord"])
    document = T.StructType(
        [
            T.StructField("articles", T.ArrayType(record)),
            T.StructField("last_checked", T.StringType()),
        ]
    )
    raw = spark.read.schema(document).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("articles").alias("queue_ord", "a"))
    return rows.select(F.col("queue_ord").cast("long").alias("queue_ord"), "a.*")


def read_json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A stub manifest kept as JSON; empty if absent or unreadable, last duplicate wins.

    It is one document ``{stubs: […]}``, or a folder of such documents, as written below.
    """
    entry = T.StructType([f for f in schemas.MANIFEST.fields if f.name != "url_key"])
    document = T.StructType([T.StructField("stubs", T.ArrayType(entry))])
    raw = if_present(lambda: spark.read.schema(document).option("multiLine", True).json(path))
    if raw is None:
        return spark.createDataFrame([], schemas.MANIFEST)
    rows = (
        raw.select(F.posexplode("stubs").alias("_ord", "s"))
        .filter(F.coalesce("s.url", F.lit("")) != "")
        .select("_ord", keys.vault_key(F.col("s.url")).alias("url_key"), "s.*")
    )
    names = [name for name in schemas.MANIFEST.names if name != "url_key"]
    last = F.max_by(F.struct(*names), "_ord").alias("_last")
    return rows.groupBy("url_key").agg(last).select("url_key", "_last.*")


def write_json_manifest(manifest: DataFrame, path: str, run_ts) -> None:
    """The manifest as documents ``{generated, count, stubs: […]}``, oldest first.

    Each file is such a document of its share of the entries and states the count
    of all, so no task holds more than its share. No entries may give no document,
    which reads as an empty manifest.
    """
    entries = oldest_first(manifest).select(F.to_json(F.struct(*(c for c in manifest.columns if c != "url_key"))).alias("value"))
    count = manifest.count()
    generated = manifest.sparkSession.range(1).select(text.iso_time(run_time(run_ts))).first()[0]
    head = f'{{"generated": "{generated}", "count": {count}, "stubs": ['

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separator = head
        for lines in (batch.column(0).to_pylist() for batch in batches):
            if lines:
                yield pa.record_batch([pa.array([separator + lines[0], *("," + line for line in lines[1:])])], names=["value"])
                separator = ","
        yield pa.record_batch([pa.array(["]}" if separator == "," else head + "]}"])], names=["value"])

    entries.mapInArrow(document, "value string").write.mode("errorifexists").text(path)
