"""An index of the stored notes' keys: what a batch must know of a vault, without reading its notes.

Keys are written once with their notes, dealt into folders by a hash and sorted within. A
batch reads the folders its own keys fall into, and Parquet's statistics and Bloom filters
skip the row groups in them that cannot hold one of a few keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedlake.sources.feeds import if_present
from feedlake.sources.notes import note_keys

BUCKETS = 256  # folders of one run's keys
FEW = 1000  # keys of a batch that are named to the reader one by one
SCHEMA = "vault_folder string, url_key string, run string, bucket int"


def bucket_of(key: str = "url_key") -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(BUCKETS)).cast("int")


def write_keys(notes: DataFrame, path: str, run: str) -> None:
    """Write the keys of a run's notes below its name; a repeated run replaces its own."""
    keyed = note_keys(notes).withColumn("bucket", bucket_of())
    rows = keyed.repartition("bucket").sortWithinPartitions("bucket", "url_key")
    writer = rows.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#url_key", "true")
    writer.parquet(f"{path}/run={run}")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    found = if_present(lambda: spark.read.schema(SCHEMA).parquet(path))
    return spark.createDataFrame([], SCHEMA) if found is None else found


def stored_keys(batch: DataFrame, path: str, repeating: str | None = None) -> DataFrame:
    """Distinct (vault_folder, url_key) of stored notes that share a key with the batch.

    The numbers of the batch's folders, BUCKETS at most, and the keys of a batch of up to FEW
    are named in the read; for more keys a semi join picks them. Both give the same rows.
    """
    wanted = batch.select("url_key").distinct()
    buckets = [row["bucket"] for row in wanted.select(bucket_of().alias("bucket")).distinct().collect()]
    index = read_keys(batch.sparkSession, path).filter(F.col("bucket").isin(buckets))
    if repeating is not None:
        index = index.filter(F.col("run") != repeating)
    named = [row["url_key"] for row in wanted.limit(FEW + 1).collect()]
    if len(named) <= FEW:
        index = index.filter(F.col("url_key").isin([key for key in named if key is not None]))
    found = index.join(wanted, "url_key", "left_semi")
    return found.select("vault_folder", "url_key").distinct()
