"""What the operators share: written stages and defined keys of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedlake.session import setting, state_dir
from feedlake.sources.snapshots import stage

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # at the end of a query
NO_ID = -(1 << 63)  # stands for a null doc_id where a key is needed
FILTER_BITS = 1 << 23  # of the filter that keeps texts which no key needs out of a shuffle


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The files are in the shared state folder, so a lost executor costs nothing
    of what was written, and what was shuffled for it goes as soon as it is written.
    """
    with setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        return stage(df, state_dir(df.sparkSession, purpose))


def whole_text() -> Column:
    """The text of a document; a null text counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc and text of all documents in ``keys`` (column doc), and of few others.

    The keys set bits of a filter of FILTER_BITS bits, whatever their number, and texts whose
    bit is unset are left out where they are read. More keys only make the filter
    less selective; the caller joins what is left.
    """
    place = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)).alias("place")
    words = keys.select(place).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # as many rows at most
        bits[row["word"]] = row["bits"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            keep = (bits[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(["doc", "text"]).filter(pa.array(keep.astype(bool)))

    keyed = docs.select(doc_key().alias("doc"), "text")
    return keyed.select("doc", "text", place).mapInArrow(read, "doc long, text string")


def filter_bits(hashes: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits, whatever their number, for the one column of mixed 64-bit hashes."""
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("place")
    words = hashes.select(place).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # as many rows at most
        bits[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be among those of the filter; never False for one that is."""
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
