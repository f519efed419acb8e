"""Stored notes, the run log and the assets manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from feedlake import schemas
from feedlake.functions import keys, text
from feedlake.operators.reports import LOG_HEAD
from feedlake.sources.feeds import if_present
from feedlake.sources.snapshots import read_snapshot


def note_keys(notes: DataFrame) -> DataFrame:
    """Distinct ``(vault_folder, url_key)`` of notes.

    The notes table states the key in a column of its own, so no text is read;
    bare note files give it through the link in their frontmatter.
    """
    if "url_key" in notes.columns:
        keyed = notes.select("vault_folder", "url_key")
    else:
        key = keys.vault_key(text.frontmatter_link(F.col("note_text")))
        keyed = notes.select("vault_folder", key.alias("url_key"))
    return keyed.filter(F.col("url_key").isNotNull()).distinct()


def read_note_files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below a root as ``(vault_folder, note_name, note_text)``."""
    reader = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True)
    files = if_present(lambda: reader.text(root, wholetext=True))
    if files is None:
        return spark.createDataFrame([], "vault_folder string, note_name string, note_text string")
    files = files.select(
        F.col("_metadata.file_path").alias("_uri"), F.col("value").alias("note_text")
    )
    # Paths come back as encoded URIs; '+' is a plain character in them.
    path = F.url_decode(F.replace("_uri", F.lit("+"), F.lit("%2B")))
    below = F.substring_index(path, root.rstrip("/") + "/", -1)
    return files.select(
        F.regexp_extract(below, r"^(?:(.*)/)?[^/]*$", 1).alias("vault_folder"),
        F.regexp_extract(below, r"([^/]*)\.md$", 1).alias("note_name"),
        "note_text",
    )


def read_notes(spark: SparkSession, path: str | None, repeating: str | None = None) -> DataFrame:
    """Notes of all runs; a run that is repeated names itself, and its own are left out."""
    notes = read_snapshot(spark, path, T.StructType([*schemas.NOTE.fields, T.StructField("run", T.StringType())]))
    if repeating is not None:
        notes = notes.filter(F.col("run") != repeating)
    return notes.select(*schemas.NOTE.names)


def write_notes(notes: DataFrame, path: str, run: str) -> int:
    """Write a run's notes below its own name, one directory per folder; the number of them.

    A run repeated after a failure replaces what it wrote before. Rebalancing
    gathers a folder's notes into few files, and splits a large folder. The notes are
    counted by the write itself, without a job of its own.
    """
    counted = Observation()
    rows = notes.select(*schemas.NOTE.names).observe(counted, F.count("*").alias("n"))
    rows = rows.hint("rebalance", F.col("vault_folder"))
    rows.write.mode("overwrite").partitionBy("vault_folder").parquet(f"{path}/run={run}")
    return counted.get["n"]


def write_assets(assets: DataFrame, path: str) -> None:
    """Append the names given to fetched images to the assets manifest."""
    assets.select("assets_dir", F.col("asset_name").alias("file_name")).write.mode("append").parquet(path)


def write_run_log(lines: DataFrame, path: str, run: str, n_new: int | None = None) -> None:
    """Write a run's section as text below its own name; a new log gets its head first.

    ``n_new`` is the number of notes that ``write_notes`` has counted: a run without any
    leaves no section and no head.

    Runs are named so that they sort by time. Reading the folder by name gives
    the whole log.
    """
    if n_new == 0:
        return
    head = lines.sparkSession.createDataFrame([(LOG_HEAD,)], "value string")
    head.coalesce(1).write.mode("ignore").text(f"{path}/0-head")
    ordered = lines.orderBy(
        "part", F.asc_nulls_first("feed_ord"), F.asc_nulls_first("entry_ord")
    ).select(F.col("line").alias("value"))
    ordered.write.mode("errorifexists").text(f"{path}/run-{run}")
