"""A log of snapshots: data first, then a commit that makes it the latest one.

A snapshot is written to a folder of its own and counts only once its commit exists. Commits
are numbered; a number can be taken once, so of two writers that read the same snapshot one
commits and the other is told. A writer that fails leaves data that nobody reads.

    <path>/data-<id>/…            one snapshot
    <path>/commits/<number>.json  {"version": n, "data": "data-<id>", "n_rows": …}
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from feedlake.sources.feeds import if_present

COMMIT = "version long, data string, n_rows long"


class Conflict(Exception):
    """Another writer has committed since the snapshot was read."""


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All finished commits."""
    schema = T.StructType.fromDDL(COMMIT)
    found = if_present(lambda: spark.read.schema(schema).json(f"{path}/commits"))
    if found is None:
        return spark.createDataFrame([], schema)
    return found.filter(F.col("version").isNotNull() & F.col("data").isNotNull())


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the latest commit; 0 before the first."""
    return commits(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> tuple[int, DataFrame]:
    """A complete snapshot, the latest one unless a number is given, with its number; empty as 0."""
    wanted = latest_version(spark, path) if version is None else version
    if wanted == 0:
        return 0, spark.createDataFrame([], schema)
    row = commits(spark, path).filter(F.col("version") == wanted).first()
    if row is None:
        raise FileNotFoundError(f"no snapshot {wanted} at {path}")
    return wanted, spark.read.schema(schema).parquet(f"{path}/{row['data']}")


def _take(spark: SparkSession, target: str, text: str) -> bool:
    """Create a small file that must not exist yet; False if it does."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(target)
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = system.create(file, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def write_version(df: DataFrame, path: str, base: int) -> int:
    """Write the snapshot that follows number ``base`` and commit it; returns its number.

    The rows are counted by the write itself. Raises Conflict, with nothing committed, if
    ``base`` is no longer the latest.
    """
    spark = df.sparkSession
    if latest_version(spark, path) != base:
        raise Conflict(f"snapshot {base} is not the latest at {path}")
    folder, counted = f"data-{uuid.uuid4().hex}", Observation()
    df.observe(counted, F.count("*").alias("n_rows")).write.mode("errorifexists").parquet(f"{path}/{folder}")
    commit = {"version": base + 1, "data": folder, "n_rows": counted.get["n_rows"]}
    if not _take(spark, f"{path}/commits/{base + 1:012d}.json", json.dumps(commit)):
        raise Conflict(f"snapshot {base + 1} was committed by another writer at {path}")
    return base + 1
