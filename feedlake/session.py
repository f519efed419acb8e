"""Session settings and the folder for written state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A store reserves 4 MB of disk per partition and poll before it holds a row, unless it is told not to.
RESERVES = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Pages are wide rows: bound an Arrow batch by its bytes, not only its rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # Plans here are long; recording a call site per column slows their building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    STATE_STORE: ROCKS_DB,
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the jobs are designed for."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what starts within; the former value is put back."""
    former = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if former is None else spark.conf.set(key, former)


def state_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run's written state, in a place all executors share.

    The place is ``spark.checkpoint.dir``, or the warehouse where that is unset. The
    folder may be removed once the results that were read from it are written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/state"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
