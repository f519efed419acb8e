"""Key lookups between a batch and the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16


def present_keys(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``rows`` that also occur in ``known``.

    The keys of the batch reduce the known side before anything else is done with
    it: where they are few, Spark broadcasts them and the known side is not shuffled.
    """
    wanted = rows.select(*keys).distinct()
    return known.select(*keys).join(wanted, keys, "left_semi").distinct()


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], spread_by: list[str], how: str
) -> DataFrame:
    """Join rows with a narrow table of unique keys; one key's rows go to several tasks.

    The salt spreads every key over a fixed number of partitions. It also gives
    both sides a shuffle of their own, so that adaptive execution can split, by
    measured size, what is still too large. A small table is broadcast by Spark.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    return (
        rows.withColumn("_salt", salt)
        .join(table.withColumn("_salt", salts), [*keys, "_salt"], how)
        .drop("_salt")
    )


def without_known(rows: DataFrame, known: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """Rows whose key is not known; duplicates among the rows stay."""
    return spread_join(rows, present_keys(rows, known, keys), keys, spread_by, "left_anti")


def with_known(rows: DataFrame, known: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """Rows whose key is known; duplicates among the rows stay."""
    return spread_join(rows, present_keys(rows, known, keys), keys, spread_by, "left_semi")


def flag_known(
    rows: DataFrame, known: DataFrame, keys: list[str], spread_by: list[str], out: str
) -> DataFrame:
    """Add whether the key is known: what both variants above tell, in one join."""
    found = present_keys(rows, known, keys).withColumn("_known", F.lit(True))
    flagged = spread_join(rows, found, keys, spread_by, "left")
    return flagged.withColumn(out, F.col("_known").isNotNull()).drop("_known")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key; partial results are formed before the shuffle."""
    rest = [name for name in rows.columns if name not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*rows.columns)


def distinct_keys(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.select(key.alias(name)).distinct()
