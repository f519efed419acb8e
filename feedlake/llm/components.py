"""Connected components of links by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of links (a, b); nodes without link are absent.

    Large star: each node sends its larger neighbours to its smallest one; small star: its
    smaller ones and itself. The links turn into stars around the smallest nodes within a
    number of rounds that grows with the logarithm of a component's size. Degrees may be
    of any size: minima are aggregates with partial results.
    """
    edges = staged(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        down = large.filter(F.col("a") > F.col("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.filter(F.col("a") != F.col("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()
        edges = staged(small, "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """A count and a sum of hashes, equal if no edge has changed."""
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())
