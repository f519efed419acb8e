"""Lookups of feed, parser and asset settings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.functions import images, text
from feedlake.operators import joins

FALLBACK_PARSER = "default"


def lookup_feeds(
    rows: DataFrame, feeds: DataFrame, source: str, parser: str, spread_by: list[str]
) -> DataFrame:
    """Add the struct ``feed_cfg``: the feed that a row's source and parser name.

    The exact pair comes first, then the source's default-kind feed, then the
    source's first feed; null if the source is unknown. Of duplicate pairs the
    last one counts, at the place of the first. Both tables are reduced to one
    row per key, so rows are neither multiplied nor grouped, and the rows of one
    source are spread over several tasks.
    """
    kind = text.parser_or_default(F.col("parser"))
    config = F.struct(
        F.col("feed_ord"), F.col("name"), F.col("source"), kind.alias("parser"), F.col("vault_folder")
    )
    pairs = (
        feeds.groupBy(F.col("source").alias("_source"), kind.alias("_parser"))
        .agg(F.max_by(config, "feed_ord").alias("_exact"), F.min("feed_ord").alias("_place"))
    )
    preference = F.struct(F.col("_parser") != text.DEFAULT_PARSER, F.col("_place"))
    sources = pairs.groupBy("_source").agg(F.min_by("_exact", preference).alias("_any"))
    asked = rows.withColumn("_parser", text.parser_or_default(F.col(parser))).withColumn(
        "_source", F.col(source)
    )
    exact = joins.spread_join(
        asked, pairs.drop("_place"), ["_source", "_parser"], spread_by, "left"
    )
    return (
        joins.spread_join(exact, sources, ["_source"], spread_by, "left")
        .withColumn("feed_cfg", F.coalesce("_exact", "_any"))
        .drop("_source", "_parser", "_exact", "_any")
    )


def known_feed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("feed_cfg").isNotNull())


def dispatched_parser(parser: Column, registered: Iterable[str]) -> Column:
    """Parser that will run: a missing name has its own default, as has an unknown one."""
    named = text.parser_or_default(parser)
    return F.when(named.isin(*registered), named).otherwise(F.lit(FALLBACK_PARSER))


def lookup_assets(
    rows: DataFrame, assets: DataFrame, source: str, title: str, spread_by: list[str]
) -> DataFrame:
    """Add ``assets_dir``; null for sources that keep their images external."""
    config = assets.select(
        F.col("source").alias(source),
        F.col("vault_folder").alias("_asset_folder"),
        F.col("assets_subfolder").alias("_asset_subfolder"),
    )
    path = images.assets_dir(F.col("_asset_folder"), F.col("_asset_subfolder"), F.col(title))
    return (
        joins.spread_join(rows, config, [source], spread_by, "left")
        .withColumn("assets_dir", path)
        .drop("_asset_folder", "_asset_subfolder")
    )
