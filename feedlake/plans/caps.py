"""The per-feed cap over feeds that share keys.

Feeds run in their configured order. Each takes its first rows that no earlier feed of its folder
wrote, so what a feed takes depends on what all feeds before it took.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.operators import joins, stubs
from feedlake.operators.ranking import running_total
from feedlake.session import state_dir
from feedlake.sources.snapshots import stage

BLOCK_ROWS = 1 << 16
KEY = ["vault_folder", "url_key"]


def candidates(rows: DataFrame, max_articles: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows that the per-feed cap can reach, whatever earlier feeds of one scope write.

    Only rows whose key is in an earlier feed too can be blocked. All others count for
    certain, so nothing after the cap-th of them is ever taken.
    """
    key = [*KEY, *scope]
    first = rows.groupBy(*key).agg(F.min("feed_ord").alias("_first"))
    marked = joins.spread_join(rows, first, key, ["seq"], "left").withColumn(
        "_certain", F.coalesce(F.col("feed_ord") == F.col("_first"), F.lit(True)).cast("long")
    )
    counted = running_total(marked, ["feed_ord"], ["seq"], "_before", F.col("_certain"))
    reached = F.col("_before") - F.col("_certain") < max_articles
    return counted.filter(reached).select(*rows.columns)


def in_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Add ``_folder`` and ``_block``: runs of consecutive feeds of a folder with some ``width`` rows.

    A feed of more rows than ``width`` is a block of its own, with an odd number; it is the last
    of its run, since the rows before a later feed fill the next.
    """
    folder = F.xxhash64("vault_folder")
    feeds = rows.withColumn("_folder", folder).groupBy("_folder", "feed_ord").agg(F.count("*").alias("_n"))
    counted = running_total(feeds, ["_folder"], ["feed_ord"], "_upto", F.col("_n"))
    run = F.floor((F.col("_upto") - F.col("_n")) / width)
    block = (2 * run + (F.col("_n") > width).cast("long")).alias("_block")
    numbers = counted.select("_folder", "feed_ord", block)
    return joins.spread_join(rows.withColumn("_folder", folder), numbers, ["_folder", "feed_ord"], ["seq"], "left")


def in_turn(max_articles: int) -> Callable[[pa.Table], pa.Table]:
    """What the feeds of one block take, one feed after the other."""
    columns, note = ["feed_ord", *KEY, "route"], stubs.NOTE

    def settle(block: pa.Table) -> pa.Table:
        block = block.sort_by([("feed_ord", "ascending"), ("entry_ord", "ascending")])
        writer, taken, keep = {}, Counter(), []
        for feed, folder, key, route in zip(*(block[c].to_pylist() for c in columns)):
            known = folder is not None and key is not None
            free = taken[feed] < max_articles and (not known or writer.get((folder, key), feed) == feed)
            keep.append(free)
            taken[feed] += free
            if free and known and route == note:
                writer.setdefault((folder, key), feed)
        return block.filter(pa.array(keep, pa.bool_()))

    return settle


def capped(rows: DataFrame, max_articles: int, width: int = BLOCK_ROWS) -> DataFrame:
    """The first rows of each feed that no earlier feed wrote within its own cap.

    All blocks are settled at once, each against what earlier blocks took in the round
    before. A block of several feeds has less than twice ``width`` rows and is one group; the rows
    of a larger feed are cut by running totals. A round settles at least the next block of
    every folder; it ends once nothing changes, so there are at most as many rounds as
    a folder has blocks, plus one. Rows are narrow and are staged between rounds.
    """
    spark = rows.sparkSession
    dealt = stage(in_blocks(rows, width), state_dir(spark, "sync-blocks"))
    taken = None
    while True:
        free = dealt if taken is None else free_of_earlier_blocks(dealt, taken)
        reached = candidates(free, max_articles, ("_block",))
        alone = reached.filter("_block % 2 = 1")
        shared = reached.filter("_block % 2 = 0").groupBy("_folder", "_block")
        settled = alone.unionByName(shared.applyInArrow(in_turn(max_articles), reached.schema))
        now = stage(settled, state_dir(spark, "sync-capped"))
        if taken is not None:
            gone = taken.select("seq").join(now.select("seq"), "seq", "left_anti")
            added = now.select("seq").join(taken.select("seq"), "seq", "left_anti")
            if gone.unionByName(added).isEmpty():
                return now.select(*rows.columns)
        taken = now


def free_of_earlier_blocks(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows whose key no earlier block wrote; a held-back stub blocks nothing."""
    writers = taken.filter(F.col("route") == stubs.NOTE).groupBy(*KEY).agg(F.min("_block").alias("_writer"))
    free = F.col("_writer").isNull() | (F.col("_block") <= F.col("_writer"))
    return joins.spread_join(rows, writers, KEY, ["seq"], "left").filter(free).drop("_writer")
