"""Counts per feed and the run log, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.functions import text
from feedlake.operators.queue import run_time
from feedlake.operators.ranking import union_all

LOG_HEAD = "# Sync Log\n\nThis log is maintained automatically, one section per run.\n"


def feed_counts(feeds: DataFrame, rows: DataFrame, feed: list[str]) -> DataFrame:
    """New rows per feed; feeds without any count zero."""
    found = rows.groupBy(*feed).agg(F.count("*").alias("_n"))
    return feeds.join(found, feed, "left").withColumn(
        "new_count", F.coalesce("_n", F.lit(0)).cast("long")
    ).drop("_n")


def total(counted: DataFrame) -> DataFrame:
    return counted.agg(F.coalesce(F.sum("new_count"), F.lit(0)).alias("total_new"))


def stamped(counted: DataFrame, run_ts, name: str) -> DataFrame:
    """One-row counts with the time of their run, as ISO text."""
    return counted.withColumn(name, text.iso_time(run_time(run_ts)))


def log_lines(counted: DataFrame, notes: DataFrame, run_ts, trigger: str) -> DataFrame:
    """The section of one run, one row per line, with the columns that order it.

    ``part`` is 0 heading, 1 feed lines, 2 list title, 3 links, 4 trigger. A run
    may write any number of notes, so the section stays a table; sorting it by
    ``part, feed_ord, entry_ord`` gives the text.
    """
    run = total(counted)
    stamp = text.iso_time(run_time(run_ts))

    def lines(rows: DataFrame, part: int, line, feed_ord=None, entry_ord=None) -> DataFrame:
        none = F.lit(None)
        return rows.select(
            F.lit(part).alias("part"),
            (none if feed_ord is None else feed_ord).cast("long").alias("feed_ord"),
            (none if entry_ord is None else entry_ord).cast("long").alias("entry_ord"),
            line.alias("line"),
        )

    count_text = F.col("new_count").cast("string")
    feed_line = F.concat(
        F.lit("- Feed: "), F.col("name"), F.lit(" — "), count_text, F.lit(" new articles")
    )
    link_line = F.concat(F.lit("  - [["), F.col("rel_path"), F.lit("]]"))
    return union_all(
        [
            lines(run, 0, F.concat(F.lit("\n## "), stamp, F.lit("\n"))),
            lines(counted, 1, feed_line, F.col("feed_ord")),
            lines(run.filter(F.col("total_new") > 0), 2, F.lit("- New articles:")),
            lines(notes, 3, link_line, F.col("feed_ord"), F.col("entry_ord")),
            lines(run, 4, F.lit(f"- Trigger: {trigger}")),
        ]
    )


def grouped_by_feed(counted: DataFrame) -> DataFrame:
    """Only the feeds that have new notes, as the drain reports them."""
    return counted.filter(F.col("new_count") > 0)
