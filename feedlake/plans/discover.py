"""Discovery: find entries the queue does not know and append them as pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.functions import text
from feedlake.operators import dedup, queue as q, reports
from feedlake.operators.ranking import sequence_of
from feedlake.session import state_dir
from feedlake.sources.snapshots import stage


# What a queue record states of an entry; feed texts are not carried through the dedup.
STATED = [
    "feed_ord", "entry_ord", "link", "title", "author", "authors",
    "published_parsed", "published_raw", "source", "parser",
]


def configured_days(feeds: DataFrame) -> int:
    """The retention that a configuration states for all its feeds."""
    if "keep_synced_days" not in feeds.columns:
        return text.DEFAULT_KEEP_DAYS
    days = feeds.agg(F.max("keep_synced_days")).first()[0]
    return text.DEFAULT_KEEP_DAYS if days is None else days


def discover(
    feeds: DataFrame,
    entries: DataFrame,
    queue: DataFrame,
    run_ts,
    keep_days: int | None = None,
) -> dict[str, DataFrame]:
    """One discovery run over all feeds.

    ``entries`` carry the source and parser of their feed. A row that this run
    prunes still counts as known, so its URL is found again on the next run only.
    Retention is the one of the configuration unless ``keep_days`` gives another.
    The new records are staged, as the queue and the counts both read them.
    """
    if keep_days is None:
        keep_days = configured_days(feeds)
    new = dedup.discover_new(entries.select(*STATED), queue, ["feed_ord", "entry_ord"])
    placed = new.withColumn("seq", sequence_of(F.col("feed_ord"), F.col("entry_ord")))
    records = stage(
        q.queue_records(placed, run_ts, keep=["seq", "feed_ord"]),
        state_dir(queue.sparkSession, "discover-new"),
    )
    counted = reports.feed_counts(feeds, records.select("feed_ord"), ["feed_ord"])
    return {
        "queue": q.append(q.prune(queue, run_ts, keep_days), records.drop("feed_ord"), "seq"),
        "new": records.drop("seq", "feed_ord"),
        "pruned": q.prune_counts(queue, run_ts, keep_days),
        "feed_counts": counted,
        "total": reports.stamped(reports.total(counted), run_ts, "last_checked"),
    }
