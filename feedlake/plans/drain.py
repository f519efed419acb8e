"""Drain: turn pending queue rows into notes and mark them synced."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from feedlake.functions import html, keys, text
from feedlake.operators import dedup, joins, queue as q, reports, stubs
from feedlake.operators.articles import body_choice, fetched_articles, markdown_of
from feedlake.operators.lookup import known_feed, lookup_feeds
from feedlake.plans.notes import built_notes, named_notes, planned_names, with_local_images
from feedlake.session import state_dir
from feedlake.sources.notes import note_keys
from feedlake.sources.snapshots import stage

KEEP_PENDING, FALLBACK = "keep_pending", "fallback"


def taken_rows(
    queue: DataFrame, feeds: DataFrame, kind: str | None, cap: int | None
) -> DataFrame:
    """Rows of this run, with their feed's settings; unknown feeds stay pending."""
    rows = lookup_feeds(q.take_pending(queue, kind, cap), feeds, "feed", "parser", ["queue_ord"])
    return known_feed(rows).select(
        F.col("queue_ord").alias("seq"),
        F.col("feed_cfg.feed_ord").alias("feed_ord"),
        F.col("queue_ord").alias("entry_ord"),
        F.col("feed_cfg.name").alias("feed_name"),
        F.col("feed_cfg.source").alias("source"),
        F.col("feed_cfg.vault_folder").alias("vault_folder"),
        F.col("url").alias("link"),
        keys.vault_key(F.col("url")).alias("url_key"),
        "title",
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("published", F.lit("")).alias("published"),
        text.parser_or_default(F.col("parser")).alias("parser"),
    )


def preview(
    queue: DataFrame,
    feeds: DataFrame,
    notes: DataFrame,
    kind: str | None = None,
    max_articles: int | None = None,
) -> dict[str, DataFrame]:
    """Names a drain would plan, and the rows it would find already stored."""
    rows = taken_rows(queue, feeds, kind, max_articles)
    flagged = dedup.with_stored_flag(rows, note_keys(notes), ["seq"])
    fresh = flagged.filter(~F.col("is_stored"))
    return {
        "would_create": planned_names(
            fresh.withColumn("safe_name", text.sanitize_title(F.col("title")))
        ),
        "already_present": flagged.filter("is_stored").drop("is_stored"),
    }


def fetched(fresh: DataFrame, pages: DataFrame, parsers: Mapping[str, html.Parser]) -> DataFrame:
    wanted = fresh.select(F.col("link").alias("url"), "parser")
    articles = fetched_articles(wanted, pages, parsers).withColumnRenamed("url", "link")
    return fresh.join(articles, ["link", "parser"], "left")


def with_feed_text(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Add the feed's own text for rows whose URL its current entries still hold."""
    current = joins.first_per_key(
        q.with_url(entries, "link").select(
            keys.vault_key(F.col("link")).alias("url_key"),
            "feed_ord",
            "entry_ord",
            body_choice(F.col("content"), F.col("summary")).alias("feed_text"),
        ),
        ["url_key"],
        ["feed_ord", "entry_ord"],
    ).select("url_key", "feed_text")
    return rows.join(current, "url_key", "left")


def drain(
    queue: DataFrame,
    feeds: DataFrame,
    notes: DataFrame,
    pages: DataFrame,
    run_ts,
    kind: str | None = None,
    max_articles: int | None = None,
    on_miss: str = KEEP_PENDING,
    entries: DataFrame | None = None,
    manifest: DataFrame | None = None,
    asset_cfg: DataFrame | None = None,
    fetch_result: DataFrame | None = None,
    asset_manifest: DataFrame | None = None,
    parsers: Mapping[str, html.Parser] = html.PARSERS,
    trigger: str = "pull-and-sync",
) -> dict[str, DataFrame]:
    """One run over the pending rows.

    A row without a page stays pending, or with ``on_miss='fallback'`` uses the
    text of its feed's current entries under the stub guard. Of several rows with
    one key in a folder the first that has a text writes the note; later ones
    then count as already present.
    """
    spark = queue.sparkSession
    stored = note_keys(notes)
    rows = stage(
        dedup.with_stored_flag(taken_rows(queue, feeds, kind, max_articles), stored, ["seq"]),
        state_dir(spark, "drain-rows"),
    )
    fresh = rows.filter(~F.col("is_stored")).drop("is_stored")
    present = rows.filter("is_stored").select("seq")

    got = fetched(fresh, pages, parsers)
    if on_miss == FALLBACK:
        # A row without feed text has nothing to measure and stays pending.
        got = with_feed_text(got, entries)
        text_md = markdown_of(F.when(F.col("page_md").isNull(), F.col("feed_text")))
        got = got.withColumn("fallback_md", text_md).drop("feed_text")
    else:
        got = got.withColumn("fallback_md", F.lit(None).cast("string"))
    has_text = F.coalesce("page_md", "fallback_md").isNotNull()
    articles = stage(
        got.withColumns(
            {
                "route": F.when(has_text, stubs.route(F.col("page_md"), F.col("fallback_md"))),
                "md": F.coalesce("page_md", "fallback_md"),
                "safe_name": text.sanitize_title(F.col("title")),
            }
        ).drop("page_md", "fallback_md"),
        state_dir(spark, "drain-articles"),
    )

    group = ["vault_folder", "url_key"]
    narrow = articles.select("seq", "feed_ord", "feed_name", *group, "route", "safe_name")
    first = (
        narrow.filter(F.col("route") == stubs.NOTE).groupBy(*group).agg(F.min("seq").alias("_writer"))
    )
    placed = stage(
        joins.spread_join(narrow, first, group, ["seq"], "left"), state_dir(spark, "drain-placed")
    )
    writers = placed.filter(F.col("seq") == F.col("_writer"))
    repeated = placed.filter(F.col("seq") > F.col("_writer")).select("seq")

    # Names are settled once; notes, log, counts and known keys read them.
    names = stage(
        named_notes(writers.select("seq", "vault_folder", "safe_name"), notes), state_dir(spark, "drain-names")
    )
    built = built_notes(articles, names, F.col("published"), run_ts)
    parts = with_local_images(built, asset_cfg, fetch_result, asset_manifest)
    new_notes = parts.pop("notes")
    done = present.unionByName(repeated).unionByName(writers.select("seq"))
    counted = reports.grouped_by_feed(
        reports.feed_counts(feeds, writers.select("feed_ord"), ["feed_ord"])
    )
    result = {
        "queue": q.mark_synced(queue, done.withColumnRenamed("seq", "queue_ord"), run_ts),
        "notes": new_notes,
        "already_present": present.unionByName(repeated),
        "feed_counts": counted,
        "log": reports.log_lines(counted, built, run_ts, trigger),
        **parts,
    }
    if on_miss == FALLBACK:
        free = placed.filter(F.col("_writer").isNull() | (F.col("seq") < F.col("_writer")))
        held = stubs.stub_records(
            articles.join(free.select("seq"), "seq", "left_semi").withColumns(
                {"published_parsed": F.lit(None).cast("timestamp"), "published_raw": F.col("published")}
            )
        )
        result["stubs"] = held
        if manifest is not None:
            known = stored.unionByName(built.select("vault_folder", "url_key"))
            result["manifest"] = stubs.update_manifest(manifest, held, known, run_ts)
    return result
