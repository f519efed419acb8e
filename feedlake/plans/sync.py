"""Direct sync: from feed entries to notes, held-back stubs and the manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from feedlake.functions import html, keys, text
from feedlake.operators import dedup, reports, stubs
from feedlake.operators.articles import body_choice, fetched_articles, markdown_of
from feedlake.operators.queue import with_url
from feedlake.operators.ranking import first_n, sequence_of
from feedlake.plans.caps import candidates, capped
from feedlake.plans.notes import built_notes, named_notes, planned_names, with_local_images
from feedlake.session import state_dir
from feedlake.sources.notes import note_keys
from feedlake.sources.snapshots import stage


def keyed_entries(entries: DataFrame) -> DataFrame:
    """Entries that have a link, with their order and keys."""
    return with_url(entries, "link").withColumns(
        {
            "seq": sequence_of(F.col("feed_ord"), F.col("entry_ord")),
            "url_key": keys.vault_key(F.col("link")),
            "parser": text.parser_or_default(F.col("parser")),
        }
    )


def titled(entries: DataFrame) -> DataFrame:
    return entries.withColumn(
        "title", text.decode_entities(text.title_or_default(F.col("title")))
    )


def routed(
    entries: DataFrame, fresh: DataFrame, pages: DataFrame, parsers: Mapping[str, html.Parser]
) -> DataFrame:
    """Fresh entries with their Markdown and the route it sends them on.

    ``fresh`` holds narrow ``(seq, link, parser)`` rows. Feed text is converted
    only where the page gave no body.
    """
    wanted = fresh.select(F.col("link").alias("url"), "parser")
    articles = fetched_articles(wanted, pages, parsers).withColumnRenamed("url", "link")
    rows = titled(entries.join(fresh.select("seq"), "seq")).withColumn(
        "author", text.pick_author(F.col("author"), F.col("authors"))
    )
    joined = rows.join(articles, ["link", "parser"], "left")
    own_text = body_choice(F.col("content"), F.col("summary"))
    fallback = markdown_of(F.when(F.col("page_md").isNull(), own_text))
    return (
        joined.withColumn("fallback_md", fallback)
        .withColumns(
            {
                "route": stubs.route(F.col("page_md"), F.col("fallback_md")),
                "md": F.coalesce("page_md", "fallback_md"),
                "safe_name": text.sanitize_title(F.col("title")),
            }
        )
        .drop("page_md", "fallback_md", "content", "summary", "authors")
    )


def preview(entries: DataFrame, notes: DataFrame, max_articles: int | None = None) -> DataFrame:
    """Names a sync would plan. Nothing is fetched, so nothing is held back either."""
    fresh = dedup.unseen(keyed_entries(entries), note_keys(notes), ["seq"])
    if max_articles is not None:
        fresh = first_n(fresh, ["feed_ord"], ["seq"], max_articles)
    return planned_names(
        titled(fresh).withColumn("safe_name", text.sanitize_title(F.col("title")))
    )


def sync(
    feeds: DataFrame,
    entries: DataFrame,
    notes: DataFrame,
    pages: DataFrame,
    manifest: DataFrame,
    run_ts,
    max_articles: int | None = None,
    asset_cfg: DataFrame | None = None,
    fetch_result: DataFrame | None = None,
    asset_manifest: DataFrame | None = None,
    parsers: Mapping[str, html.Parser] = html.PARSERS,
    trigger: str = "manual",
) -> dict[str, DataFrame]:
    """One direct sync of all feeds at once.

    ``entries`` carry the source, parser and folder of their feed; ``notes`` are
    the stored ones. With a cap only the entries it can reach meet their pages.
    Routed articles are staged, so pages are parsed once; caps and names then work
    on narrow rows and only the notes to be written meet their text again.
    """
    spark = entries.sparkSession
    keyed = keyed_entries(entries)
    narrow = keyed.select("seq", "feed_ord", "vault_folder", "url_key", "link", "parser")
    fresh = stage(dedup.unseen(narrow, note_keys(notes), ["seq"]), state_dir(spark, "sync-fresh"))
    if max_articles is not None:
        fresh = stage(candidates(fresh, max_articles), state_dir(spark, "sync-candidates"))
    articles = stage(routed(keyed, fresh, pages, parsers), state_dir(spark, "sync-articles"))
    narrow = articles.select(
        "seq", "feed_ord", "entry_ord", "vault_folder", "url_key", "route", "safe_name"
    )
    if max_articles is None:
        kept = stage(dedup.free_of_earlier_notes(narrow, ["seq"]), state_dir(spark, "sync-kept"))
    else:
        kept = capped(narrow, max_articles)
    writers = kept.filter(F.col("route") == stubs.NOTE).select("seq", "vault_folder", "safe_name")
    published = text.published_text(F.col("published_parsed"), F.col("published_raw"))
    # Names are settled once; notes, log, counts and known keys read them.
    names = stage(named_notes(writers, notes), state_dir(spark, "sync-names"))
    built = built_notes(articles, names, published, run_ts)
    parts = with_local_images(built, asset_cfg, fetch_result, asset_manifest)
    new_notes = parts.pop("notes")

    held = stubs.stub_records(articles.join(kept.select("seq"), "seq", "left_semi"))
    stored = note_keys(notes).unionByName(built.select("vault_folder", "url_key"))
    counted = reports.feed_counts(feeds, writers_per_feed(kept), ["feed_ord"])
    after = stubs.update_manifest(manifest, held, stored, run_ts)
    return {
        "notes": new_notes,
        "stubs": held,
        "manifest": after,
        "manifest_size": reports.stamped(stubs.manifest_size(after), run_ts, "generated"),
        "feed_counts": counted,
        "total": reports.total(counted),
        "log": reports.log_lines(counted, built, run_ts, trigger),
        **parts,
    }


def writers_per_feed(kept: DataFrame) -> DataFrame:
    return kept.filter(F.col("route") == stubs.NOTE).select("feed_ord")
