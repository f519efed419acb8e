"""Explicit schemas of every table the jobs read or write."""

from pyspark.sql import types as T

S, L, TS = T.StringType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FEED = _struct(name=S, source=S, parser=S, rss_url=S, vault_folder=S)

FEED_CONFIG = _struct(
    feeds=T.ArrayType(FEED), settings=_struct(keep_synced_days=T.IntegerType())
)

FEEDS = T.StructType(
    [T.StructField("feed_ord", L), *FEED.fields, T.StructField("keep_synced_days", T.IntegerType())]
)

ENTRY = _struct(
    feed_ord=L,
    entry_ord=L,
    link=S,
    title=S,
    author=S,
    authors=T.ArrayType(_struct(name=S)),
    published_raw=S,
    published_parsed=TS,
    content=T.ArrayType(_struct(value=S)),
    summary=S,
)

QUEUE = _struct(
    queue_ord=L,
    url=S,
    title=S,
    author=S,
    published=S,
    feed=S,
    parser=S,
    discovered=TS,
    status=S,
    synced_at=TS,
)

PAGE = _struct(url=S, html=S)

NOTE = _struct(
    vault_folder=S,
    url_key=S,
    note_name=S,
    rel_path=S,
    feed_ord=L,
    entry_ord=L,
    link=S,
    title=S,
    author=S,
    published=S,
    clipped=TS,
    source=S,
    feed_kind=S,
    tags=T.ArrayType(S),
    note_text=S,
)

STUB = _struct(
    url=S,
    title=S,
    source=S,
    parser=S,
    published=S,
    vault_folder=S,
    body_chars=L,
)

MANIFEST = T.StructType(
    [
        T.StructField("url_key", S),
        *STUB.fields,
        T.StructField("first_seen", TS),
        T.StructField("last_seen", TS),
    ]
)

ASSET_CONFIG = _struct(source=S, vault_folder=S, assets_subfolder=S)

ASSET_MANIFEST = _struct(assets_dir=S, file_name=S)

FETCH_RESULT = _struct(image_url=S, ok=T.BooleanType(), content_length=L, n_bytes=L)
