"""Token ids in files: canonical length-limited Huffman codes from global counts.

Ids are made once and staged, two or four bytes each, under zstd, and counted on the way. The
tasks' counts are summed by Spark (a row per id and task; at most a vocabulary reaches the driver)
and a code of at most ``MAX_BITS`` bits is built by merging packages. The staged rows are dealt by
ranges of doc_id and sorted; then every document becomes a row: doc_id, n_tokens, the bits of its
codes as big-endian 32-bit words, and the bit offset of each block of ``BLOCK`` ids. The rows are
written as Parquet, with shard and place, so files and rows are in ascending order. Blocks decode on their own by a table of
2^bits entries, all blocks of a batch in step. The code book is a file beside them, so a
reader needs nothing else.

A document's start is the ids of earlier shards, plus those before it in its shard.

Defined cases: a null text is empty and has its end id alone; a null doc_id sorts first;
documents with one doc_id are ordered by the hash of their text; repeated rows are
written as often as they occur; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedlake.llm import bytescan, tokens
from feedlake.llm.common import documents, whole_text
from feedlake.session import state_dir

MAX_BITS = 20
BLOCK = 256  # ids between checkpoints
END_ID = 2
PART_BYTES = 1 << 18  # of ids that are encoded at a time, to stay in a core's cache
PAYLOAD_BYTES = 1 << 19  # of codes that are decoded at a time
SYMBOL_SHIFT = np.uint32(5)  # a table's entry is a symbol and, below it, the bits of its code

CODED = "doc_id long, n_tokens long, bits binary, checkpoints array<long>, shard int, place long"
IDS = "doc_id long, copy long, width int, ids binary, counted binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("counted", pa.binary())])


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code with at most ``limit`` bits a symbol."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = len(merged) // 2
        both = np.concatenate([leaves, merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        is_leaf.append(place < n)
    lengths, taken = np.zeros(n, dtype=np.int64), 2 * n - 2
    for mask in reversed(is_leaf):
        own = int(mask[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: symbols in order of (bits, id) have consecutive codes."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.width = int(self.bits[-1]) if len(ids) else 1
        span = 1 << (self.width - self.bits)
        first = np.concatenate([[0], np.cumsum(span)])[:-1]
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.code_of = np.zeros(size, dtype=np.uint64)
        self.bits_of = np.zeros(size, dtype=np.int64)
        self.code_of[self.ids] = first >> (self.width - self.bits)
        self.bits_of[self.ids] = self.bits
        self._span = span

    def table(self) -> np.ndarray:
        """Symbol and bits for every ``width`` bits that may come next."""
        if len(self.ids) and int(self.ids.max()) >> (32 - int(SYMBOL_SHIFT)):
            raise ValueError("an id has more than 27 bits")
        entries = np.ones(1 << self.width, dtype=np.uint32)
        both = self.ids << int(SYMBOL_SHIFT) | self.bits
        entries[: int(self._span.sum())] = np.repeat(both.astype(np.uint32), self._span)
        return entries

    def encode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of 32 bits of all documents, each from a new word on.

        Gives the words, the first word of each document, and where each id's code begins, in
        bits from the document's first word.
        """
        bits = self.bits_of[ids]
        upto = np.concatenate([[0], np.cumsum(bits)])
        n_words = (np.diff(upto[offsets]) + 31) >> 5
        first = np.concatenate([[0], np.cumsum(n_words)])
        local = upto[:-1] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
        start = local + 32 * np.repeat(first[:-1], np.diff(offsets))
        word, at = start >> 5, start & 31
        both = self.code_of[ids] << (64 - at - bits).astype(np.uint64)
        out = np.zeros(first[-1] + 1, dtype=np.uint64)
        if len(ids):
            # A code has fewer bits than a word: but for a document's last word, one starts in each.
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            words = word[firsts]
            out[words] += np.add.reduceat(both >> np.uint64(32), firsts)
            out[words + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), firsts)
        return out[:-1].astype(">u4"), first, local


def decode(words: np.ndarray, begins: np.ndarray, counts: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    """Ids of all blocks one after the other: the k-th id of every block at once, for each k.

    ``words`` are big-endian 32-bit words, ``begins`` the first bit of each block and
    ``counts`` its ids, BLOCK at most.
    """
    wide = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    windows = (wide[:-1] << np.uint64(32)) | wide[1:]
    order = np.argsort(-counts, kind="stable")
    at, keep = begins[order].astype(np.uint64), np.uint64((1 << width) - 1)
    top, low, bits = np.uint64(64 - width), np.uint64(31), np.uint32((1 << int(SYMBOL_SHIFT)) - 1)
    active = len(counts) - np.searchsorted(np.sort(counts), np.arange(BLOCK), side="right")
    out = np.empty((BLOCK, len(counts)), dtype=np.uint32)
    for k, n in enumerate(active.tolist()):
        if not n:
            break
        here = at[:n]
        peek = windows[here >> np.uint64(5)]
        peek >>= top - (here & low)
        peek &= keep
        found = table[peek]
        np.right_shift(found, SYMBOL_SHIFT, out=out[k, :n])
        found &= bits
        here += found
    rows = np.empty((len(counts), BLOCK), dtype=np.uint32)
    rows[order] = out.T
    return rows[np.arange(BLOCK) < counts[:, None]]


def id_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Columns of IDS for every document, and per task one more row that counts its ids.

    A document's row has doc_id, a hash of its text, and its ids with the end id, 2 bytes each where
    those of its batch fit. The row of counts has ``counted``, as many of them as the vocabulary has ids at most.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        seen = np.zeros(0, dtype=np.int64)
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=tokens.BATCH_BYTES)):
            ids, offsets = encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
            own = np.bincount(ids, minlength=len(seen))
            own[: len(seen)] += seen
            seen = own
            width = 2 if len(seen) <= 1 << 16 else 4
            data = ids.astype(f"<u{width}")
            places = (width * offsets).astype(np.int32)  # of one slice of text
            rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(places), pa.py_buffer(data)])
            widths = pa.array(np.full(batch.num_rows, width, np.int32))
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), widths, rows, none], schema=_IDS)
        found = np.flatnonzero(seen)
        if len(found):
            counted = np.stack([found, seen[found]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, None, counted), _IDS)], schema=_IDS)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("copy"), "text").mapInArrow(read, IDS)


def id_counts(rows: DataFrame) -> DataFrame:
    """id and n: how often each id occurs in all documents, from the tasks' counts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            for counted in batch.column(0).to_pylist():
                ids, n = np.frombuffer(counted, "<i8").reshape(2, -1)
                yield pa.record_batch([pa.array(ids), pa.array(n)], names=["id", "n"])

    tasks = rows.filter(F.col("counted").isNotNull()).select("counted")
    return tasks.mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def parts_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes in a binary column; no row is cut."""
    sizes = np.cumsum([len(row.as_buffer()) for row in batch.column(column)])
    cuts = np.unique(sizes // size, return_index=True)[1]
    for at, upto in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(at, upto - at)


def unpacked(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and the offsets between them."""
    parts = [np.frombuffer(ids.as_buffer(), f"<u{width}") for width, ids in zip(rows.column("width").to_pylist(), rows.column("ids"))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def coded_rows(rows: DataFrame, code: Code) -> DataFrame:
    """The documents in codes; the order of rows is that of ``rows``, and columns after those of IDS stay."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "ids", PART_BYTES):
                ids, offsets = unpacked(part)
                words, first, local = code.encode(ids, offsets)
                places = (4 * first).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(places), pa.py_buffer(words)])
                n = np.diff(offsets)
                n_blocks = -(-n // BLOCK)
                upto = np.cumsum(n_blocks)
                inner = np.arange(upto[-1]) - np.repeat(upto - n_blocks, n_blocks)
                checks = local[np.repeat(offsets[:-1], n_blocks) + BLOCK * inner]
                marks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(checks))
                columns = [part.column("doc_id"), pa.array(n), data, marks, part.column("shard"), part.column("place")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "bits", "checkpoints", "shard", "place"])

    return rows.select("doc_id", "width", "ids", "shard", "place").mapInArrow(write, CODED)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write documents and code book below ``path``, in order of doc_id."""
    spark = docs.sparkSession
    raw = state_dir(spark, "token-ids")
    id_rows(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(raw)
    rows = spark.read.schema(IDS).parquet(raw)
    counts = id_counts(rows).collect()  # one vocabulary at most
    ids = np.array([row["id"] for row in counts], dtype=np.int64)
    bits = code_lengths(np.array([row["n"] for row in counts], dtype=np.int64))
    book = spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits)], "id long, bits long")
    book.coalesce(1).write.parquet(f"{path}/code")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.col("copy")]
    dealt = (
        rows.filter(F.col("counted").isNull())
        .select("doc_id", "copy", "width", "ids")
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .withColumns({"shard": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    )
    coded_rows(dealt, Code(ids, bits)).write.parquet(f"{path}/documents")


def _decoded(spark: SparkSession, path: str, each: Callable, schema: str) -> DataFrame:
    """Apply ``each`` to the ids of every document; adds doc_id, shard and place."""
    book = spark.read.parquet(f"{path}/code").collect()  # one vocabulary at most
    code = Code(np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = code.table()
        for whole in batches:
            for batch in parts_of(whole, "bits", PAYLOAD_BYTES):
                parts = [np.frombuffer(row.as_buffer(), dtype=">u4") for row in batch.column("bits")]
                base = 32 * np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                n = batch.column("n_tokens").to_numpy()
                n_blocks = -(-n // BLOCK)
                starts = batch.column("checkpoints").flatten().to_numpy() + np.repeat(base[:-1], n_blocks)
                counts = np.full(len(starts), BLOCK)
                counts[np.cumsum(n_blocks) - 1] = n - BLOCK * (n_blocks - 1)
                ids = decode(np.concatenate(parts), starts, counts, code.width, table)
                offsets = np.concatenate([[0], np.cumsum(n)])
                value = pa.array([each(ids[a:b]) for a, b in zip(offsets, offsets[1:])])
                keys = [batch.column(name) for name in ("doc_id", "shard", "place", "n_tokens")]
                yield pa.RecordBatch.from_arrays([*keys, value], names=["doc_id", "shard", "place", "n_tokens", "value"])

    files = spark.read.parquet(f"{path}/documents")
    found = files.mapInArrow(read, f"doc_id long, shard int, place long, n_tokens long, value {schema}")
    before = Window.unboundedPreceding
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per shard
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(before, -1)), F.lit(0))
    within = Window.partitionBy("shard").orderBy("place").rowsBetween(before, -1)
    return (
        found.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(totals.select("shard", ahead.alias("ahead")), "shard")
        .select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "value")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in the files."""
    found = _decoded(spark, path, lambda ids: ids.astype(np.int32), "array<int>")
    return found.withColumnRenamed("value", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    found = _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long")
    return found.withColumnRenamed("value", "ids_crc32")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = state_dir(spark, "token-files")
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
