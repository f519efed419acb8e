"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its bytes. At each level runs of one name become one
name; then deterministic coin tossing labels every name: the lowest bit in which it differs
from its left neighbour, and its value there. Four tosses turn 64-bit names into labels
below 6 of which neighbours differ, so local minima are at most some ten names apart;
they begin the phrases, and a phrase's hash is its name at the next level. A boundary
depends on a few names beside it alone, so equal substrings get equal phrases but for those at
their ends, wherever they stand.

The fingerprint of a text is a sketch of the set of its phrase names of levels 2 and 3
(about 10 and 30 bytes): names fall in ``BINS`` bins by hash and each bin keeps 16 bits of
its smallest. The likeness of two fingerprints is the share of bins that agree among those
that either fills: an estimate of the Jaccard similarity of the two phrase sets.

Defined cases: a null text counts as empty; an empty text has no phrases and the fingerprint
``0…0``, alike (1) to another such and unlike (0) to all else; equal texts have equal
fingerprints; a null doc_id comes last in descending order, documents with one doc_id are
ordered by the hash of their text, repeated rows follow one another; a table of one
document is followed by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import documents, staged, whole_text

BINS = 64
SKETCHED_LEVELS = (2, 3)
TOSSES = 4
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def coin_tosses(names: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Small labels of which no two neighbours within a text are equal."""
    one = np.uint64(1)
    for _ in range(TOSSES):
        left = np.empty_like(names)
        left[1:] = names[:-1]
        left[head] = ~names[head]
        differ = names ^ left
        low = differ & (~differ + one)
        bit = (names & low) != 0
        names = (np.bitwise_count(low - one).astype(np.uint64) << one) | bit.astype(np.uint64)
    return names


def phrases(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and which of them begin a text.

    ``head`` marks the first name of each text; texts without names have none.
    """
    if not len(names):
        return names, head
    opens = head.copy()
    opens[1:] |= names[1:] != names[:-1]
    first = np.flatnonzero(opens)
    run = np.diff(first, append=len(names)).astype(np.uint64)
    names, head = names[first], head[first]
    names = np.where(run > 1, bytescan.mix(names * bytescan.BASE + run), names)
    labels = coin_tosses(names, head)
    lower = np.ones(len(labels), dtype=bool)  # than the next name, or at a text's end
    lower[:-1] = (labels[:-1] < labels[1:]) | head[1:]
    minimum = head.copy()
    minimum[1:] |= (labels[1:] < labels[:-1]) & lower[1:]
    begin = np.flatnonzero(minimum)
    at = np.arange(len(names)) - np.repeat(begin, np.diff(begin, append=len(names)))
    weights = bytescan.powers(bytescan.BASE, int(at.max()) + 1)
    return bytescan.mix(np.add.reduceat(bytescan.mix(names) * weights[at], begin)), head[begin]


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of BINS 16-bit values for each text; 0 marks an empty bin."""
    out = np.full((len(texts), BINS), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    filled = np.flatnonzero(sizes)
    if len(filled):
        head = np.zeros(len(data), dtype=bool)
        head[np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])] = True
        names = data.astype(np.uint64)
        for level in range(1, max(SKETCHED_LEVELS) + 1):
            names, head = phrases(names, head)
            if level in SKETCHED_LEVELS:
                row = filled[np.cumsum(head) - 1]
                spread = bytescan.mix(names + np.uint64(level))
                np.minimum.at(out, (row, (spread % np.uint64(BINS)).astype(np.int64)), spread >> np.uint64(8))
    found = out != np.iinfo(np.uint64).max
    return np.where(found, (out >> np.uint64(6)) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of sketches, row by row."""
    either = ((left > 0) | (right > 0)).sum(axis=1)
    agree = ((left == right) & (left > 0)).sum(axis=1)
    return np.where(either > 0, agree / np.maximum(either, 1), 1.0)


def hexed(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u2")]


def compared(doc_ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """Result rows of documents and the texts that follow them."""
    edited = [own[: len(own) - len(own) // 2] + after[: len(own) // 2] for own, after in zip(texts, nexts)]
    as_bytes = [[t.encode() for t in column] for column in (texts, edited)]
    own, changed = map(sketches, as_bytes)
    after = own[1:] if nexts[:-1] == texts[1:] else sketches([t.encode() for t in nexts[:-1]])
    after = np.concatenate([after, sketches([nexts[-1].encode()])])
    columns = [
        pa.array(doc_ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in as_bytes[1]]),
        pa.array(hexed(own)),
        pa.array(hexed(changed)),
        pa.array(likeness(own, changed)),
        pa.array(likeness(own, after)),
    ]
    return pa.record_batch(columns, names=[field.split()[0] for field in OUT.split(", ")])


def _bounded(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (doc_id, text, next text) in groups of about as much text as a slice."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size >= bytescan.SLICE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    Documents are dealt by ranges of doc_id, each text once. All but the last document of a
    range meet the next one there; the first and last texts of the ranges meet in a second,
    small step.
    """
    spark = docs.sparkSession
    schema = f"{OUT}, part int, first_text string, last_id long, last_text string"
    empty = [pa.int32(), pa.string(), pa.int64(), pa.string()]
    names = ["part", "first_text", "last_id", "last_text"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None

        def pairs() -> Iterator[tuple]:
            nonlocal first, last
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py() or ""
                    if last is None:
                        first = text
                    else:
                        yield *last, text
                    last = (doc_id, text)

        for group in _bounded(pairs()):
            found = compared(*map(list, zip(*group)))
            nulls = [pa.nulls(found.num_rows, kind) for kind in empty]
            yield pa.RecordBatch.from_arrays([*found.columns, *nulls], names=[*found.schema.names, *names])
        if last is not None:
            values = [pa.array([v], k) for v, k in zip((part, first, *last), empty)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            fields = [field.split()[0] for field in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *values], names=[*fields, *names])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for group in _bounded(rows):
            yield compared(*map(list, zip(*group)))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.col("copy")]
    dealt = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(whole_text()).alias("copy"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    found = staged(dealt.mapInArrow(within, schema), "fingerprints")
    fields = [field.split()[0] for field in OUT.split(", ")]
    ends = found.filter(F.col("part").isNotNull())
    # A row per range: which range follows; after the last comes the first.
    numbers = ends.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    start = ends.agg(F.min("part").alias("start"))
    follows = numbers.join(start, F.lit(True)).select("part", F.coalesce("next", "start").alias("next"))
    met = (
        ends.select("part", "last_id", "last_text")
        .join(follows, "part")
        .join(ends.select(F.col("part").alias("next"), "first_text"), "next")
        .select("last_id", "last_text", "first_text")
    )
    inner = found.filter(F.col("part").isNull()).select(*fields)
    return inner.unionByName(met.mapInArrow(across, OUT))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
