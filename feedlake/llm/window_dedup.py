"""Substring dedup on words: remove every word of a window of words that also starts elsewhere.

A difference cover of a period v is a set D of remainders such that any two positions reach D
with one shift below v. Runs of ``length`` - v + 1 words, the anchors, are hashed only where
they begin at a position of D modulo v. If two windows of ``length`` words are equal, some shift
below v takes both starts to positions of D, so both hold one anchor at one offset; no pair
is missed, and |D| / v of the positions are hashed (5 of 21 for windows of 35 words).

Anchors that occur once are dropped: a filter of fixed size with the others' hashes is applied where texts are
read, and a join drops what it lets through. The rest are extended: the v - 1 words on either side
of an anchor are its context, and all windows around the anchor lie in it. Places of one anchor
with one context are a class; all windows of a class with several places repeat. Of
anchors with several classes the first place of each sends the windows around it, each window of a text
once, and those that begin in two places are found by counting. So a group of any size
costs a row per place and v rows per class, and no pairs are made.

Words are runs of other characters than 0x20 and 0x09-0x0D, unchanged. All copies go, the first
too; windows are judged on the input, not on what is left, and never cross documents.
Anchors are compared by one 64-bit hash, contexts by another within an anchor, windows by both kinds.

Defined cases: a null text has no words; rows of one doc_id (null for one) are told apart by
their texts, equal rows are one document and get equal results; texts with fewer words than
a window stay; kept words are joined by one space; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import NO_ID, doc_key, documents, filter_bits, may_hold, staged, texts_of, whole_text

LENGTH = 35
SLICE = 1 << 20
#: Smallest difference covers of their periods, each difference once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
OTHER = np.uint64(0xD6E8FEB86659FD93)  # makes the second kind of hash
PLACE = ["doc", "copy", "pos"]


def period_for(length: int) -> int:
    """The longest period that leaves two fifths of a window to the anchor; 1 hashes every position."""
    return max([v for v in COVERS if 5 * (length - v + 1) >= 2 * length], default=1)


def cover_of(period: int) -> np.ndarray:
    """Whether each remainder is in the cover."""
    inside = np.zeros(period, dtype=bool)
    inside[list(COVERS.get(period, (0,)))] = True
    return inside


class Words:
    """The words of a slice of texts: their places, and running sums for hashes of runs."""

    def __init__(self, texts: pa.Array):
        _, _, hashes, self.first = bytescan.words(*bytescan.utf8(texts), lower=False)
        self.n = np.diff(self.first)
        order = bytescan.powers(bytescan.BASE, len(hashes) + 1)
        self.inverse = bytescan.inverse_powers(len(hashes) + 1)
        self.sums = []
        for codes in (hashes, bytescan.mix(hashes ^ OTHER)):
            sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(codes * order[:-1], out=sums[1:])
            self.sums.append(sums)

    def run(self, kind: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return bytescan.slice_hash(self.sums[kind], start, end, self.inverse)


def anchor_rows(docs: DataFrame, length: int, wanted: list[str], bits: np.ndarray | None = None) -> DataFrame:
    """All anchors of all texts that pass the filter: columns of anchor, context, doc, copy, pos (the number of its first word)."""
    period = period_for(length)
    side, width, inside = period - 1, length - period + 1, cover_of(period)
    schema = ", ".join(f"{name} {'int' if name == 'pos' else 'long'}" for name in wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            words = Words(batch.column("text"))
            row = np.repeat(np.arange(len(words.n)), words.n)
            pos = np.arange(len(row)) - words.first[row]
            n = words.n[row]
            at = np.flatnonzero(inside[pos % period] & (pos + width <= n) & (n >= length))
            anchor = words.run(0, at, at + width)
            if bits is not None:
                keep = may_hold(bits, anchor)
                at, anchor = at[keep], anchor[keep]
            row, pos, n = row[at], pos[at], n[at]
            found = {"anchor": bytescan.longs(anchor)}
            if len(wanted) > 1:
                left, right = np.minimum(pos, side), np.minimum(n - pos - width, side)
                context = bytescan.mix(words.run(1, at - left, at + width + right) + left.astype(np.uint64))
                found["context"] = bytescan.longs(context)
                found |= {name: batch.column(name).take(pa.array(row)) for name in ("doc", "copy")}
                found["pos"] = pa.array(pos.astype(np.int32))
            yield pa.RecordBatch.from_arrays([found[name] for name in wanted], names=wanted)

    return docs.select("doc", "copy", "text").mapInArrow(read, schema)


def windows_of(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """Two hashes, doc, copy and start of all windows around the needed places, each once."""
    side = period_for(length) - 1
    names = ["one", "two", "doc", "copy", "start"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            words, places = Words(batch.column("text")), batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            at = words.first[row] + places.flatten().to_numpy()
            around = np.zeros(words.first[-1] + 1, dtype=np.int32)  # how many places a start lies around
            np.add.at(around, np.maximum(at - side, words.first[row]), 1)
            np.add.at(around, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(around) > 0)
            row = np.searchsorted(words.first, starts, side="right") - 1
            fits = starts - words.first[row] + length <= words.n[row]
            row, starts = row[fits], starts[fits]
            hashes = [bytescan.longs(words.run(kind, starts, starts + length)) for kind in (0, 1)]
            keys = [batch.column(name).take(pa.array(row)) for name in ("doc", "copy")]
            start = pa.array((starts - words.first[row]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*hashes, *keys, start], names=names)

    by_doc = needed.groupBy("doc", "copy").agg(F.collect_set("pos").alias("places"))
    texts = texts_of(docs.select(F.col("doc").alias("doc_id"), "text"), needed)
    texts = texts.withColumn("copy", F.xxhash64("text")).dropDuplicates(["doc", "copy"])
    met = texts.join(by_doc, ["doc", "copy"]).select("doc", "copy", "text", "places")
    return met.mapInArrow(read, "one long, two long, doc long, copy long, start int")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc, copy, begin and upto (word numbers) of all words to remove; spans may overlap and pass a text's end."""
    period = period_for(length)
    side, width = period - 1, length - period + 1
    repeated = anchor_rows(docs, length, ["anchor"]).groupBy("anchor").agg(F.count("*").alias("n"))
    repeated = staged(repeated.filter("n > 1").select("anchor"), "anchors-repeated")
    places = anchor_rows(docs, length, ["anchor", "context", *PLACE], filter_bits(repeated))
    places = staged(places.join(repeated, "anchor"), "anchors")
    place = F.struct(*PLACE)
    classes = places.groupBy("anchor", "context").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    classes = staged(classes.select("anchor", "context", "first.*", (F.col("first") != F.col("last")).alias("several")), "classes")
    copied = places.join(classes.filter("several").select("anchor", "context"), ["anchor", "context"])
    begin = F.greatest(F.col("pos") - side, F.lit(0)).alias("begin")
    copied = copied.select("doc", "copy", begin, (F.col("pos") + width + side).alias("upto"))

    mixed = classes.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    needed = staged(classes.join(mixed, "anchor").select(*PLACE), "mixed")
    windows = staged(windows_of(docs, needed, length), "windows")
    shared = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two")
    again = windows.join(shared, ["one", "two"])
    return copied.unionByName(again.select("doc", "copy", F.col("start").alias("begin"), (F.col("start") + length).alias("upto")))


def kept_words(words: list[bytes], begin: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """The words outside of all spans."""
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(np.minimum(upto[order], len(words)))
    opens = np.flatnonzero(np.concatenate([[True], begin[1:] > upto[:-1]]))
    closes = np.append(opens[1:] - 1, len(begin) - 1)
    kept, at = [], 0
    for a, b in zip(begin[opens].tolist(), upto[closes].tolist()):
        kept += words[at:a]
        at = b
    return kept + words[at:]


def dedup_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, ``kept`` (the words left, joined by one space), n_words and n_removed of every row."""
    keyed = docs.select(doc_key().alias("doc"), F.xxhash64(whole_text()).alias("copy"), whole_text().alias("text"))
    spans = repeated_spans(keyed, length).groupBy("doc", "copy").agg(F.collect_list(F.struct("begin", "upto")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole)):
            rows = []
            for doc, text, own in zip(*(batch.column(c) for c in ("doc", "text", "spans"))):
                words = text.as_py().encode().split()
                kept = words
                if own.is_valid:
                    kept = kept_words(words, *(own.values.field(c).to_numpy() for c in ("begin", "upto")))
                rows.append((doc.as_py(), b" ".join(kept).decode(), len(words), len(words) - len(kept)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.large_string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "kept", "n_words", "n_removed"])

    met = keyed.join(spans, ["doc", "copy"], "left").select("doc", "text", "spans")
    found = met.mapInArrow(cut, "doc long, kept string, n_words long, n_removed long")
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "kept", "n_words", "n_removed")


def op12_window_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_windows(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def plain_windows(rows: list[tuple], length: int = LENGTH) -> dict[tuple, tuple[int, int, str]]:
    """The same by counting every window of every different row: what small inputs are tested against."""
    words = {row: re.findall(r"[^\x20\x09-\x0D]+", row[1] or "") for row in set(rows)}
    starts = {row: range(len(own) - length + 1) for row, own in words.items()}
    times = Counter(tuple(own[i : i + length]) for row, own in words.items() for i in starts[row])
    out = {}
    for row, own in words.items():
        gone = {k for i in starts[row] if times[tuple(own[i : i + length])] > 1 for k in range(i, i + length)}
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out[row] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), each AS (
  SELECT doc_id, i AS nr, words[i] AS word,
         CASE WHEN i + 34 <= len(words) THEN array_to_string(words[i:i + 34], ' ') END AS run
  FROM split, unnest(range(1, len(words) + 1)) AS r(i)
), repeated AS (
  SELECT run, 1 AS again FROM each WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1
), marked AS (
  SELECT doc_id, nr, word,
         max(again) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM each LEFT JOIN repeated USING (run)
), left_over AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY nr) AS kept
  FROM marked WHERE gone IS NULL GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN left_over USING (doc_id)
"""
