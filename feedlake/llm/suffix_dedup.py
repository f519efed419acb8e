"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier.

The corpus is cut into many small suffix arrays, so that equal strings meet in one of them.
In every string of ``length`` bytes the ``GRAM``-byte gram with the least hash is its anchor; equal
strings have it at one offset. The bytes around an anchor within which such strings lie are
its context. Anchors that occur once are dropped. Anchors with one context in several places
need no sorting: all places but the first are removed whole. Of anchors with several
contexts, the first place of each context sends its bytes. They are trimmed to what some other
context of the anchor shares on that side, and those that are left too short drop out. Of parts that are
now equal around the anchor all but the earliest are removed whole. The different ones
are sorted as one text, their suffixes grouped under Lyndon prefixes (see suffix_sort). In runs
of suffixes that share ``length`` bytes all but the earliest start are removed. A string that occurs
twice in one part needs no sorting of that part alone: its second place has an anchor, and so a context, of its own.

An anchor with more than ``MOST`` contexts, such as a line that a third of all documents have,
would make one array too large, so it is divided: it is lengthened by half of what a string may reach
beyond it, once to the right and once to the left. A string that holds the anchor holds one of the
two, and equal strings hold the same, so each context is narrowed to the strings of either one.
Narrowed contexts that are equal are collapsed as above, and an anchor that still has too many is divided
again. Anchors of ``length`` bytes have one context, so this ends, and is exact.

A string starts earlier in a smaller doc_id, or in the same document before. Strings are
judged on the input, not on what is left, and never cross documents.

Defined cases: a null text is empty; a null doc_id sorts first; repeated rows are one document
and are treated alike; documents that share a doc_id but not the text are left whole and
count as no earlier copy but for what their ids tell; texts under 100 bytes stay; kept bytes
need not be whole characters; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import NO_ID, doc_key, documents, staged, texts_of, whole_text
from feedlake.llm.suffix_sort import common_prefixes, suffix_array

LENGTH = 100
GRAM = 50
MOST = 2048  # contexts of one anchor in one suffix array
SLICE = 1 << 19

ANCHORS = "anchor long, context long, doc long, pos long"
SPANS = "doc long, begin long, upto long"
NARROWED = "anchor long, context long, doc long, first long, at long, size long, bytes binary"
ARRAYS = ["anchor", "gram", "doc", "first", "at", "bytes"]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width], for every i that has a whole window."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def grams(data: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on; never 0."""
    n = len(data) - GRAM + 1
    return bytescan.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n]) | np.uint64(1)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Position, hash and context hash of all anchors, and the row of each."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none.view(np.uint64), none
    sums, inverse = bytescan.running_hash(data), bytescan.inverse_powers(len(data) + 1)
    gram = grams(data, sums, inverse)
    width = length - GRAM + 1
    least = sliding(gram, width, np.minimum)  # of each string of ``length`` bytes
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    whole = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[whole], 1)
    np.add.at(inside, offsets[whole + 1] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0  # strings across two texts do not count
    edge = np.zeros(width - 1, dtype=np.uint64)
    reached = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(gram == reached)
    row = np.searchsorted(offsets, at, side="right") - 1
    side = length - GRAM
    left = np.maximum(offsets[row], at - side)
    right = np.minimum(offsets[row + 1], at + GRAM + side)
    before = bytescan.slice_hash(sums, left, at, inverse)
    after = bytescan.slice_hash(sums, at + GRAM, right, inverse)
    return at, gram[at], bytescan.mix(before * bytescan.BASE + after), row


def anchor_rows(docs: DataFrame, length: int, wanted: list[str]) -> DataFrame:
    """Columns of ANCHORS for all anchors of all texts."""
    schema = ", ".join(f"{name} long" for name in wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            data, offsets = bytescan.utf8(batch.column("text"))
            at, gram, context, row = anchors_of(data, offsets, length)
            found = {"anchor": bytescan.longs(gram)}
            if len(wanted) > 1:
                found |= {
                    "context": bytescan.longs(context),
                    "doc": batch.column("doc").take(pa.array(row)),
                    "pos": pa.array(at - offsets[row]),
                }
            yield pa.RecordBatch.from_arrays([found[name] for name in wanted], names=wanted)

    return docs.select(doc_key().alias("doc"), "text").mapInArrow(read, schema)


def context_bytes(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """anchor, n, doc, first (position of the first byte), at (of the anchor in it) and bytes of the needed contexts."""
    schema = "anchor long, n long, doc long, first long, at long, bytes binary"
    side = length - GRAM

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            rows = []
            for doc, text, places in zip(*(batch.column(name) for name in ("doc", "text", "places"))):
                text, doc = (text.as_py() or "").encode(), doc.as_py()
                for place in places.as_py():
                    pos = place["pos"]
                    first = max(0, pos - side)
                    rows.append((place["anchor"], place["n"], doc, first, pos - first, text[first : pos + GRAM + side]))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "n", "doc", "first", "at", "bytes"])

    by_doc = needed.groupBy("doc").agg(F.collect_list(F.struct("anchor", "n", "pos")).alias("places"))
    return texts_of(docs, needed).join(by_doc, "doc").select("doc", "text", "places").mapInArrow(read, schema)


def shared_prefix(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from their start on."""
    n = min(len(a), len(b))
    other = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (other.bit_length() + 7) // 8


def reaches(parts: list[bytes]) -> list[int]:
    """How far each string agrees with the one of the others that agrees with it longest."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    near = [shared_prefix(parts[i], parts[j]) for i, j in zip(order, order[1:])]
    out = [0] * len(parts)
    for i, before, after in zip(order, [0, *near], [*near, 0]):
        out[i] = max(before, after)
    return out


def trimmed(group: list[tuple], length: int, gram: int = GRAM) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int]]]:
    """The different parts of contexts that may hold a shared string, and the spans of their later copies.

    A part reaches around the anchor as far as any other context agrees. Parts that are equal from
    their anchors on both sides hold the same strings at the same places, so those of all but the
    earliest are repeats.
    """
    before = reaches([part[:at][::-1] for _, _, at, part in group])
    after = reaches([part[at + gram :] for _, _, at, part in group])
    parts: dict[tuple[int, bytes], tuple[int, int]] = {}
    copies = []
    for (doc, first, at, part), left, right in zip(group, before, after):
        size = left + gram + right
        if size < length:
            continue
        own, place = (left, part[at - left : at + gram + right]), (doc, first + at - left)
        known = parts.setdefault(own, place)
        if known != place:
            early, late = (known, place) if known < place else (place, known)
            parts[own] = early
            copies.append((*late, late[1] + size))
    return [(*place, part) for (_, part), place in parts.items()], copies


def repeats_in(group: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int]]:
    """(doc, start) of all strings of ``length`` bytes that start earlier in the group.

    The group has (doc, position of the first byte, bytes) of each context.
    """
    # Contexts are joined by a zero byte; strings are counted up to the end of theirs.
    text, begins, valid = b"".join(part + b"\0" for _, _, part in group), [], bytearray()
    for _, _, part in group:
        begins.append(len(valid))
        fit = max(len(part) - length + 1, 0)
        valid += b"\1" * fit + b"\0" * (len(part) + 1 - fit)
    order = [i for i in suffix_array(text) if valid[i]]
    shared = common_prefixes(text, order, length)
    found, at = [], 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and shared[upto]:
            upto += 1
        if upto - at > 1:
            starts = []
            for i in order[at:upto]:
                k = bisect_right(begins, i) - 1
                starts.append((group[k][0], group[k][1] + i - begins[k]))
            first = min(starts)
            found += [s for s in starts if s != first]
        at = upto
    return found


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """Disjoint (doc, begin, upto) that cover ``length`` bytes from each start on."""
    out: list[list[int]] = []
    for doc, start in sorted(starts):
        if out and out[-1][0] == doc and start <= out[-1][2]:
            out[-1][2] = start + length
        else:
            out.append([doc, start, start + length])
    return [tuple(span) for span in out]


def sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings from one suffix array per anchor, which is ``gram`` bytes long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor, spans = [], (0, GRAM), []

        def spans_of(group: list[tuple]) -> list[tuple[int, int, int]]:
            parts, copies = trimmed(group, length, anchor[1]) if len(group) > 1 else ([], [])
            return copies + merged(repeats_in(parts, length), length) if len(parts) > 1 else copies

        def done() -> pa.RecordBatch:
            columns = list(zip(*spans)) if spans else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "begin", "upto"])

        for batch in batches:
            for own, gram, doc, first, at, part in zip(*(batch.column(c).to_pylist() for c in ARRAYS)):
                if (own, gram) != anchor:
                    spans += spans_of(group)
                    group, anchor = [], (own, gram)
                group.append((doc, first, at, part))
            yield done()
            spans = []
        spans += spans_of(group)
        yield done()

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select(*ARRAYS).repartition(parts, "anchor").sortWithinPartitions("anchor", "gram")
    return dealt.mapInArrow(read, SPANS)


def narrowed(contexts: DataFrame, length: int, gram: int, more: int) -> DataFrame:
    """Columns of NARROWED: each context by its anchor lengthened by ``more`` bytes to the right, and to the left.

    Either one keeps the strings that hold its longer anchor; it is left out if there are none.
    """
    wide = gram + more
    side = length - wide

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
            parts = batch.column("bytes").to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
            text = b"".join(parts)
            data = np.frombuffer(text, dtype=np.uint8)
            sums, inverse = bytescan.running_hash(data), bytescan.inverse_powers(len(data) + 1)
            doc, first, at = (batch.column(name).to_numpy() for name in ("doc", "first", "at"))
            for begin in (offsets[:-1] + at, offsets[:-1] + at - more):
                left, right = np.maximum(offsets[:-1], begin - side), np.minimum(offsets[1:], begin + wide + side)
                fits = (begin >= offsets[:-1]) & (begin + wide <= offsets[1:]) & (right - left >= length)
                own, begin, left, right = np.flatnonzero(fits), begin[fits], left[fits], right[fits]
                before = bytescan.slice_hash(sums, left, begin, inverse)
                after = bytescan.slice_hash(sums, begin + wide, right, inverse)
                columns = [
                    bytescan.longs(bytescan.slice_hash(sums, begin, begin + wide, inverse)),
                    bytescan.longs(bytescan.mix(before * bytescan.BASE + after)),
                    *map(pa.array, (doc[own], first[own] + left - offsets[own], begin - left, right - left)),
                    pa.array([text[a:b] for a, b in zip(left.tolist(), right.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NARROWED.split(", ")])

    return contexts.select("doc", "first", "at", "bytes").mapInArrow(read, NARROWED)


def divided(contexts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of anchors with more than MOST of them, by longer anchors: those for arrays, and spans of copies."""
    arrays, spans, gram = [], [], GRAM
    crowded = contexts.filter(F.col("n") > MOST)
    while gram < length and not crowded.isEmpty():
        # A string that holds the anchor reaches length - gram bytes beyond it, so at least half of them on one side.
        more = (length - gram + 1) // 2
        gram += more
        parts = staged(narrowed(crowded, length, gram - more, more), "narrowed")
        first = parts.groupBy("anchor", "context").agg(F.min(F.struct("doc", "first", "at", "bytes")).alias("one"))
        first = staged(first.select("anchor", "context", "one.*"), "narrowed-first")
        origin = first.select("anchor", "context", F.col("doc").alias("doc_0"), F.col("first").alias("first_0"))
        copies = parts.join(origin, ["anchor", "context"]).filter((F.col("doc") != F.col("doc_0")) | (F.col("first") != F.col("first_0")))
        spans.append(copies.select("doc", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("upto")))
        several = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
        left = staged(first.join(several, "anchor").select("anchor", F.lit(gram).cast("long").alias("gram"), "n", "doc", "first", "at", "bytes"), "narrowed-several")
        arrays.append(left.filter(F.col("n") <= MOST).select(*ARRAYS))
        crowded = left.filter(F.col("n") > MOST)
    return arrays, spans


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, begin and upto of all bytes to remove; spans may overlap and pass a text's ends."""
    side = length - GRAM
    repeated = anchor_rows(docs, length, ["anchor"]).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    repeated = staged(repeated, "anchors-repeated")
    places = staged(anchor_rows(docs, length, ["anchor", "context", "doc", "pos"]).join(repeated, "anchor"), "anchors")
    first = places.groupBy("anchor", "context").agg(F.min(F.struct("doc", "pos")).alias("first"))
    first = staged(first.select("anchor", "context", "first.*"), "contexts")
    origin = first.select("anchor", "context", F.col("doc").alias("doc_0"), F.col("pos").alias("pos_0"))
    copies = places.join(origin, ["anchor", "context"]).filter((F.col("doc") != F.col("doc_0")) | (F.col("pos") != F.col("pos_0")))
    whole = copies.select("doc", F.greatest(F.col("pos") - side, F.lit(0)).alias("begin"), (F.col("pos") + GRAM + side).alias("upto"))

    several = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    needed = staged(first.join(several, "anchor").select("anchor", "n", "doc", "pos"), "several")
    contexts = staged(context_bytes(docs, needed, length), "context-bytes")
    arrays, spans = divided(contexts, length)
    fit = contexts.filter(F.col("n") <= MOST).withColumn("gram", F.lit(GRAM).cast("long")).select(*ARRAYS)
    by_array = sorted_spans(reduce(DataFrame.unionByName, arrays, fit), length)
    return reduce(DataFrame.unionByName, spans, whole.unionByName(by_array))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, ``kept`` (the bytes left), n_bytes, n_removed and n_spans of every row."""
    per_doc = repeated_spans(docs, length).groupBy("doc").agg(F.collect_list(F.struct("begin", "upto")).alias("spans"))
    copies = docs.select(doc_key().alias("doc"), F.xxhash64(whole_text()).alias("copy"))
    mixed = copies.groupBy("doc").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).filter("low != high")
    per_doc = per_doc.join(mixed, "doc", "left_anti")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole)):
            rows = []
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc", "text", "spans"))):
                data = (text.as_py() or "").encode()
                kept, n_removed, n_spans, at = [], 0, 0, 0
                if spans.is_valid:
                    begin, upto = (spans.values.field(c).to_numpy() for c in ("begin", "upto"))
                    order = np.argsort(begin, kind="stable")
                    begin, upto = begin[order], np.maximum.accumulate(np.minimum(upto[order], len(data)))
                    opens = np.flatnonzero(np.concatenate([[True], begin[1:] > upto[:-1]]))
                    closes = np.append(opens[1:] - 1, len(begin) - 1)
                    for a, b in zip(begin[opens].tolist(), upto[closes].tolist()):
                        kept.append(data[at:a])
                        n_removed, n_spans, at = n_removed + b - a, n_spans + 1, b
                kept.append(data[at:])
                rows.append((doc.as_py(), b"".join(kept), len(data), n_removed, n_spans))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "kept", "n_bytes", "n_removed", "n_spans"])

    met = docs.select(doc_key().alias("doc"), "text").join(per_doc, "doc", "left").select("doc", "text", "spans")
    found = met.mapInArrow(cut, "doc long, kept binary, n_bytes long, n_removed long, n_spans long")
    return found.withColumn("doc_id", F.nullif("doc", F.lit(NO_ID))).drop("doc")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def plain_dedup(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by remembering every string: what small inputs are tested against."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        data, marks = texts[doc], bytearray(len(texts[doc]))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                marks[i : i + length] = b"\1" * length
            seen.add(part)
        n_spans = sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))
        kept = bytes(b for b, m in zip(data, marks) if not m)
        out[doc] = (len(data), sum(marks), n_spans, hashlib.sha256(kept).hexdigest())
    return out
