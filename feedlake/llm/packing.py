"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

Which piece goes where depends on its length alone, and no more than ``capacity`` lengths
exist. So the exact best-fit-decreasing packing of all pieces is found from a table of
counts per length: pieces of one length are placed run by run into sequences with equal room
left, and a segment tree over the rooms 0…capacity finds the tightest open one in
logarithmic time. Between two lengths at most two new runs of sequences arise, and
each visit of a run halves its room at least, so the plan has at most about
3 · capacity · log2(capacity) rows, whatever the number of pieces. Only these counts and this
plan pass the driver.

The pieces themselves are numbered within their length: a task counts as it reads, and the
counts of (length, task) are summed before it. The plan then tells sequence and offset of
each number.

Defined cases: a null text is empty and gives a piece of its end id alone; a null doc_id is
kept; repeated rows are packed as often as they occur; other columns are ignored; an empty
table gives an empty table. Pieces of equal length are numbered in the order in which the
tasks read them; any order gives a packing of the same size.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from feedlake.llm import bytescan, tokens
from feedlake.llm.common import documents, staged

CAPACITY = 2048
END_ID = 0
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
)


class OpenSequences:
    """Runs of sequences by the room that is left in them, under a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.leaves)  # how many rooms below a node have runs
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        if not self.runs[room]:
            self._mark(room, 1)
        self.runs[room].append((first, n))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._mark(room, -1)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that some sequence has."""
        node = self.leaves + length
        if self.used[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def _mark(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.used[node] += change
            node //= 2


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Plan rows (length, number of the first piece, first sequence, pieces a sequence, offset).

    A row holds from its first piece up to that of the next row of its length: pieces go
    one after the other into the sequences from the first one on.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"a piece must have 1 to {capacity} ids")
    plan, opened, n_sequences = [], OpenSequences(capacity), 0
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            room = opened.tightest(length)
            if room is None:
                room, first, n = capacity, n_sequences, -(-left // (capacity // length))
                n_sequences += n
            else:
                first, n = opened.take(room)
            each = room // length
            taken = min(n, -(-left // each))
            if n > taken:
                opened.add(room, first + taken, n - taken)
            placed = min(left, taken * each)
            full, rest = divmod(placed, each)
            plan.append((length, number, first, each, capacity - room))
            if full and room > each * length:
                opened.add(room - each * length, first, full)
            if rest:
                opened.add(room - rest * length, first + full, 1)
            number, left = number + placed, left - placed
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, each numbered within its length and task."""
    end = tokens.pack([end_id])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = tokens.encoder(tokenizer).encode, TaskContext.get().partitionId(), Counter()
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=tokens.BATCH_BYTES)):
            rows = []
            all_ids, offsets = encode(batch.column("text"))
            for doc_id, begin, upto in zip(batch.column(0).to_pylist(), offsets, offsets[1:]):
                ids = all_ids[begin:upto].tobytes() + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with length, part and nth.

    ``part`` and ``nth`` number the pieces of a length: nth counts from 0 within (part, length).
    """
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    plan = best_fit({row["length"]: row["n"] for row in totals}, capacity)
    keys = (plan[:, 0] << 48) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            length, number = (batch.column(name).to_numpy() for name in ("length", "number"))
            row = plan[np.searchsorted(keys, (length << 48) + number, side="right") - 1]
            ahead, slot = np.divmod(number - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row[:, 2] + ahead), pa.array(row[:, 4] + slot * length)],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    numbered = pieces.join(offsets, ["length", "part"]).withColumn("number", F.col("before") + F.col("nth"))
    kept = [name for name in pieces.columns if name not in ("part", "nth")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*kept, "number").schema)
    placed = numbered.select(*kept, "number").mapInArrow(place, f"{shape}, sequence_id long, offset long")
    return placed.drop("number")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = staged(cut(docs, tokenizer, capacity, end_id), "pieces")
    packed = pack(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
