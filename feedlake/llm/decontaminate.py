"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The items are the indexed side and every passage of every text is a query. Passages are
windows of twice the longest item of a shard with a step of its length, so each place
where an item may stand lies whole in one. An item's score for a passage is the sum of its BM25
weights over the item's words that the passage has, as a share of its sum over all its
words; all items of at least ``MIN_SCORE`` are retrieved. Postings of a word are in blocks of ``BLOCK``
items with the largest share in each. For all passages of a slice at once, the best shares of each
block are summed over the passage's distinct words; where no block can reach the score,
nothing is retrieved. For the others WAND walks the postings: the lists are kept by their next item, the pivot is the first item at which the
lists' best shares reach the score, and a pivot whose blocks fall short is skipped up to the
end of the nearest block.

A retrieved item is verified on words: the last sentence of an item is its answer, what comes
before it the question (an item of one sentence is cut in the middle). A document has the item
if at least 80 % of its runs of five words stand in the window, and at least half of
those of the question and of the answer each. An item of so few words that one changed word
takes more of its runs (5 to 28) is also had if, aligned to the window, it keeps 80 % of its words, and
half of those of the question and of the answer each; its overlaps are then these shares. Words are told by Unicode: case is folded,
characters have their compatible composed form, and all but letters, digits and accents ends a word.

The index is cut into shards of ``SHARD`` items, and the documents pass them one after the other within
one task. All shards are built in the driver and sent to every worker: the test set must fit both.

Defined cases: null and empty texts, and those without letters and digits, hold and match nothing; items and documents are told by
their ids, a null id is one; repeated rows give one result row; repeated items are items of
their own; an item with fewer than five words is one run; other columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Row, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import documents

RUN = 5
MIN_OVERLAP = 0.8
MIN_PART = 0.5
MIN_SCORE = 0.6
BLOCK = 2  # items in a block of postings
SHARD = 4096  # items of one index
K1, B = 1.2, 0.75
SLICE = 1 << 20

FOUND = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"

_NO_WORD = r"[^\pL\pN\pM]+"
_SENTENCE_END = regex.compile(r"[.!?][\s]+(?=\S)|\n+")


def hashed(text: str) -> np.ndarray:
    """Hashes of the words of a text."""
    return word_hashes(pa.array([text]))[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the first word of each; words are runs of letters, digits and their accents."""
    folded = pa.array([text and fold_case(text) for text in texts.to_pylist()], pa.large_string())
    _, _, hashes, first = bytescan.words(*bytescan.utf8(pc.replace_substring_regex(folded, _NO_WORD, " ")))
    return hashes, first


def fold_case(text: str) -> str:
    """One form for texts that differ in case or in how a character is encoded, in any script."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def runs(hashes: np.ndarray) -> set[int]:
    """Runs of RUN words; a shorter text is one run."""
    found, _ = bytescan.shingles(hashes, np.array([0, len(hashes)]), RUN)
    return set(found.tolist())


class Item:
    def __init__(self, item_id: int | None, text: str):
        self.item_id = item_id
        ends = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
        words = hashed(text)
        cut = len(words) // 2
        if ends:
            inside = len(hashed(text.strip()[: ends[-1]]))
            cut = inside if 0 < inside < len(words) else cut
        self.words, self.cut = words, cut
        # One changed word takes RUN runs; of an item with few it would take too many. Fewer than RUN words must be equal.
        self.is_short = len(words) >= RUN and RUN > (1 - MIN_OVERLAP) * (len(words) - RUN + 1) + 1e-9
        self.all, self.question, self.answer = runs(words), runs(words[:cut]), runs(words[cut:])


class Index:
    """Impact-ordered blocks of postings for a shard of items."""

    def __init__(self, rows: list[tuple[int | None, str]], n_items: int, df: dict[int, int], mean_length: float):
        self.items = [item for item in (Item(i, t) for i, t in rows) if len(item.words)]
        postings: dict[int, list[tuple[int, float]]] = {}
        for number, item in enumerate(self.items):
            terms, tf = np.unique(item.words, return_counts=True)
            norm = K1 * (1 - B + B * len(item.words) / mean_length)
            idf = np.array([np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
            weight = idf * tf * (K1 + 1) / (tf + norm)
            for term, share in zip(terms.tolist(), (weight / weight.sum()).tolist()):
                postings.setdefault(term, []).append((number, share))
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        self.postings = [postings[t] for t in self.terms.tolist()]
        self.block_best = [
            [max(s for _, s in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.postings
        ]
        self.best = np.array([max(blocks) for blocks in self.block_best])
        # All blocks of all terms in one list, for sums over many passages at once.
        self.n_blocks = -(-len(self.items) // BLOCK)
        grouped = [{} for _ in self.postings]
        for blocks, p in zip(grouped, self.postings):
            for number, share in p:
                blocks[number // BLOCK] = max(blocks.get(number // BLOCK, 0.0), share)
        self.flat_size = np.array([len(b) for b in grouped], dtype=np.int64)
        self.flat_begin = np.cumsum(self.flat_size) - self.flat_size
        self.flat_block = np.array([k for b in grouped for k in b], dtype=np.int64)
        self.flat_share = np.array([v for b in grouped for v in b.values()])
        self.longest = max((len(item.words) for item in self.items), default=0)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 where no item has it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose share of score for distinct terms is at least ``least``."""
        found, cursors = [], [[self.postings[t][0][0], t, 0] for t in terms]
        least -= 1e-9
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, term, _) in enumerate(cursors):
                bound += self.best[term]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Blocks that may hold the pivot item: their best shares bound its score.
            bound, end = 0.0, None
            for cursor in cursors[: pivot + 1]:
                cursor[2] = self._seek(cursor[1], cursor[2], item)
                postings = self.postings[cursor[1]]
                if cursor[2] < len(postings):
                    block = cursor[2] // BLOCK
                    bound += self.block_best[cursor[1]][block]
                    last = postings[min((block + 1) * BLOCK, len(postings)) - 1][0]
                    end = last if end is None else min(end, last)
            if bound >= least:
                score = sum(
                    self.postings[t][i][1]
                    for _, t, i in cursors[: pivot + 1]
                    if i < len(self.postings[t]) and self.postings[t][i][0] == item
                )
                if score >= least:
                    found.append((item, score))
                target = item + 1
            else:
                following = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
                target = max(item + 1, min(following, (end if end is not None else item) + 1))
            moved = []
            for k, (now, term, i) in enumerate(cursors):
                if k <= pivot:
                    i = self._seek(term, i, target)
                    if i == len(self.postings[term]):
                        continue
                    now = self.postings[term][i][0]
                moved.append([now, term, i])
            cursors = moved
        return found

    def _seek(self, term: int, i: int, item: int) -> int:
        postings = self.postings[term]
        while i < len(postings) and postings[i][0] < item:
            i += 1
        return i


def build_indexes(rows: list[Row]) -> list[Index]:
    """Indexes of the items, SHARD items each, with weights from all of them."""
    texts = [(row["item_id"], row["text"] or "") for row in rows]
    counts, total = {}, 0
    for _, text in texts:
        words = hashed(text)
        total += len(words)
        for term in np.unique(words).tolist():
            counts[term] = counts.get(term, 0) + 1
    mean = max(total / max(len(texts), 1), 1.0)
    return [Index(texts[i : i + SHARD], len(texts), counts, mean) for i in range(0, len(texts), SHARD)]


def matches(index: Index, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """(row, item, score, overlaps) of the texts of a slice that have an item.

    A passage is two neighbouring segments of the longest item's length.
    """
    if not index.longest or not len(hashes):
        return
    number, step = index.look_up(hashes), index.longest
    n_words = np.diff(first)
    n_segments = -(-n_words // step)
    row = np.repeat(np.arange(len(n_words)), n_segments)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    begin = first[row] + nth * step
    last = nth == n_segments[row] - 1
    end = np.minimum(begin + 2 * step, first[row + 1])
    known = np.flatnonzero(number >= 0)
    segment = np.searchsorted(begin, known, side="right") - 1
    pairs = np.unique(segment * len(index.terms) + number[known])
    segment, term = np.divmod(pairs, len(index.terms))
    possible = np.zeros(len(begin), dtype=bool)
    width = max(1, (1 << 21) // max(index.n_blocks, 1))
    cuts = np.searchsorted(segment, np.arange(0, len(begin) + width, width))
    carried = np.zeros(index.n_blocks)
    for at in reversed(range(len(cuts) - 1)):
        low = at * width
        n = min(width, len(begin) - low)
        own_segment, own_term = segment[cuts[at] : cuts[at + 1]] - low, term[cuts[at] : cuts[at + 1]]
        size = index.flat_size[own_term]
        place = np.arange(size.sum()) + np.repeat(index.flat_begin[own_term] - (np.cumsum(size) - size), size)
        cell = np.repeat(own_segment, size) * index.n_blocks + index.flat_block[place]
        bound = np.bincount(cell, index.flat_share[place], n * index.n_blocks).reshape(n, -1)
        following = np.concatenate([bound[1:], carried[None]])
        following[last[low : low + n]] = 0
        possible[low : low + n] = (bound + following).max(axis=1) >= MIN_SCORE - 1e-6
        carried = bound[0]
    for k in np.flatnonzero(possible):
        own = number[begin[k] : end[k]]
        terms = np.unique(own[own >= 0])
        window = None
        for number_, score in index.retrieve(terms.tolist(), MIN_SCORE):
            item = index.items[number_]
            if window is None:
                window = window_runs(hashes[begin[k] : end[k]])
            shares = [len(part & window) / len(part) if part else 1.0 for part in (item.all, item.question, item.answer)]
            if min(shares[0] - MIN_OVERLAP, shares[1] - MIN_PART, shares[2] - MIN_PART) < 0 and item.is_short:
                shares = aligned_shares(item, hashes[begin[k] : end[k]])
            if shares[0] >= MIN_OVERLAP and min(shares[1:]) >= MIN_PART:
                yield int(row[k]), item.item_id, score, *shares


def aligned_shares(item: Item, window: np.ndarray) -> list[float]:
    """Shares of an item, its question and its answer that keep their words where each fits the window best."""
    parts = (item.words, item.words[: item.cut], item.words[item.cut :])
    if np.isin(item.words, window).mean() < MIN_OVERLAP:
        return [0.0] * len(parts)
    return [1 - least_edits(part, window) / len(part) if len(part) else 1.0 for part in parts]


def least_edits(part: np.ndarray, window: np.ndarray) -> int:
    """Words to change, insert or drop to make a part one slice of the window."""
    at = np.arange(len(window) + 1)
    edits = np.zeros(len(window) + 1, dtype=np.int64)
    for i, word in enumerate(part):
        here = edits + 1
        here[1:] = np.minimum(here[1:], edits[:-1] + (window != word))
        edits = np.minimum.accumulate(here - at) + at
    return int(edits.min())


def window_runs(window: np.ndarray) -> set[int]:
    """Runs of 1 to RUN words: a part of an item with fewer words is one run of its length."""
    sizes = range(1, min(RUN, len(window)) + 1)
    return {h for n in sizes for h in bytescan.shingles(window, np.array([0, len(window)]), n)[0].tolist()}


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it has, with score and overlaps."""
    # The test set is read whole: it is cut into shards of a fixed number of items.
    indexes = build_indexes(benchmark.select(F.col("item_id").cast("long"), "text").collect())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            hashes, first = word_hashes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple, tuple] = {}
            for index in indexes:
                for row, item, *found in matches(index, hashes, first):
                    key = (ids[row], item)
                    best[key] = max(best.get(key, (0.0,)), tuple(found))
            rows = [(*key, *found) for key, found in best.items()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
            names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, FOUND)
    measures = ["score", "overlap", "question_overlap", "answer_overlap"]
    return found.groupBy("doc_id", "item_id").agg(*(F.max(m).alias(m) for m in measures))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose own text has no test item, whatever their doc_id."""
    indexes = build_indexes(benchmark.select(F.col("item_id").cast("long"), "text").collect())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            hashes, first = word_hashes(batch.column("text"))
            keep = np.ones(batch.num_rows, dtype=bool)
            for index in indexes:
                keep[[row for row, *_ in matches(index, hashes, first)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(read, docs.schema)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
