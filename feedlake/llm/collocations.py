"""Phrase collocations by weighted acyclic automata: which words stand together more often than alone.

Texts, with A-Z in lower case, are split at . , ; : ! ? and 0x0A-0x0D into pieces and these at blanks and tabs
into words. f(phrase) counts all its contiguous occurrences within pieces, overlaps included, n
all words, both per language. Candidates are phrases of 2 to ``longest`` words with f ≥ ``least``. Cut after
its first k words, a candidate with a = f has l = f(first part), r = f(rest) and the score
⌊1000 · a · n / (l · r)⌋; the cut with the lowest score counts, of equal ones the smallest k. A candidate
whose words lie within a longer one of the same count goes.

Words are numbered by a 64-bit hash of language and word. Every shard of text sorts its n-grams and builds
count automata from them (see automata), one for each range of their prefixes.
Those of one range are united, ``FAN`` at a time, their counts summed, and
what stays under ``least`` goes: no part of a candidate is rarer than the candidate. Counts of the
parts come from composing the automaton of all wanted parts with the counts, range by range. Shards
also list the words behind the numbers; were two words to share a number, the run would stop.

No phrase is more frequent than its words or pairs of words. So shards count words first, then pairs
of words that are frequent, then longer n-grams all of whose pairs are. Filters of fixed size tell
shards what was frequent. They only let too much through, the more the larger the corpus.

Defined cases: a null text is empty; a null language is ``und``; doc_id is not read, so each
row counts, repeated ones too; a word or text may have any length; other columns are ignored; an empty
table, or one without candidates, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from feedlake.llm import automata, bytescan
from feedlake.llm.automata import Automaton
from feedlake.llm.common import documents, filter_bits, may_hold, staged, whole_text

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000  # candidates of a language in the report
SLICE = 1 << 22  # bytes of text whose words are counted at once
SHARD = 2_000_000  # n-grams of a task, at which equal ones are added up; half as many different ones make a shard
RANGES = 4  # for each shuffle partition
FAN = 64  # automata that a union takes at once
UNKNOWN = "und"

NAME = pa.struct([("lang", pa.string()), ("word", pa.string())])
SCHEMA = (
    "range long, ends array<int>, labels array<long>, weights array<long>, targets array<int>, "
    "numbers array<long>, names array<struct<lang: string, word: string>>"
)

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True


class Pieces:
    """The words of a slice of texts, their hashes with the language, and which follow each other in a piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = bytescan.utf8(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.data = bytescan._LOWER[data]
        breaks = _BREAK[self.data]
        filled = ~(breaks | _BLANK[self.data])
        opens, closes = filled.copy(), filled.copy()
        if len(data):
            border = np.zeros(len(data) + 1, dtype=bool)
            border[offsets] = True
            opens[1:] &= ~filled[:-1] | border[1:-1]
            closes[:-1] &= ~filled[1:] | border[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = np.searchsorted(offsets, self.start, side="right") - 1
        self.lang = langs.indices.to_numpy()[row] if len(row) else np.empty(0, np.int64)
        breaks_to = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(breaks, out=breaks_to[1:])
        #: Whether a word and the one after it are neighbours in a piece.
        self.joined = np.zeros(len(row), dtype=bool)
        self.joined[:-1] = (row[1:] == row[:-1]) & (breaks_to[self.start[1:]] == breaks_to[self.end[:-1]])
        own = np.array([hash_of(name) for name in self.names], dtype=np.uint64)
        sums, inverse = bytescan.running_hash(self.data), bytescan.inverse_powers(len(data) + 1)
        alone = bytescan.slice_hash(sums, self.start, self.end, inverse)
        self.hashes = np.maximum(bytescan.mix(alone ^ own[self.lang]), 1) if len(row) else alone  # 0 is no word

    def neighbours(self, words: np.ndarray) -> np.ndarray:
        """Positions whose word and next word are neighbours and pass the filter."""
        good = may_hold(words, self.hashes)
        return np.flatnonzero(self.joined[:-1] & good[:-1] & good[1:])

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Hash of the words at and after each position."""
        return pair_hash(self.hashes[at], self.hashes[at + 1])


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return bytescan.mix(first * bytescan.BASE + second)


def hash_of(name: str) -> int:
    data = np.frombuffer(name.encode(), dtype=np.uint8)
    return int(bytescan.mix(bytescan.running_hash(data)[-1:] + np.uint64(len(data) + 1))[0])


def lang_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text().alias("text"))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[Pieces]:
    return (Pieces(part) for whole in batches for part in bytescan.slices(whole, size=SLICE))


def range_of(rows: np.ndarray, ranges: int) -> np.ndarray:
    """The range that each sequence belongs to: by its first word, from three words on by its first three."""
    mixed = rows[:, 0].copy()
    if rows.shape[1] > 2:
        longer = rows[:, 2] != 0
        mixed[longer] = bytescan.mix(bytescan.mix(rows[longer, 0] * bytescan.BASE + rows[longer, 1]) * bytescan.BASE + rows[longer, 2])
    return (((mixed >> np.uint64(33)) * np.uint64(ranges)) >> np.uint64(31)).astype(np.int64)


Counted = tuple[np.ndarray, np.ndarray]  # sequences and their counts
Names = dict[int, tuple[str, str]]  # language and word by number; a language by itself has no word


def single_words(part: Pieces) -> tuple[Counted, Names]:
    """All words of a slice; of each language its number, as often as it has words."""
    numbers, times = np.unique(part.hashes, return_counts=True)
    own = [hash_of(name) for name in part.names]
    rows = np.concatenate([numbers, np.array(own, dtype=np.uint64)])[:, None]
    counts = np.concatenate([times, np.bincount(part.lang, minlength=len(own))])
    return automata.summed(rows, counts), {number: (name, "") for number, name in zip(own, part.names)}


def word_pairs(words: np.ndarray) -> Callable[[Pieces], tuple[Counted, Names]]:
    """All pairs of words that pass the filter."""

    def count(part: Pieces) -> tuple[Counted, Names]:
        rows = part.hashes[part.neighbours(words)[:, None] + np.arange(2)]
        return automata.summed(rows, np.ones(len(rows), dtype=np.int64)), {}

    return count


def longer_phrases(words: np.ndarray, pairs: np.ndarray, longest: int) -> Callable[[Pieces], tuple[Counted, Names]]:
    """All n-grams of three words or more whose words and pairs pass the filters; the words of all such pairs."""

    def count(part: Pieces) -> tuple[Counted, Names]:
        linked = part.neighbours(words)
        linked = linked[may_hold(pairs, part.pairs(linked))]
        follows = np.zeros(len(part.hashes), dtype=bool)
        follows[linked] = True
        rows, counts, starts = [], [], linked
        for size in range(3, longest + 1):
            starts = starts[follows[starts + size - 2]]
            own = part.hashes[starts[:, None] + np.arange(size)]
            own, times = automata.summed(own, np.ones(len(starts), dtype=np.int64))
            rows.append(np.pad(own, ((0, 0), (0, longest - size))))
            counts.append(times)
        found = (np.concatenate(rows), np.concatenate(counts)) if rows else (np.zeros((0, longest), np.uint64), np.zeros(0, np.int64))
        return found, spelled(part, np.unique(np.concatenate([linked, linked + 1])))

    return count


def spelled(part: Pieces, at: np.ndarray) -> Names:
    """Language and word behind the numbers at these positions."""
    hashes, first = np.unique(part.hashes[at], return_index=True)
    return {
        h: (part.names[part.lang[i]], part.data[part.start[i] : part.end[i]].tobytes().decode())
        for h, i in zip(hashes.tolist(), at[first].tolist())
    }


def batch_of(place: int, automaton: Automaton, names: Names) -> pa.RecordBatch:
    """One row: the automaton of a range, and the words that are numbered in it."""
    columns = {
        "range": pa.array([place], pa.int64()),
        "ends": pa.array([automaton.ends.astype(np.int32)]),
        "labels": pa.array([automaton.labels.view(np.int64)]),
        "weights": pa.array([automaton.weights]),
        "targets": pa.array([automaton.targets.astype(np.int32)]),
        "numbers": pa.array([np.fromiter(names, np.uint64, len(names)).view(np.int64)]),
        "names": pa.array([[{"lang": lang, "word": word} for lang, word in names.values()]], pa.list_(NAME)),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def automaton_of(batch: pa.RecordBatch, row: int) -> Automaton:
    ends, labels, weights, targets = (batch.column(n)[row].values.to_numpy() for n in ("ends", "labels", "weights", "targets"))
    return Automaton(ends.astype(np.int64), labels.view(np.uint64), weights, targets.astype(np.int64))


def names_of(batch: pa.RecordBatch, row: int) -> Names:
    numbers = batch.column("numbers")[row].values.to_numpy().view(np.uint64).tolist()
    return {n: (one["lang"], one["word"]) for n, one in zip(numbers, batch.column("names")[row].as_py())}


def counted(docs: DataFrame, count: Callable[[Pieces], tuple[Counted, Names]], depth: int, least: int, ranges: int) -> DataFrame:
    """The automaton of each range over all texts, of what ``count`` finds ``least`` times or more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counted] = []
        known: Names = {}

        def together() -> Counted:
            return automata.summed(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))

        def built() -> Iterator[pa.RecordBatch]:
            rows, counts = together()
            numbers = np.fromiter(known, np.uint64, len(known))
            names_at = range_of(numbers[:, None], ranges)
            places = range_of(rows, ranges)
            order, by_name = np.argsort(places, kind="stable"), np.argsort(names_at, kind="stable")
            places, names_at = places[order], names_at[by_name]
            for place in np.union1d(places, names_at).tolist():
                own = order[np.searchsorted(places, place) : np.searchsorted(places, place, side="right")]
                here = numbers[by_name[np.searchsorted(names_at, place) : np.searchsorted(names_at, place, side="right")]]
                yield batch_of(place, automata.build(rows[own], counts[own]), {n: known[n] for n in here.tolist()})
            held.clear()
            known.clear()

        for part in slices(batches):
            found, names = count(part)
            held.append(found)
            known |= names
            if sum(len(r) for r, _ in held) >= SHARD:
                held[:] = [together()]
            if 2 * len(held[0][0]) >= SHARD or len(known) >= SHARD:
                yield from built()
        if held:
            yield from built()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((place, batch, row) for batch in batches for row, place in enumerate(batch.column("range").to_pylist()))
        for place, own in groupby(rows, key=lambda r: r[0]):
            sums, names = automata.build(np.zeros((0, depth), np.uint64), np.zeros(0, np.int64)), {}
            while some := list(islice(own, FAN)):
                for _, batch, row in some:
                    for number, name in names_of(batch, row).items():
                        if names.setdefault(number, name) != name:
                            raise ValueError("two words share a number")
                sums = automata.build(*automata.union([sums, *(automaton_of(batch, row) for _, batch, row in some)], depth))
            found, counts = automata.summed(*automata.entries(sums, depth))
            yield batch_of(place, automata.build(found[counts >= least], counts[counts >= least]), names)

    shards = lang_texts(docs).mapInArrow(build, SCHEMA)
    return shards.repartition("range").sortWithinPartitions("range").mapInArrow(unite, SCHEMA)


def phrase_batch(rows: np.ndarray, counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Sequences as lists of numbers, with their counts."""
    offsets = np.concatenate([[0], np.cumsum((rows != 0).sum(axis=1))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[rows != 0].view(np.int64)))
    return pa.RecordBatch.from_arrays([lists, pa.array(counts, pa.int64())], names=names)


def listed(counts: DataFrame, longest: int, least: int) -> DataFrame:
    """words (their numbers) and a of every phrase."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in ((batch, row) for batch in batches for row in range(batch.num_rows)):
            yield phrase_batch(*automata.entries(automaton_of(batch, row), longest), ["words", "a"])

    return counts.mapInArrow(read, "words array<long>, a long").filter(F.col("a") >= least)


def pair_numbers(counts: DataFrame) -> DataFrame:
    """The hash of each counted pair."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in ((batch, row) for batch in batches for row in range(batch.num_rows)):
            pairs, _ = automata.entries(automaton_of(batch, row), 2)
            yield pa.record_batch([bytescan.longs(pair_hash(pairs[:, 0], pairs[:, 1]))], names=["number"])

    return counts.mapInArrow(read, "number long")


def names_in(counts: DataFrame) -> DataFrame:
    """Language and word (name) behind each number that shards listed."""
    one = F.explode(F.arrays_zip("numbers", "names")).alias("one")
    return counts.select(one).select(F.col("one.numbers").alias("number"), F.col("one.names").alias("name"))


def rows_of(lists: pa.Array, longest: int) -> np.ndarray:
    """Lists of numbers as padded sequences."""
    sizes = lists.value_lengths().to_numpy()
    rows = np.zeros((len(sizes), longest), dtype=np.uint64)
    rows[np.repeat(np.arange(len(sizes)), sizes), automata.within(sizes)] = lists.flatten().to_numpy().view(np.uint64)
    return rows


def looked_up(parts: DataFrame, counts: DataFrame, longest: int, ranges: int) -> DataFrame:
    """part and its f, for all ``parts`` (lists of numbers) that were counted."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.column("part") for batch in batches):
            yield pa.RecordBatch.from_arrays([part, pa.array(range_of(rows_of(part, longest), ranges))], names=["part", "range"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known, asked = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if asked:
                rows, _ = automata.summed(np.concatenate(asked), np.ones(sum(map(len, asked)), dtype=np.int64))
                wanted = automata.build(rows, np.ones(len(rows), dtype=np.int64))
                for one in known:  # words and pairs, and longer phrases, are counted apart
                    yield phrase_batch(*automata.compose(wanted, one, longest), ["part", "f"])

        for batch in batches:  # a range's counts come first, then what is asked of it
            places = batch.column("range").to_numpy()
            borders = [*automata.first_of(places).tolist(), len(places)]
            for a, b in zip(borders, borders[1:]):
                if places[a] != place:
                    yield from found()
                    place, known, asked = places[a], [], []
                while a < b and batch.column("ends")[a].is_valid:
                    known.append(automaton_of(batch, a))
                    a += 1
                if b > a:
                    asked.append(rows_of(batch.column("part").slice(a, b - a), longest))
        yield from found()

    asked = parts.mapInArrow(deal, "part array<long>, range long")
    both = counts.drop("numbers", "names").unionByName(asked, allowMissingColumns=True)
    both = both.repartition("range").sortWithinPartitions("range", F.col("part").isNotNull())
    return both.mapInArrow(look_up, "part array<long>, f long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, n and score of all candidates that lie in no longer one of the same count."""
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = staged(counted(docs, single_words, 1, least, ranges), "counts-1")
    words = listed(single, 1, least)
    totals = words.join(names_in(single), F.col("number") == F.col("words")[0]).select(F.col("name.lang").alias("lang"), F.col("a").alias("n"))
    frequent = filter_bits(words.select(F.col("words")[0].alias("number")))
    double = staged(counted(docs, word_pairs(frequent), 2, least, ranges), "counts-2")
    frequent_pairs = filter_bits(pair_numbers(double))
    more = staged(counted(docs, longer_phrases(frequent, frequent_pairs, longest), longest, least, ranges), "counts-3")
    counts = single.unionByName(double).unionByName(more)

    size = F.size("words")
    found = staged(listed(double.unionByName(more), longest, least), "candidates")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size).alias("right"))
    cuts = staged(cuts, "cuts")
    parts = cuts.select(F.explode(F.array("left", "right")).alias("part")).distinct()
    f = staged(looked_up(parts, counts, longest, ranges), "parts")
    names = names_in(more)
    met = cuts.join(f.toDF("left", "l"), "left").join(f.toDF("right", "r"), "right")
    langs = names.select(F.col("number").alias("first"), F.col("name.lang").alias("lang"))
    met = met.withColumn("first", F.col("words")[0]).join(langs, "first").join(totals, "lang")
    exact = "decimal(19,0)"  # products of two have 38 digits, which is exact
    score = F.expr(f"(cast(1000 * a as {exact}) * cast(n as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    worst = met.withColumn("score", score).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))

    inner = found.filter(size > 2).select("a", F.col("words").alias("whole"), F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("a", "whole", "m", F.explode(F.sequence(F.lit(1), F.size("whole") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy(F.slice("whole", F.col("at"), F.col("m")).alias("words")).agg(F.max("a").alias("longer"))
    kept = worst.join(inner, "words", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("cut.a")))

    spelled_out = kept.select("lang", "words", "cut", F.posexplode("words").alias("at", "number")).join(names, "number")
    word = F.struct("at", F.col("name.word").alias("word"))
    spelled_out = spelled_out.groupBy("lang", "words").agg(F.first("cut").alias("cut"), F.array_sort(F.collect_list(word)).alias("spelled"))
    return spelled_out.select("lang", F.array_join("spelled.word", " ").alias("phrase"), *(f"cut.{c}" for c in ("a", "l", "r", "n", "score")))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    found = collocations(documents(spark, sf_dir))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents)
), counted AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
  FROM pieces, unnest(range(1, 6)) AS s(m), unnest(range(1, len(words) - m + 2)) AS r(i)
  GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), frequent AS (
  SELECT lang, phrase, m, f FROM counted WHERE f >= 100
), cuts AS (
  SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS words
  FROM frequent, unnest(range(1, m)) AS c(k) WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, words,
         (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(words[:k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT o.lang, array_to_string(string_split(o.phrase, ' ')[i:i + s.m - 1], ' ') AS phrase, o.f
  FROM frequent o, unnest(range(2, o.m)) AS s(m), unnest(range(1, o.m - s.m + 2)) AS r(i) WHERE o.m > 2
), kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.f >= 100 * w.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
