"""N-gram Jaccard join by grouped prefixes: which documents share enough word shingles.

Words are runs of other bytes than 0x20 and 0x09-0x0D, with A-Z in lower case. A document's
set is its distinct shingles; with fewer words the whole sequence is one; without words it
is empty and linked with nothing. Two documents link if 100 · |A ∩ B| ≥ percent · |A ∪ B|.

All documents put their shingles in one order, rare ones first: those that prefixes may hold are
counted over the whole table, and the ``MAX_FREQUENT`` most frequent come last by count. Any fixed
order is right; this one keeps posting lists short. Two linked sets share a shingle
among their first n - ⌈percent · n / 100⌉ + 1. Documents with one set are one class; classes
with one such prefix and size are one group, and only groups are in the posting lists.

Only the components are asked for, so not all pairs of a list are tried. First each group
meets the smallest and the largest group of its list and size band, each band's smallest that
of the next band, each class the smallest of its group. What links is one component. Then
pairs within a list that lie in two components are tried, all of them, so no link between
components is missed. Before texts are read, a pair must fit by size, and by parity
bitmaps: where they differ in more bits than the two sets may differ in shingles, the pair
cannot link. The rest is verified on the whole texts.

Defined cases: a null text is empty; rows of one doc_id (a null doc_id is one) are one node,
which has the links of all of them; repeated rows get equal results; a component of the
null doc_id alone has a null component_id; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import NO_ID, doc_key, documents, staged, texts_of, whole_text
from feedlake.llm.components import components

MAX_FREQUENT = 1 << 17  # of the counted shingles; more would only shorten lists further
REPEATS = 3  # in one slice, for a shingle beyond the reach of prefixes to be counted there
FREQUENT = 16  # counted in all, for a shingle to be ordered by its count
COUNT_BYTES = 1 << 23  # of text in a slice that is counted
HASH_BYTES = 1 << 19  # of text that is hashed at a time, which takes some thirty times its memory
BITMAP = [f"b{i}" for i in range(8)]  # of 64 bits each


def distinct_shingles(texts: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, hashes, first = bytescan.words(*bytescan.utf8(texts))
    runs, begin = bytescan.shingles(hashes, first, size)
    sets = []
    for a, b in zip(begin, begin[1:]):
        own = np.sort(runs[a:b])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return sets, np.array([len(s) for s in sets], dtype=np.int64)


def frequent_shingles(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """The most frequent of all shingles that prefixes may hold, most frequent last; MAX_FREQUENT at most.

    In order of hashes alone a prefix has a set's smallest ones. Twice as many are counted,
    over all documents, as frequent ones make room for those after them; of the others
    those that a slice repeats, such as those of large groups of near copies.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=COUNT_BYTES)):
            hashed = [distinct_shingles(part.column("text"), size) for part in bytescan.slices(batch, size=HASH_BYTES)]
            sets, n = [own for part, _ in hashed for own in part], np.concatenate([sizes for _, sizes in hashed])
            reach = 2 * (n - -(-percent * n // 100) + 1)
            values, times = np.unique(np.concatenate(sets), return_counts=True)
            near = np.concatenate([own[:k] for own, k in zip(sets, reach)])
            keep = times >= REPEATS
            keep[np.searchsorted(values, near)] = True
            values, times = values[keep], times[keep]
            yield pa.record_batch([bytescan.longs(values), pa.array(times)], names=["shingle", "n"])

    found = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).collect()
    return np.array([row["shingle"] for row in reversed(top)], dtype=np.int64).view(np.uint64)


def set_rows(docs: DataFrame, frequent: np.ndarray, size: int, percent: int, also: tuple[str, ...] = ()) -> DataFrame:
    """doc, n, two hashes of the set, hash and members of the prefix, the parity bitmap, and longs ``also``."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]
    names = ["doc", "n", "set_1", "set_2", "group", "prefix", *BITMAP, *also]
    schema = "doc long, n int, set_1 long, set_2 long, group long, prefix array<int>, " + ", ".join(f"{b} long" for b in [*BITMAP, *also])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=HASH_BYTES)):
            sets, n = distinct_shingles(batch.column("text"), size)
            one, two, group, prefixes, bits = [], [], [], [], np.zeros((len(sets), 8), dtype=np.uint64)
            for row, own in enumerate(sets):
                one.append(own.sum(dtype=np.uint64))
                two.append(bytescan.mix(own).sum(dtype=np.uint64))
                if len(values) and len(own):
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    rank = np.where(values[at] == own, by_value[at] + 1, 0)
                    own = own[np.lexsort((own, rank))] if rank.any() else own
                prefix = own[: len(own) - -(-percent * len(own) // 100) + 1] if len(own) else own
                order = bytescan.powers(bytescan.BASE, len(prefix))
                group.append((bytescan.mix(prefix) * order).sum(dtype=np.uint64))
                prefixes.append((prefix >> np.uint64(16)).astype(np.uint32).view(np.int32))
                spread = bytescan.mix(own ^ bytescan.BASE)
                np.bitwise_xor.at(bits[row], (spread >> np.uint64(6)).astype(np.int64) & 7, np.uint64(1) << (spread & np.uint64(63)))
            hashes = [bytescan.longs(np.array(c, dtype=np.uint64)) for c in (one, two, group)]
            columns = [batch.column(0), pa.array(n.astype(np.int32)), *hashes, pa.array(prefixes, pa.list_(pa.int32()))]
            columns += [bytescan.longs(np.ascontiguousarray(bits[:, i])) for i in range(8)]
            columns += [batch.column(c) for c in also]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(doc_key().alias("doc"), "text", *also).mapInArrow(read, schema)


def may_link(percent: int) -> Column:
    """Of classes a and b: the sizes allow it, and so do the bitmaps."""
    n_a, n_b = F.col("a_n"), F.col("b_n")
    fits = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (F.least(n_a, n_b) > 0)
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITMAP))
    # |A Δ B| is |A| + |B| - 2 |A ∩ B|, and |A ∩ B| is at least percent / (100 + percent) of the sum.
    return fits & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))


def pair_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of pairs with about HASH_BYTES of text on both sides together."""
    offsets = sum(bytescan.utf8(batch.column(name))[1] for name in ("text_a", "text_b"))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, by_text: bool = False) -> DataFrame:
    """The pairs (a, b) of documents whose whole texts link.

    ``by_text`` tells that rows of one doc_id have one text, which is then read once.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pair_slices(whole)):
            left, n_left = distinct_shingles(batch.column("text_a"), size)
            right, n_right = distinct_shingles(batch.column("text_b"), size)
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], dtype=np.int64)
            linked = (100 * same >= percent * (n_left + n_right - same)) & (same > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    both = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    found = texts_of(docs, both)
    if by_text:
        found = found.groupBy("doc").agg(F.first("text").alias("text"))
    texts, other = found.toDF("a", "text_a"), found.toDF("b", "text_b")
    met = pairs.join(texts, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(check, "a long, b long").distinct()


def linked_components(
    docs: DataFrame, size: int = 4, percent: int = 85, also: tuple[str, ...] = (), by_text: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows (doc, n, class, and longs ``also``), and the component of each class that has links."""
    sets = staged(set_rows(docs, frequent_shingles(docs, size, percent), size, percent, also), "shingle-sets")
    same = ["n", "set_1", "set_2"]
    filled = sets.filter("n > 0")
    shape = ["group", *BITMAP]
    classes = staged(
        filled.groupBy(*same).agg(F.min("doc").alias("rep"), *(F.first(c).alias(c) for c in [*shape, "prefix"])),
        "shingle-classes",
    )
    of_class = sets.join(classes.select(*same, "rep"), same, "left").select("doc", "n", "rep", *also)
    band = F.floor(F.log(F.col("n")) / log(100 / percent)).cast("int")
    grouped = classes.groupBy("n", "group").agg(F.min("rep").alias("gid"), F.count("*").alias("members"), F.first("prefix").alias("prefix"))
    groups = staged(grouped.withColumn("band", band), "shingle-groups")
    members = classes.join(groups.select("n", "group", "gid", "band", "members"), ["n", "group"]).drop("prefix", *same[1:], "group")
    members = staged(members, "shingle-members")

    # A prefix lists a shingle twice only where two hashes agree in the kept bits.
    entries = groups.select(F.explode(F.array_distinct("prefix")).alias("key"), "gid", "band")
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    lists = staged(entries.join(shared, "key"), "shingle-lists")
    heads = staged(
        lists.groupBy("key", "band").agg(F.min("gid").alias("low"), F.max("gid").alias("high")), "list-heads"
    )
    met = lists.join(heads, ["key", "band"])
    following = heads.select("key", (F.col("band") - 1).alias("band"), F.col("low").alias("b"))
    first = reduce(
        DataFrame.unionByName,
        [
            met.select(F.col("gid").alias("a"), F.col("low").alias("b")),
            met.select(F.col("gid").alias("a"), F.col("high").alias("b")),
            heads.join(following, ["key", "band"]).select(F.col("low").alias("a"), "b"),
            members.filter("members > 1").select(F.col("rep").alias("a"), F.col("gid").alias("b")),
        ],
    )
    features = classes.select("rep", "n", *BITMAP)
    as_a = features.toDF("a", "a_n", *(f"a_{b}" for b in BITMAP))
    as_b = features.toDF("b", "b_n", *(f"b_{b}" for b in BITMAP))
    first = first.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = staged(first.join(as_a, "a").join(as_b, "b").filter(may_link(percent)).select("a", "b"), "pairs")
    links = staged(verified(tried, docs, size, percent, by_text), "verified")
    found = staged(components(links), "components")

    # Members of all lists with their components; lists within one component are done.
    label = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    label = label.withColumn("component", F.coalesce("component", "rep"))
    spread = lists.select(F.col("key").cast("long"), "gid").unionByName(
        members.filter("members > 1").select(F.xxhash64("gid").alias("key"), "gid").distinct()
    )
    listed = staged(spread.join(label, "gid").select("key", "rep", "n", "band", "component", *BITMAP), "listed")
    ends = listed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = listed.join(ends.filter("low != high").select("key"), "key")
    left = mixed.select("key", "band", *(F.col(c).alias(f"a_{c}") for c in ["rep", "n", "component", *BITMAP]))
    right = mixed.select(
        "key",
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
        F.col("band").alias("b_band"),
        *(F.col(c).alias(f"b_{c}") for c in ["rep", "n", "component", *BITMAP]),
    )
    once = (F.col("b_band") > F.col("band")) | (F.col("a_rep") > F.col("b_rep"))
    across = left.join(right, ["key", "band"]).filter(
        once & (F.col("a_component") != F.col("b_component")) & may_link(percent)
    )
    across = across.select(F.greatest("a_rep", "b_rep").alias("a"), F.least("a_rep", "b_rep").alias("b")).distinct()
    rest = staged(across.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = staged(verified(rest, docs, size, percent, by_text), "verified")
    if not more.isEmpty():
        found = staged(components(links.unionByName(more)), "components")
    return of_class, found


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    of_class, found = linked_components(docs, size, percent)
    component = F.coalesce("component", "rep", "doc")
    # Rows of one doc_id are one node: it has the smallest component of its classes.
    labelled = of_class.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return labelled.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
    )


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null first, then of the least hash of its text.

    Rows are linked by their texts alone: here a node is a text, told by its 64-bit hash, and
    what a row is, by its doc_id and that hash. Of equal rows one stays. Rows without
    words are linked with nothing and stay.
    """
    text = F.xxhash64(whole_text())
    of_class, found = linked_components(
        docs.select(doc_key().alias("id"), text.alias("doc_id"), "text"), size, percent, ("id",), True
    )
    rows = of_class.filter("n > 0").groupBy("id", "doc", "rep").agg(F.count("*").alias("times"))
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rows = staged(rows.select("id", "doc", "times", F.coalesce("component", "rep").alias("component")), "rows")
    kept = rows.groupBy("component").agg(F.min(F.struct("id", "doc")).alias("kept"))
    kept = staged(kept.select("kept.id", "kept.doc"), "kept")
    gone = rows.join(kept, ["id", "doc"], "left_anti").select("id", "doc")
    again = staged(rows.filter("times > 1").join(kept, ["id", "doc"], "left_semi").select("id", "doc"), "again")
    # The row travels as one value, so that no name of its columns can clash.
    keyed, key = docs.select(F.struct("*").alias("row"), doc_key().alias("id"), text.alias("doc")), ["id", "doc"]
    if again.isEmpty():
        return keyed.join(gone, key, "left_anti").select("row.*")
    single = keyed.join(gone.unionByName(again), key, "left_anti")
    one = keyed.join(again, key, "left_semi").dropDuplicates(key)
    return single.select("row.*").unionByName(one.select("row.*"))
