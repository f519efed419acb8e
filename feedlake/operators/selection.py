"""Distributed selection: the first rows of a table, and the rows of a table that keys ask for.

Neither sorts or moves the table. A cap finds its threshold by counting digits of the order
column, coarse to fine; a key lookup applies a bitmap of the asked keys where the table is read.
What is left is a plain filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedlake.operators.ranking import LEAST

DIGIT = 16  # bits of the order column that one round of counts decides
BITMAP_BITS = 1 << 23  # of the filter of asked keys: 1 MB, whatever the number of keys
BUCKET_BITS = 1 << 15  # of one row of it, as Spark's bitmap functions have them


def place_of(order: str) -> Column:
    """The order column as a long; a missing value comes first."""
    return F.coalesce(F.col(order).cast("long"), F.lit(LEAST))


def threshold(rows: DataFrame, order: str, n: int) -> tuple[int, int] | None:
    """The place at which the first ``n`` rows end, and how many rows lie before it; None if all rows are within.

    Digits of the bits in which places differ are counted, the coarsest first, each round below
    the digit that the one before it chose. A round gives 2^16 counts at most, formed by
    aggregates with partial results, however large ``n`` is.
    """
    places = rows.select(place_of(order).alias("place"))
    low, high, count = places.agg(F.min("place"), F.max("place"), F.count("*")).first()
    if count <= n:
        return None
    before = 0
    bits = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
    while bits > 0:
        width = min(bits, DIGIT)
        bits -= width
        # With its sign bit turned, a long is in the order of its bits.
        digit = F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(LEAST)), bits).bitwiseAND(F.lit((1 << width) - 1))
        within = places.filter(F.col("place").between(low, high)).groupBy(digit.alias("digit")).count()
        for found in sorted(within.collect(), key=lambda row: row["digit"]):
            if before + found["count"] > n:
                start = ((low - LEAST) >> (bits + width) << width | found["digit"]) << bits
                low, high = start + LEAST, start + LEAST + (1 << bits) - 1
                break
            before += found["count"]
    return low, before


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, nulls first, in no order of their own.

    Of rows that share the last place as many are taken as fit, any of them.
    """
    if n <= 0:
        return rows.limit(0)
    found = threshold(rows, order, n)
    if found is None:
        return rows
    last, before = found
    place = place_of(order)
    whole = rows.filter(place < last)
    if before == n:
        return whole
    return whole.unionByName(rows.filter(place == last).limit(n - before))


def asked_bitmap(keys: DataFrame, name: str) -> DataFrame:
    """The bits of all keys as at most BITMAP_BITS / BUCKET_BITS rows of 4 KB."""
    place = F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))
    return (
        keys.select(place.alias("_place"))
        .groupBy(F.floor(F.col("_place") / BUCKET_BITS).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.col("_place") % BUCKET_BITS).alias("_bits"))
    )


def rows_asked_for(table: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``table`` whose ``name`` is among ``keys``, and few others: the caller joins what is left.

    The bitmap has a fixed size, so it is broadcast: rows that nobody asks for are dropped where
    they are read, before any shuffle. More keys only make it less selective.
    """
    place = F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))
    # The row travels as one value, so that no name of its columns can clash.
    marked = table.select(F.struct("*").alias("_row"), place.alias("_place"))
    marked = marked.withColumn("_bucket", F.floor(F.col("_place") / BUCKET_BITS))
    bit = F.col("_place") % BUCKET_BITS
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (bit % 8).cast("int")) == 1
    return marked.join(F.broadcast(asked_bitmap(keys, name)), "_bucket").filter(is_set).select("_row.*")
