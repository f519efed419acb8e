"""Order-dependent numbering that holds when one key has a third of all rows.

A plain window puts all rows of a key into one task. Here the order columns are
cut into digits, coarse to fine. Rows are windowed per (key, all digits), where
at most 2^20 values of the last order column meet; totals per digit are formed
by aggregates, with partial results before the shuffle, and summed level by level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

DIGIT_BITS = 20  # a digit spans 2^20 values of the next finer one
LEAST = -(1 << 63)  # digit of a missing order value, which sorts first


def sequence_of(feed_ord: Column, entry_ord: Column) -> Column:
    """What sorts and identifies an entry: its feed and its position in the feed."""
    return F.struct(feed_ord.cast("long").alias("feed_ord"), entry_ord.cast("long").alias("entry_ord"))


def order_longs(rows: DataFrame, order: list[str]) -> list[str]:
    """The order columns, a struct of longs as its fields."""
    found = []
    for name in order:
        kind = rows.schema[name].dataType
        found += [f"{name}.{field}" for field in kind.names] if isinstance(kind, T.StructType) else [name]
    return found


def order_digits(columns: list[str]) -> dict[str, Column]:
    """Digits of long order columns, coarse to fine; each is unique only below those before it.

    The finest digit leaves the low bits of the last column to the rows themselves.
    """
    *upper, last = columns
    shifts = [(name, bits) for name in upper for bits in (DIGIT_BITS, 0)]
    shifts.append((last, DIGIT_BITS))
    return {
        f"_digit_{n}": F.coalesce(F.shiftright(F.col(name).cast("long"), bits), F.lit(LEAST))
        for n, (name, bits) in enumerate(shifts)
    }


def totals_before(totals: DataFrame, keys: list[str], digits: list[str]) -> DataFrame:
    """``_offset``: the sum of ``_total`` over all earlier digits of the key.

    Siblings below one coarser digit are windowed, 2^20 at most; what comes before
    that digit is known from the level above. A key has few of the coarsest digits:
    one covers a million feeds, or a million values of a single order column. They
    are windowed per key; without keys they are one short list.
    """
    prefix = [*keys, *digits[:-1]]
    before = Window.partitionBy(*prefix).orderBy(digits[-1]).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("_total").over(before), F.lit(0))
    if len(digits) == 1 and keys:
        return totals.select(*prefix, *digits, here.alias("_offset"))
    if len(digits) == 1:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(digits[0]).alias("digit"), F.col("_total").alias("total"))))
        each = totals.agg(ordered.alias("_all"))
        earlier = F.transform(
            "_all",
            lambda one, at: F.struct(
                one["digit"].alias(digits[0]),
                F.aggregate(F.slice("_all", F.lit(1), at), F.lit(0).cast("long"), lambda s, x: s + x["total"]).alias("_offset"),
            ),
        )
        return each.select(F.inline(earlier))
    upper = totals.groupBy(*prefix).agg(F.sum("_total").alias("_total"))
    base = totals_before(upper, keys, digits[:-1]).withColumnRenamed("_offset", "_base")
    return (
        totals.withColumn("_here", here)
        .join(base, prefix)
        .select(*prefix, digits[-1], (F.col("_base") + F.col("_here")).alias("_offset"))
    )


def running_total(
    rows: DataFrame, keys: list[str], order: list[str], out: str, value: Column | None = None
) -> DataFrame:
    """Add the inclusive running total of ``value`` (default 1) per key.

    ``keys`` must not be null. The order columns must be longs or structs of longs,
    and unique together within a key.
    """
    value = (F.lit(1) if value is None else value).cast("long")
    digits = order_digits(order_longs(rows, order))
    groups = [*keys, *digits]
    marked = rows.withColumns({"_value": value, **digits})
    totals = marked.groupBy(*groups).agg(F.sum("_value").alias("_total"))
    offsets = totals_before(totals, keys, list(digits))
    within = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        marked.withColumn("_here", F.sum("_value").over(within))
        .join(offsets, groups)
        .withColumn(out, F.col("_offset") + F.col("_here"))
        .drop("_value", "_here", "_offset", *digits)
    )


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add the row number per key, starting at 1."""
    return running_total(rows, keys, order, out)


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    Spark cuts each task's rows to the limit before the shuffle as long as the
    limit is below its threshold; above it the chunked numbering is used.
    """
    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n < limit:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = rows.withColumn("_position", position)
    else:
        ranked = numbered(rows, keys, order, "_position")
    return ranked.filter(F.col("_position") <= n).drop("_position")


@dataclass(frozen=True)
class NameStyle:
    """How the n-th use of a name is written and read back.

    ``pattern`` has the parts of the base name as all groups but ``number_group``.
    """

    pattern: str
    number_group: int
    base_groups: tuple[int, ...]
    number_shift: int

    def base_of(self, name: Column) -> Column:
        return F.concat(*(F.regexp_extract(name, self.pattern, g) for g in self.base_groups))

    def number_of(self, name: Column) -> Column:
        """Number a name carries; null if it carries none."""
        text = F.regexp_extract(name, self.pattern, self.number_group)
        return F.nullif(text, F.lit("")).cast("long") - self.number_shift

    def write(self, name: Column, number: Column) -> Column:
        raise NotImplementedError


class NoteNames(NameStyle):
    """``name``, ``name (2)``, ``name (3)``…"""

    def __init__(self):
        super().__init__(r"(?s)^(.*) \(([2-9]|[1-9]\d{1,17})\)$", 2, (1,), 1)

    def write(self, name, number):
        suffix = F.concat(F.lit(" ("), (number + 1).cast("string"), F.lit(")"))
        return F.when(number == 0, name).otherwise(F.concat(name, suffix))


class AssetNames(NameStyle):
    """``stem.ext``, ``stem_1.ext``, ``stem_2.ext``…"""

    def __init__(self):
        super().__init__(r"(?s)^(.+)_([1-9]\d{0,17})(\.[^.]+)$", 2, (1, 3), 0)

    def write(self, name, number):
        numbered_name = F.concat(
            F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1),
            F.lit("_"),
            number.cast("string"),
            F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 2),
        )
        return F.when(number == 0, name).otherwise(numbered_name)


def assign_names(
    rows: DataFrame,
    taken: DataFrame,
    scope: str,
    name: str,
    order: list[str],
    style: NameStyle,
    out: str,
) -> DataFrame:
    """Give each row, in order, the first free numbered form of its name.

    A number is free within (scope, name) if no taken name and no name wanted by
    another row has that form, so all assigned names differ. The r-th free number
    is r plus the count of reserved numbers t, each with i reserved ones below it,
    for which t - i <= r; that count is a running total over rows and reserved
    numbers together. Of the taken names only those that are, or number, a wanted
    name take part, and these are found before any shuffle of the taken ones
    where the wanted names are few.
    """
    keys = [scope, name]
    wanted = rows.select(*keys).distinct()
    numbered_form = F.struct(style.base_of(F.col(name)).alias("base"), style.number_of(F.col(name)).alias("_number"))
    itself = F.struct(F.col(name).alias("base"), F.lit(0).cast("long").alias("_number"))
    forms = union_all(
        [
            taken.select(scope, F.explode(F.array(itself, numbered_form)).alias("_form")),
            wanted.select(scope, numbered_form.alias("_form")),
        ]
    ).select(scope, F.col("_form.base").alias(name), F.col("_form._number").alias("_number"))
    reserved = forms.filter(F.col("_number").isNotNull()).join(wanted, keys, "left_semi").distinct()

    ranked = numbered(rows, keys, order, "_rank")
    jumps = (
        numbered(reserved, keys, ["_number"], "_below")
        .withColumn("_at", F.col("_number") - (F.col("_below") - 1))
        .groupBy(*keys, "_at")
        .agg(F.count("*").alias("_jump"))
        .withColumn("_is_row", F.lit(0))
    )
    placed = ranked.withColumns(
        {"_at": F.col("_rank") - 1, "_is_row": F.lit(1), "_jump": F.lit(0).cast("long")}
    ).unionByName(jumps, allowMissingColumns=True)
    # At one place a jump counts before a row.
    placed = placed.withColumn("_place", 2 * F.col("_at") + F.col("_is_row"))
    shifted = running_total(placed, keys, ["_place"], "_jumped", F.col("_jump"))
    return (
        shifted.filter(F.col("_is_row") == 1)
        .withColumn(out, style.write(F.col(name), F.col("_at") + F.col("_jumped")))
        .drop("_rank", "_at", "_is_row", "_jump", "_place", "_jumped")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
