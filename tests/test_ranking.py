"""Numbering and naming, against sequential models, with wide and with narrow digits."""

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators import ranking


@pytest.fixture(params=[20, 1], ids=["wide", "narrow"])
def digit_bits(request, monkeypatch):
    """With 2 values a digit even small keys have many digits on every level."""
    monkeypatch.setattr(ranking, "DIGIT_BITS", request.param)
    return request.param


def test_running_total_with_a_hot_key(spark, digit_bits):
    rng = random.Random(1)
    data = [("hot" if n % 3 else f"k{n % 7}", n * 5, rng.randrange(9)) for n in range(200)]
    rows = spark.createDataFrame(data, "k string, seq long, v long")
    found = ranking.running_total(rows, ["k"], ["seq"], "t", F.col("v")).collect()
    sums, expected = {}, {}
    for key, seq, v in data:
        sums[key] = expected[seq] = sums.get(key, 0) + v
    assert {r.seq: r.t for r in found} == expected


@pytest.mark.parametrize("n", [0, 2, 5, 2000])
def test_first_n(spark, n):
    data = [("hot" if x % 3 else f"k{x}", x) for x in range(60)]
    rows = spark.createDataFrame(data, "k string, seq long")
    seen, expected = {}, set()
    for key, seq in data:
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= n:
            expected.add(seq)
    assert {r.seq for r in ranking.first_n(rows, ["k"], ["seq"], n).collect()} == expected


def sequential(rows, taken, write):
    """First free form of each name in order; names wanted by others are not free."""
    wanted = {(scope, name) for _, scope, name in rows}
    used, out = set(taken), {}
    for seq, scope, name in rows:
        number = 0
        while True:
            form = write(name, number)
            free = (scope, form) not in used and (number == 0 or (scope, form) not in wanted)
            if free:
                break
            number += 1
        used.add((scope, form))
        out[seq] = form
    return out


def note_form(name, number):
    return name if number == 0 else f"{name} ({number + 1})"


def asset_form(name, number):
    stem, _, suffix = name.rpartition(".")
    return name if number == 0 else f"{stem}_{number}.{suffix}"


@pytest.mark.parametrize(
    "style, form, names",
    [
        (ranking.NoteNames(), note_form, ["A", "A (2)", "A (3)", "A (1)", "A (02)", "A (2) (2)", "B"]),
        (ranking.AssetNames(), asset_form, ["a.png", "a_1.png", "a_2.png", "a_01.png", "a_1_1.png", "b.x.png", "b.x_1.png"]),
    ],
    ids=["notes", "assets"],
)
def test_names_are_the_first_free_ones(spark, digit_bits, style, form, names):
    rng = random.Random(7)
    rows = [(seq, rng.choice("xy"), names[0] if seq % 3 == 0 else rng.choice(names)) for seq in range(40)]
    taken = [("x", names[1]), ("x", names[0]), ("y", names[2]), ("z", names[0]), ("x", "other")]
    found = ranking.assign_names(
        spark.createDataFrame(rows, "seq long, scope string, name string"),
        spark.createDataFrame(taken, "scope string, name string"),
        "scope", "name", ["seq"], style, "given",
    ).collect()
    assert {r.seq: r.given for r in found} == sequential(rows, taken, form)
    given = [(r.scope, r.given) for r in found]
    assert len(set(given)) == len(given) and not set(given) & set(taken)


def test_two_and_three_equal_names(spark):
    rows = spark.createDataFrame([(n, "f", "T") for n in range(3)], "seq long, scope string, name string")
    none = spark.createDataFrame([], "scope string, name string")
    named = ranking.assign_names(rows, none, "scope", "name", ["seq"], ranking.NoteNames(), "given")
    assert [r.given for r in named.orderBy("seq").collect()] == ["T", "T (2)", "T (3)"]


def test_feeds_and_positions_of_any_number(spark, digit_bits):
    feeds = [0, 3, (1 << 23) - 1, 1 << 23, (1 << 24) - 1, 1 << 24, (1 << 41) + 5]
    data = [("k", feed, at) for feed in feeds for at in (0, 1, 1 << 21, 1 << 41)]
    rows = spark.createDataFrame(data, "k string, feed_ord long, entry_ord long")
    rows = rows.withColumn("seq", ranking.sequence_of(F.col("feed_ord"), F.col("entry_ord")))
    found = ranking.numbered(rows.repartition(3, "entry_ord"), ["k"], ["seq"], "n").collect()
    assert sorted((r.n, r.feed_ord, r.entry_ord) for r in found) == [(n + 1, *row[1:]) for n, row in enumerate(data)]


def test_a_million_feeds_of_one_entry_share_a_key(spark):
    rows = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 37).alias("feed_ord"), F.lit(0).alias("at"))
    rows = rows.withColumn("seq", ranking.sequence_of(F.col("feed_ord"), F.col("at")))
    found = ranking.numbered(rows, ["k"], ["seq"], "n")
    wrong = found.filter(F.col("n") != F.col("feed_ord") / 37 + 1)
    assert found.count() == 1_000_000 and wrong.isEmpty()
