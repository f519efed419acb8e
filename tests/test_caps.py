"""The cap over feeds with shared keys, against one feed after the other."""

import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators import stubs
from feedlake.operators.ranking import sequence_of
from feedlake.plans import caps

SCHEMA = "feed_ord long, entry_ord long, vault_folder string, url_key string, route string"


def one_feed_after_the_other(rows, cap):
    written, taken = set(), set()
    for feed in sorted({row[0] for row in rows}):
        free = [row for row in sorted(r for r in rows if r[0] == feed) if (row[2], row[3]) not in written]
        written |= {(row[2], row[3]) for row in free[:cap] if row[4] == stubs.NOTE and row[3] is not None}
        taken |= {row[:2] for row in free[:cap]}
    return taken


def found_by(spark, rows, cap, width):
    table = spark.createDataFrame(rows, SCHEMA)
    table = table.withColumn("seq", sequence_of(F.col("feed_ord"), F.col("entry_ord")))
    done = caps.capped(table, cap, width)
    assert done.columns == table.columns
    taken = [(r.feed_ord, r.entry_ord) for r in done.collect()]
    assert len(taken) == len(set(taken))
    return set(taken)


def test_a_chain_of_a_thousand_feeds_settles_in_two_rounds(spark, monkeypatch):
    # What a feed takes decides what the next one takes, all along the chain.
    rows = [(0, 0, "f", "k1", stubs.NOTE)]
    rows += [(i, e, "f", f"k{i + e}", stubs.NOTE) for i in range(1, 1000) for e in range(2)]
    rounds = []
    kept = caps.state_dir
    monkeypatch.setattr(caps, "state_dir", lambda s, purpose: rounds.append(purpose) or kept(s, purpose))
    assert found_by(spark, rows, 1, caps.BLOCK_ROWS) == one_feed_after_the_other(rows, 1)
    assert rounds.count("sync-capped") == 2


@pytest.mark.parametrize("cap, width", [(2, 7), (3, 1)])
def test_blocks_and_large_feeds_agree_with_the_plain_loop(spark, cap, width):
    rng = random.Random(cap)
    rows = []
    for feed in range(12):
        folder = ["a", "b", None][feed % 3] if feed % 5 == 4 else "ab"[feed % 2]
        for entry in range(30 if feed == 6 else rng.randint(1, 6)):
            key = None if rng.random() < 0.05 else f"k{rng.randint(0, 9)}"
            rows.append((feed, entry, folder, key, stubs.NOTE if rng.random() < 0.8 else "stub"))
    plain = [row if row[2] is not None else (*row[:2], f"none {row[0]}", *row[3:]) for row in rows]
    assert found_by(spark, rows, cap, width) == one_feed_after_the_other(plain, cap)


def test_no_rows_and_one_row(spark):
    assert found_by(spark, [], 3, 5) == set()
    assert found_by(spark, [(1, 0, "a", "k", stubs.NOTE)], 3, 5) == {(1, 0)}
