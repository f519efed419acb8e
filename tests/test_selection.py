"""Distributed selection, the key index and the snapshot log."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feedlake.operators import queue as q, selection
from feedlake.sources import keyindex, versions

LONG = (1 << 63) - 1


def ords(rows):
    return sorted((r.queue_ord is not None, r.queue_ord or 0) for r in rows.collect())


def first(values, n):
    return sorted((v is not None, v or 0) for v in values)[:n]


@pytest.mark.parametrize("spread", [10, 1 << 20, 1 << 40, LONG])
def test_first_rows_equal_a_sort(spark, spread):
    random.seed(41)
    values = sorted({random.randrange(-spread, spread) for _ in range(19)})
    values += [None, -LONG, LONG] if spread == LONG else [None]
    rows = spark.createDataFrame([(v, "x") for v in values], "queue_ord long, t string").repartition(3)
    for n in (0, 1, 2, 7, len(values) - 1, len(values), 1000):
        assert ords(selection.first_rows(rows, "queue_ord", n)) == first(values, n)


def test_first_rows_with_ties_and_without_rows(spark):
    values = [1, 1, 1, 2, 2, None, None, 5]
    rows = spark.createDataFrame([(v,) for v in values], "queue_ord long")
    for n in range(len(values) + 1):
        assert ords(selection.first_rows(rows, "queue_ord", n)) == first(values, n)
    assert selection.first_rows(rows.filter("false"), "queue_ord", 3).count() == 0


def test_a_cap_of_millions_sorts_and_gathers_nothing(spark):
    queue = spark.range(3_000_000).select(
        ((F.col("id") * 7919) % 3_000_000).alias("queue_ord"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("parser")
    )
    taken = q.take_pending(queue, "wordpress", 2_000_000)
    plan = taken._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "SinglePartition" not in plan
    assert taken.agg(F.count("*"), F.max("queue_ord")).first()[:] == (2_000_000, 1_999_999)


def test_rows_asked_for_hold_all_that_match_and_few_others(spark):
    pages = spark.range(20_000).select(F.format_string("http://p/%d", "id").alias("url"), F.lit("html").alias("_bits"))
    asked = spark.range(0, 20_000, 100).select(F.format_string("http://p/%d", "id").alias("url"))
    found = selection.rows_asked_for(pages, asked.unionByName(spark.createDataFrame([(None,), ("http://none",)], "url string")), "url")
    assert found.columns == pages.columns
    assert found.join(asked, "url").count() == 200 and found.count() < 210
    assert selection.rows_asked_for(pages, asked.filter("false"), "url").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastHashJoin" in found._jdf.queryExecution().toString()


def test_key_index_reads_only_the_folders_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "keys")
    batch = spark.createDataFrame([("http://n/3",), ("http://n/3",), ("http://none",), (None,)], "url_key string")
    assert keyindex.stored_keys(batch, path).count() == 0
    notes = spark.range(2000).select(
        (F.col("id") % 3).cast("string").alias("vault_folder"), F.format_string("http://n/%d", "id").alias("url_key")
    )
    for run in ("1", "2", "2"):
        keyindex.write_keys(notes, path, run)
    found = keyindex.stored_keys(batch, path)
    assert [tuple(r) for r in found.collect()] == [("0", "http://n/3")]
    wanted = {r[0] for r in batch.select(keyindex.bucket_of()).collect()}
    plan = found._jdf.queryExecution().toString()
    pruned = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN|INSET) \(?([\d,]+)", plan)
    assert {int(n) for n in pruned.group(1).split(",")} == wanted
    assert keyindex.read_keys(spark, path).count() == 4000
    many = spark.range(1500).select(F.format_string("http://n/%d", F.col("id") * 2).alias("url_key"))
    assert keyindex.stored_keys(many, path).count() == 1000
    assert keyindex.stored_keys(batch, path, repeating="2").count() == 1
    assert keyindex.stored_keys(batch.filter("false"), path).count() == 0


def test_snapshot_log_ignores_what_was_not_committed(spark, tmp_path):
    path, schema = str(tmp_path / "queue"), spark.range(0).schema
    assert versions.read_version(spark, path, schema)[0] == 0
    one = versions.write_version(spark.range(3), path, 0)
    spark.range(99).write.parquet(f"{path}/data-unfinished")
    version, rows = versions.read_version(spark, path, schema)
    assert (one, version, rows.count()) == (1, 1, 3)
    two = versions.write_version(rows.unionByName(spark.range(2)), path, version)
    assert two == 2 and versions.read_version(spark, path, schema)[1].count() == 5
    assert versions.read_version(spark, path, schema, 1)[1].count() == 3
    assert {(r.version, r.n_rows) for r in versions.commits(spark, path).collect()} == {(1, 3), (2, 5)}
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, schema, 7)


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "queue"), spark.range(0).schema
    versions.write_version(spark.range(1), path, 0)
    with pytest.raises(versions.Conflict):
        versions.write_version(spark.range(9), path, 0)
    # Both have seen 1 as the latest; the first to commit takes 2.
    versions.write_version(spark.range(2), path, 1)
    monkeypatch.setattr(versions, "latest_version", lambda *_: 1)
    with pytest.raises(versions.Conflict):
        versions.write_version(spark.range(7), path, 1)
    monkeypatch.undo()
    assert versions.read_version(spark, path, schema)[1].count() == 2
