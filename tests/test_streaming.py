from datetime import datetime, timedelta



from feedlake.operators import dedup
from feedlake.streaming import discover, stubs

START = datetime(2026, 1, 1)
ENTRY = "link string, feed_ord long, entry_ord long, seen_at timestamp"
EVENT = "url_key string, kind string, ts timestamp, event_id long, body_chars long"


def land(spark, rows, schema, path, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/batch{number}")


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_discovery_over_several_batches(spark, tmp_path):
    landed, found, state = (str(tmp_path / name) for name in ("landed", "found", "state"))
    batches = [
        [("http://a", 1, 0, START), ("HTTP://A", 0, 5, START), ("http://b", 0, 1, START)],
        [("http://B", 0, 0, START), ("http://c", 0, 0, START), ("", 0, 1, START)],
        [("http://c", 0, 0, START), ("http://a", 0, 0, START)],
    ]
    for number, rows in enumerate(batches):
        land(spark, rows, ENTRY, landed, number)
        discover.discover_stream(source(spark, ENTRY, landed), found, state).awaitTermination()
    rows = discover.discovered(spark, found).collect()
    assert {(r.url, r.batch_id) for r in rows} == {("HTTP://A", 0), ("http://b", 0), ("http://c", 1)}
    everything = spark.createDataFrame(sum(batches, []), ENTRY)
    none = spark.createDataFrame([], "url string")
    once = dedup.discover_new(everything, none, ["feed_ord", "entry_ord"])
    assert {r.url_key for r in rows} == {r.link.lower() for r in once.collect()}


def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path):
    landed, found = str(tmp_path / "landed"), str(tmp_path / "found")
    land(spark, [("http://a", 0, 0, START)], ENTRY, landed, 0)
    for state in ("one", "two"):
        # A fresh checkpoint runs batch 0 again, as after a failure before its commit.
        discover.discover_stream(source(spark, ENTRY, landed), found, str(tmp_path / state)).awaitTermination()
    assert discover.discovered(spark, found).count() == 1


def test_urls_are_new_again_after_retention(spark, tmp_path):
    landed = str(tmp_path / "landed")
    days = [0, 1, 40, 41]
    for number, day in enumerate(days):
        land(spark, [("http://a", 0, 0, START + timedelta(days=day))], ENTRY, landed, number)
        stream = discover.within_retention(source(spark, ENTRY, landed), "10 days")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    seen = [r.seen_at for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seen_at").collect()]
    # The run that lets the old state go still knows it; the next one finds the URL anew.
    assert seen == [START, START + timedelta(days=41)]


def test_stub_stream_equals_batch(spark, tmp_path):
    landed, changes, state = (str(tmp_path / name) for name in ("landed", "changes", "state"))
    at = lambda n: START + timedelta(hours=n)
    batches = [
        [("u", "seen", at(1), 1, 100), ("u", "seen", at(2), 2, 110), ("v", "seen", at(2), 3, 50)],
        [("u", "seen", at(5), 4, 90), ("w", "captured", at(5), 5, 0)],
        [("v", "captured", at(6), 6, 0)],
        [("v", "seen", at(7), 7, 60), ("w", "seen", at(7), 8, 60), ("x", "seen", at(7), 9, 1)],
    ]
    for number, rows in enumerate(batches):
        land(spark, rows, EVENT, landed, number)
        stubs.stub_stream(source(spark, EVENT, landed), changes, state).awaitTermination()
        so_far = spark.createDataFrame(sum(batches[: number + 1], []), EVENT)
        batch = stubs.open_stubs(stubs.stub_state(so_far)).collect()
        stream = stubs.open_stubs(stubs.current_state(spark, changes)).collect()
        assert set(stream) == set(batch)
    rows = {r.url_key: (r.first_seen, r.last_seen, r.body_chars) for r in stream}
    assert rows == {"u": (at(1), at(5), 90), "x": (at(7), at(7), 1)}


def test_stream_needs_no_python_state(spark, tmp_path):
    landed = str(tmp_path / "landed")
    land(spark, [("u", "seen", START, 1, 100)], EVENT, landed, 0)
    state = stubs.stub_state(source(spark, EVENT, landed))
    assert state.isStreaming and "Pandas" not in state._jdf.queryExecution().toString()
