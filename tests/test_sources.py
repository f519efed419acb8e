import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedlake import schemas
from feedlake.operators import reports
from feedlake.sources import feeds, notes, snapshots

CONFIG = {
    "feeds": [
        {"name": "a", "source": "A", "rss_url": "u", "vault_folder": "x/y"},
        {"name": "b", "source": "B", "parser": "khoros", "rss_url": "v", "vault_folder": "z"},
    ]
}


def test_config(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    rows = feeds.read_config(spark, str(path), "/root/").collect()
    assert [(r.feed_ord, r.parser, r.vault_folder, r.keep_synced_days) for r in rows] == [
        (0, "wordpress", "/root/x/y", 90),
        (1, "khoros", "/root/z", 90),
    ]
    path.write_text(json.dumps({**CONFIG, "settings": {"keep_synced_days": 0}}))
    assert feeds.read_config(spark, str(path)).first().keep_synced_days == 0


def test_config_defaults(spark, tmp_path):
    defaults = spark.createDataFrame([], schemas.FEEDS)
    assert feeds.read_config(spark, str(tmp_path / "none.json"), defaults=defaults) is defaults


RSS = """<?xml version="1.0"?><rss xmlns:dc="d"><channel><title>f</title>
<item><title>One &amp; &lt;two&gt;</title><link>http://a?x=1&amp;y=2</link><dc:creator>W</dc:creator>
<pubDate>Fri, 20 Mar 2026 12:00:00 GMT</pubDate><description><![CDATA[<p>s</p>]]></description>
<content:encoded><![CDATA[<b>full</b>]]></content:encoded></item>
<item><title>No link</title><guid isPermaLink="true">http://guid</guid><author>x@y (Z)</author></item>
<item><title>Bad &nope; entity</title><link>http://bad</link></item>
<item><title>Last</title><link>http://c</link><guid isPermaLink="false">17</guid></item>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T</title>
<link rel="self" href="http://self"/><link rel="alternate" href="http://page"/>
<author><name>N1</name></author><author><name>N2</name></author>
<published>2026-03-20T12:00:00Z</published><content type="html">&lt;p&gt;c&lt;/p&gt;</content></entry></feed>"""


def test_feed_files(spark, tmp_path):
    # The first file breaks off and has a bare ampersand; its items still count.
    (tmp_path / "0.xml").write_text(RSS)
    (tmp_path / "1.xml").write_text(ATOM)
    (tmp_path / "2.xml").write_text("<rss><channel>")
    config = spark.createDataFrame(
        [(n, "n", f"S{n}", "default", "u", "f", 90) for n in range(3)], schemas.FEEDS
    )
    rows = feeds.read_feed_files(spark, str(tmp_path), config).orderBy("feed_ord", "entry_ord").collect()
    assert [(r.source, r.link) for r in rows] == [
        ("S0", "http://a?x=1&y=2"), ("S0", "http://guid"), ("S0", "http://bad"), ("S0", "http://c"),
        ("S1", "http://page"),
    ]
    assert rows[2].title == "Bad &nope; entity"
    first, atom = rows[0], rows[-1]
    assert (first.title, first.author, first.summary) == ("One & <two>", "W", "<p>s</p>")
    assert first.content[0].value == "<b>full</b>" and first.published_parsed == datetime(2026, 3, 20, 12)
    assert [a.name for a in atom.authors] == ["N1", "N2"] and atom.author == "N1"
    assert atom.content[0].value == "<p>c</p>" and atom.title == "T"
    files = spark.createDataFrame([(0, RSS), (1, "<rss><channel>")], "n long, xml string")
    assert [tuple(r) for r in feeds.healthy_feeds(files, "xml", ["n"]).collect()] == [(0, 4)]


def test_marked_sections_are_units(spark):
    section = "<![CDATA[<p>a & b</p></item> <item>" + "x<y " * 50_000 + ".]]>"
    items = [
        f"<item><title>A & B</title><link>http://a</link><description>{section}</description></item>",
        "<item><!-- </item> --><title><![CDATA[C & D]]></title><link>http://b?c&d</link></item>",
        "<item><title>open <![CDATA[ & never closed</title><link>http://c</link></item>",
    ]
    files = spark.createDataFrame([(0, "<rss><channel>" + "".join(items[:2])), (1, items[2]), (2, "<item><b></item>")], "n long, xml string")
    rows = feeds.parse_feed_files(files, "xml", ["n"]).collect()
    found = {(r.n, r.entry_ord): (r.title, r.link, len(r.summary or "")) for r in rows}
    assert found[0, 0] == ("A & B", "http://a", len(section) - 12)
    assert found[0, 1] == ("C & D", "http://b?c&d", 0)
    health = {r.n: r.n_items for r in feeds.healthy_feeds(files, "xml", ["n"]).collect()}
    read = {n: sum(1 for r in rows if r.n == n and r.link) for n in (0, 1, 2)}
    assert health[0] == read[0] == 2 and health.get(2, 0) == 0


TOLERATED = [
    "<rss><channel><!-- <item><link>http://no</link></item> --><item><title>A</title><link>http://a</link></item></channel></rss>",
    "<rss><channel><item><link>http://b</link><description>plain <b>bold</b><br> &amp; <![CDATA[x<i>y]]></description></item></channel></rss>",
    "<rss><channel><item><link>http://c</link></item><item><title>D</title><link>http://d</link><description>cut of",
    "<feed><entry><link href='http://e'/><content type='xhtml'><div><p>one &amp; two</p></div></content></entry></feed>",
    "<rss><channel><item><category><link>http://f</link></item><item><link>http://g</link></channel></rss>",
    "<item><link>http://h</link><item><title>I <!-- x -->J</title><link>http://i</link><description><![CDATA[<!-- kept -->]]></description>",
    "<item><b></item>",
    "<item/><entry>",
]


def test_items_that_are_no_xml_are_read_as_far_as_they_go(spark):
    files = spark.createDataFrame(list(enumerate(TOLERATED)), "n long, xml string")
    rows = feeds.parse_feed_files(files, "xml", ["n"]).collect()
    found = {(r.n, r.entry_ord): (r.link, r.title, r.summary or (r.content and r.content[0].value)) for r in rows}
    assert found == {
        (0, 0): ("http://a", "A", None),
        (1, 0): ("http://b", None, "plain <b>bold</b><br> &amp; x<i>y"),
        (2, 0): ("http://c", None, None),
        (2, 1): ("http://d", "D", None),
        (3, 0): ("http://e", None, "<div><p>one &amp; two</p></div>"),
        (4, 0): ("http://f", None, None),
        (4, 1): ("http://g", None, None),
        (5, 0): ("http://h", None, None),
        (5, 1): ("http://i", "I J", "<!-- kept -->"),
    }
    health = {r.n: r.n_items for r in feeds.healthy_feeds(files, "xml", ["n"]).collect()}
    assert health == {0: 1, 1: 1, 2: 2, 3: 1, 4: 2, 5: 2}


def test_queue_snapshots(spark, tmp_path):
    path = str(tmp_path / "queue-1")
    assert snapshots.read_snapshot(spark, path, schemas.QUEUE).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, schemas.QUEUE, required=True)
    row = (0, "u", "ü", None, "", "S", None, datetime(2026, 1, 1), "pending", None)
    queue = spark.createDataFrame([row], schemas.QUEUE)
    snapshots.write_snapshot(queue, path)
    assert snapshots.read_snapshot(spark, path, schemas.QUEUE).collect() == queue.collect()
    with pytest.raises(Exception, match="(?i)already exists"):
        snapshots.write_snapshot(queue, path)


def test_json_queue(spark, tmp_path):
    record = {"url": "u", "title": "t", "feed": "S", "discovered": "2026-05-05T16:12:18+00:00", "status": "pending"}
    path = tmp_path / "queue.json"
    path.write_text(json.dumps({"articles": [record, {**record, "url": "v", "synced_at": "2026-05-06T00:00:00+02:00"}]}))
    rows = snapshots.read_json_queue(spark, str(path)).collect()
    assert [(r.queue_ord, r.url, r.parser) for r in rows] == [(0, "u", None), (1, "v", None)]
    assert rows[0].synced_at is None and rows[1].synced_at == datetime(2026, 5, 5, 22)


def test_json_manifest(spark, tmp_path):
    path = tmp_path / "stubs.json"
    assert snapshots.read_json_manifest(spark, str(path)).count() == 0
    path.write_text("{ not json")
    assert snapshots.read_json_manifest(spark, str(path)).count() == 0
    stub = {"url": "HTTP://U/", "title": "old", "body_chars": 5, "first_seen": "2026-01-01T00:00:00+00:00"}
    path.write_text(json.dumps({"count": 3, "stubs": [stub, {"title": "no url"}, {**stub, "url": "http://u", "title": "new"}]}))
    rows = snapshots.read_json_manifest(spark, str(path)).collect()
    assert [(r.url_key, r.title, r.body_chars) for r in rows] == [("http://u", "new", 5)]


@pytest.mark.parametrize("n", [0, 3, 500])
def test_manifest_round_trip_oldest_first(spark, tmp_path, n):
    at = [None, *(datetime(2026, 1, 1 + m % 28, m % 24) for m in range(n))][:n]
    rows = [(f"k{m}", f"K{m}/", "t", "S", "p", "", "f", m, time, time) for m, time in enumerate(at)]
    manifest = spark.createDataFrame(rows, schemas.MANIFEST).repartition(3)
    path = str(tmp_path / "manifest")
    snapshots.write_json_manifest(manifest, path, "2026-03-20 12:00:00")
    texts = [file.read_text() for file in sorted((tmp_path / "manifest").glob("part-*"))]
    documents = [json.loads(found) for found in texts if found]
    assert {(d["generated"][:19], d["count"]) for d in documents} <= {("2026-03-20T12:00:00", n)}
    times = [stub.get("first_seen", "") for d in documents for stub in d["stubs"]]
    assert len(times) == n and times == sorted(times)
    assert sorted(snapshots.read_json_manifest(spark, path).collect()) == sorted(manifest.collect())


def test_note_files(spark, tmp_path):
    folder = tmp_path / "a b" / "c+d"
    folder.mkdir(parents=True)
    (folder / "N é 1.md").write_text("---\nlink: HTTP://U/1/\n---\nx")
    (folder / "skip.txt").write_text("---\nlink: http://no\n---\n")
    (tmp_path / "top.md").write_bytes(b"---\nlink: http://top\n---\n\xff")
    rows = notes.read_note_files(spark, str(tmp_path))
    assert {(r.vault_folder, r.note_name) for r in rows.collect()} == {("a b/c+d", "N é 1"), ("", "top")}
    assert {(r.vault_folder, r.url_key) for r in notes.note_keys(rows).collect()} == {
        ("a b/c+d", "http://u/1"),
        ("", "http://top"),
    }
    assert notes.read_note_files(spark, str(tmp_path / "absent")).count() == 0


def test_note_table(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert notes.read_notes(spark, path).count() == 0
    values = {"vault_folder": "f/g", "url_key": "u", "note_name": "n", "tags": ["a"], "note_text": "t"}
    row = tuple(values.get(name) for name in schemas.NOTE.names)
    table = spark.createDataFrame([row], schemas.NOTE)
    for run in ("2026-01-01", "2026-01-02", "2026-01-02"):
        notes.write_notes(table, path, run)
    assert [(r.vault_folder, r.tags) for r in notes.read_notes(spark, path).collect()] == [("f/g", ["a"])] * 2
    assert notes.read_notes(spark, path, repeating="2026-01-02").collect() == table.collect()


def test_asset_manifest(spark, tmp_path):
    path = str(tmp_path / "assets")
    notes.write_assets(spark.createDataFrame([("d", "a.png")], "assets_dir string, asset_name string"), path)
    assert [tuple(r) for r in snapshots.read_snapshot(spark, path, schemas.ASSET_MANIFEST).collect()] == [("d", "a.png")]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    counted = spark.createDataFrame([(0, "A", 2), (1, "B", 0)], "feed_ord long, name string, new_count long")
    new = spark.createDataFrame([(0, 2, "f/two"), (0, 1, "f/one")], "feed_ord long, entry_ord long, rel_path string")
    for run, news in (("1", new), ("2", new.filter("false"))):
        count = counted if run == "1" else counted.withColumn("new_count", F.lit(0).cast("long"))
        notes.write_run_log(reports.log_lines(count, news, datetime(2026, 3, 20, 12), "manual"), path, run)
    read = lambda name: "".join(
        file.read_text() for file in sorted((tmp_path / "log" / name).glob("part-*"))
    )
    assert read("0-head").startswith("# Sync Log\n\nThis log")
    assert read("run-1") == (
        "\n## 2026-03-20T12:00:00+00:00\n\n- Feed: A — 2 new articles\n- Feed: B — 0 new articles\n"
        "- New articles:\n  - [[f/one]]\n  - [[f/two]]\n- Trigger: manual\n"
    )
    assert "New articles" not in read("run-2")
