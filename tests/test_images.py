import hashlib

import pytest
from pyspark.sql import functions as F

from feedlake.functions import images as f
from feedlake.operators import images as ops

REFS = 'a [![alt](http://x/i.png "t")](http://x/full) b ![p](http://x/j.png) c'


def test_references(spark):
    rows = spark.range(1).select(f.image_refs(F.lit(REFS)).alias("refs")).first()["refs"]
    assert [(r.ord, r.alt_text, r.image_url, r.is_clickable) for r in rows] == [
        (0, "alt", "http://x/i.png", True),
        (1, "p", "http://x/j.png", False),
    ]


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://i0.wp.com/h/wp-content/uploads/2025/04/image.png?resize=832%2C326&ssl=1", "image.png"),
        ("https://h.example", "image_" + hashlib.md5(b"https://h.example").hexdigest()[:10] + ".png"),
        ("https://h.example/a/b/", "b.png"),
        ("https://h.example/a%20b/c+d%zz.JPG;v=1?q", "c+d%zz.JPG"),
        ("https://h.example/x%2Fy.gif#f?g", "y.gif"),
        ("https://h.example/a;b/c.webp", "c.webp"),
        ("https://h.example/.png", ".png.png"),
        ("https://h.example/./", "image_" + hashlib.md5(b"https://h.example/./").hexdigest()[:10] + ".png"),
        ("https://h.example/" + "n" * 300 + ".jpg", "n" * 190 + ".jpg"),
        ("https://h.example/" + "é" * 150 + ".jpeg", "é" * 90 + ".jpeg"),
    ],
)
def test_file_name(value, url, name):
    assert value(f.image_file_name, url) == name


def test_paths(value):
    assert value(f.markdown_path, "a b/c.png") == "<a b/c.png>"
    assert value(f.markdown_path, "a(b).png") == "<a(b).png>"
    assert value(f.markdown_path, "a/c.png") == "a/c.png"
    assert value(f.relative_path, "v/x/a.png", "v") == "x/a.png"
    assert value(f.relative_path, "w/x/a.png", "v") == "w/x/a.png"


@pytest.mark.parametrize(
    "ok, stated, actual, accepted",
    [
        (True, None, 5, True),
        (True, f.MAX_IMAGE_BYTES, f.MAX_IMAGE_BYTES, True),
        (True, f.MAX_IMAGE_BYTES + 1, 5, False),
        (True, None, f.MAX_IMAGE_BYTES + 1, False),
        (True, None, 0, False),
        (False, None, 5, False),
        (None, None, None, False),
    ],
)
def test_acceptance(spark, ok, stated, actual, accepted):
    rows = spark.createDataFrame([(ok, stated, actual)], "ok boolean, c long, n long")
    assert rows.select(f.acceptable_image(F.col("ok"), F.col("c"), F.col("n")).alias("v")).first()["v"] is accepted


@pytest.mark.parametrize("markdown", ["", "no image", "![a](u)", "![a](u)![b](v) x ![c](w)"])
def test_replacing_with_themselves_changes_nothing(spark, markdown):
    same = F.transform(f.image_refs(F.lit(markdown)), lambda r: r["full_match"])
    assert spark.range(1).select(f.replace_images(F.lit(markdown), same).alias("v")).first()["v"] == markdown


def test_localize(spark):
    notes = spark.createDataFrame(
        [
            (1, "S", "v", "T (1)", f"{REFS} ![d](data:x) ![l](local.png) ![p2](http://x/j.png) ![q](http://y/j.png)"),
            (2, "S", "v", "T (1)", "![other](http://z/j.png)"),
            (3, "other", "v", "U", REFS),
        ],
        "note_id long, source string, vault_folder string, safe_name string, note_text string",
    )
    config = spark.createDataFrame([("S", "v", "assets")], "source string, vault_folder string, assets_subfolder string")
    fetched = spark.createDataFrame(
        [("http://x/i.png", False, None, 1), ("http://x/j.png", True, None, 1),
         ("http://y/j.png", True, None, 1), ("http://z/j.png", True, 1, 1)],
        "image_url string, ok boolean, content_length long, n_bytes long",
    )
    stored = spark.createDataFrame([("v/assets/T (1)", "j_1.png")], "assets_dir string, file_name string")
    out = ops.localize_images(notes, config, fetched, stored)
    texts = {r.note_id: r.note_text for r in out["notes"].collect()}
    assert texts[1] == (
        'a [![alt](http://x/i.png "t")](http://x/full) b ![p](<assets/T (1)/j.png>) c ![d](data:x) ![l](local.png)'
        " ![p2](<assets/T (1)/j.png>) ![q](<assets/T (1)/j_2.png>)"
    )
    assert texts[2] == "![other](<assets/T (1)/j_3.png>)"
    assert texts[3] == REFS
    counts = {r.note_id: (r.n_found, r.n_clickable, r.n_remote, r.n_images, r.n_localised) for r in out["counts"].collect()}
    assert counts[1] == (6, 1, 4, 3, 2) and counts[3] == (2, 1, 2, 2, 0)
