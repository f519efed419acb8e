"""Hand-made pages for the three parsers and for the conversion to Markdown."""

import pytest
from pyspark.sql import functions as F

from feedlake.functions import html
from feedlake.operators import articles

KHOROS = """<html><body><nav>n</nav>
<div class="LabelsForArticle"><a class="label-link x"> One </a><a>no</a><a class="label-link">Two</a></div>
<div id="bodyDisplay" class="lia-message-body lia"><div>in<div class="deep">er</div></div>
<div class="Share-bar">no</div><img src="//cdn/x.png"></div></body></html>"""


def read(parser, page):
    body, tags = parser(page)
    return None if body is None else str(body), tags


def test_khoros():
    body, tags = read(html.extract_khoros, KHOROS)
    assert tags == ["One", "Two"]
    assert "no" not in body and 'src="https://cdn/x.png"' in body
    assert html.to_markdown(body).split() == ["in", "er", "![](https://cdn/x.png)"]


def test_khoros_without_body_keeps_tags():
    assert read(html.extract_khoros, KHOROS.replace("lia-message-body", "other")) == (None, ["One", "Two"])


def test_wordpress_container_and_junk():
    page = """<body><div class="entry-content">a<aside>no</aside><p class="x Related-posts">no</p>
    <script>no</script><ul><li><a href="/en-us/blog/category/t">T</a></li></ul></div><div>after</div></body>"""
    body, tags = read(html.extract_wordpress, page)
    assert tags == [] and "no" not in body and "after" not in body
    assert "- [T](/en-us/blog/category/t)" in html.to_markdown(body)


def test_article_comes_before_other_containers():
    page = '<div class="post-content">first</div><article>second</article>'
    assert read(html.extract_wordpress, page)[0] == "<article>second</article>"


@pytest.mark.parametrize(
    "page",
    ["<body>x<main>in</main></body>", '<body><div class="article-content">in</div><main>x</main></body>'],
)
def test_default_containers(page):
    assert ">in<" in read(html.extract_default, page)[0] and "x" not in read(html.extract_default, page)[0].replace("class=", "")


def test_wordpress_knows_no_main():
    assert read(html.extract_wordpress, "<body>x<main>in</main></body>")[0] == "<body>x<main>in</main></body>"


def test_bare_body_keeps_classes_but_no_header():
    page = '<body><header>h</header><nav>n</nav><div class="sidebar">stays</div></body>'
    assert read(html.extract_default, page)[0] == '<body><div class="sidebar">stays</div></body>'


def test_no_body():
    assert read(html.extract_default, "<p>loose</p>") == (None, [])


def test_a_body_converts_like_its_html():
    body, _ = html.extract_khoros(KHOROS)
    assert html.to_markdown(body) == html.to_markdown(str(body))


def test_unclosed_and_nested_elements():
    page = "<article><p>a<b>b<p>c</article>tail"
    assert read(html.extract_default, page)[0] == "<article><p>a<b>b<p>c</p></b></p></article>"
    nested = '<div class="post-content"><div>a</div>b</div>c'
    assert read(html.extract_wordpress, nested)[0] == '<div class="post-content"><div>a</div>b</div>'


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<h2>T <em>x</em></h2><p>a</p>", "## T *x*\n\na"),
        ("<p>a <b>b </b>c</p>", "a **b** c"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "- a\n  - b\n- c"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ('<a href="/x" title="t">y</a>', '[y](/x "t")'),
        ('<img src="u" alt="a">', "![a](u)"),
        ("<pre>a\n  b*</pre>", "```\na\n  b*\n```"),
        ("<p>2 * 3_4</p>", "2 \\* 3\\_4"),
        ("<h1></h1><h1>R</h1>", "# R"),
        ("a<br>b", "a  \nb"),
        ("<blockquote>q<br>r</blockquote>", "> q  \n> r"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>",
         "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("", ""),
    ],
)
def test_markdown(spark, body, expected):
    rows = spark.createDataFrame([(body,)], "body string")
    assert rows.select(articles.markdown_of(F.col("body")).alias("md")).first()["md"] == expected


def test_registered_parser_is_used_for_feeds_that_name_it(spark):
    parsers = {**html.PARSERS, "shout": lambda page: (page.upper(), ["loud"])}
    pages = spark.createDataFrame(
        [("u1", "shout", "a"), ("u2", "unknown", "<article>b</article>"), ("u3", None, "<main>c</main>")],
        "url string, parser string, html string",
    )
    rows = {r.url: (r.body, r.tags) for r in articles.extract_articles(pages, parsers).collect()}
    assert rows == {"u1": ("A", ["loud"]), "u2": ("<article>b</article>", []), "u3": (None, [])}


def test_missing_page_gives_no_body(spark):
    wanted = spark.createDataFrame([("u", "khoros"), ("v", "khoros")], "url string, parser string")
    pages = spark.createDataFrame([("u", KHOROS), ("v", "<body></body>")], "url string, html string")
    rows = {r.url: r for r in articles.fetched_articles(wanted.union(wanted), pages).collect()}
    assert rows["u"].page_tags == ["One", "Two"] and rows["u"].page_md
    assert rows["v"].page_md is None
