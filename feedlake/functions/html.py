"""Per-row helper: choose the article element of a page and write it as Markdown.

HTML nesting (unclosed and same-name tags) cannot be told by a pattern, so this
part runs in Python, one page at a time, within Arrow batches that Spark has
partitioned. The page is read into a flat event list in which each element knows
where it ends; there is no tree and no recursion.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

START, END, TEXT = range(3)

# --- Fixed values: element names and class patterns that decide the results ------
JUNK_TAGS = frozenset({"nav", "aside", "footer", "script", "style", "noscript"})
JUNK_CLASSES = re.compile(
    r"(share|social|related|sidebar|comment|newsletter|author-bio)", re.IGNORECASE
)
POST_CLASSES = re.compile(r"(post|entry)[-_]content")
ARTICLE_CLASSES = re.compile(r"(post|entry|article)[-_]content")
MESSAGE_CLASS = "lia-message-body"
LABELS_CLASS = "LabelsForArticle"
LABEL_CLASSES = re.compile(r"label-link")
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
# ---------------------------------------------------------------------------------


class Page(HTMLParser):
    """Events of one page as ``[kind, name or text, attributes, end position]``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.events: list[list] = []
        self._open: list[int] = []
        self.feed(html)
        self.close()
        self._close_down_to(0)

    def handle_starttag(self, tag, attrs):
        fixed = {}
        for name, value in attrs:
            value = value or ""
            if name in ("src", "href") and value.startswith("//"):
                value = "https:" + value
            fixed[name] = value
        self.events.append([START, tag, fixed, len(self.events)])
        if tag not in VOID_TAGS:
            self._open.append(len(self.events) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.events[self._open[depth]][1] == tag:
                self._close_down_to(depth)
                return

    def handle_data(self, data):
        self.events.append([TEXT, data, None, 0])

    def _close_down_to(self, depth: int):
        while len(self._open) > depth:
            start = self.events[self._open.pop()]
            start[3] = len(self.events)
            self.events.append([END, start[1], None, 0])

    def find(self, tag: str, class_test: Callable[[str], object] | None = None) -> int | None:
        """Position of the first element of that name whose class passes, or None."""
        for at, (kind, name, attrs, _) in enumerate(self.events):
            if kind == START and name == tag:
                if class_test is None or class_test(attrs.get("class", "")):
                    return at
        return None

    def walk(self, at: int, junk_tags=frozenset(), junk_classes=None) -> Iterator[list]:
        """Events of one element, without the junk elements below it."""
        position, last = at, self.events[at][3]
        while position <= last:
            event = self.events[position]
            if event[0] == START and position > at:
                classes = event[2].get("class")
                if event[1] in junk_tags or (
                    junk_classes and classes and junk_classes.search(classes)
                ):
                    position = event[3] + 1
                    continue
            yield event
            position += 1

    def text(self, at: int) -> str:
        """Text of one element, each piece stripped."""
        return "".join(event[1].strip() for event in self.walk(at) if event[0] == TEXT)


def has_class(name: str) -> Callable[[str], bool]:
    return lambda classes: name in classes.split()


class Body:
    """One element of a page without its junk: HTML as text, or events to convert."""

    def __init__(self, page: Page, at: int, junk_tags=JUNK_TAGS, junk_classes=None):
        self._walk = lambda: page.walk(at, junk_tags, junk_classes)

    def events(self) -> Iterator[list]:
        return self._walk()

    def __str__(self) -> str:
        out = []
        for kind, name, attrs, _ in self._walk():
            if kind == TEXT:
                out.append(escape(name, quote=False))
            elif kind == END:
                out.append(f"</{name}>")
            else:
                pairs = "".join(f' {key}="{escape(value)}"' for key, value in attrs.items())
                out.append(f"<{name}{pairs}/>" if name in VOID_TAGS else f"<{name}{pairs}>")
        return "".join(out)


# A parser takes a page's HTML and gives its body and tags. Feeds choose one by name.
# The body is HTML as text, or a Body, which spares a second reading of the page.
Article = tuple[Body | str | None, list[str]]
Parser = Callable[[str], Article]


def container_or_body(page: Page, container: int | None) -> Body | None:
    """The cleaned container; without one, the cleaned body; without that, None."""
    if container is not None:
        return Body(page, container, junk_classes=JUNK_CLASSES)
    body = page.find("body")
    return None if body is None else Body(page, body, JUNK_TAGS | {"header"})


def first_found(*searches: Callable[[], int | None]) -> int | None:
    return next((at for at in (search() for search in searches) if at is not None), None)


def extract_wordpress(html: str) -> Article:
    page = Page(html)
    container = first_found(
        lambda: page.find("article"), lambda: page.find("div", POST_CLASSES.search)
    )
    return container_or_body(page, container), []


def extract_default(html: str) -> Article:
    page = Page(html)
    container = first_found(
        lambda: page.find("article"),
        lambda: page.find("div", ARTICLE_CLASSES.search),
        lambda: page.find("main"),
    )
    return container_or_body(page, container), []


def extract_khoros(html: str) -> Article:
    """Labels come from the whole page, so they remain when the body is missing."""
    page = Page(html)
    tags = []
    labels = page.find("div", has_class(LABELS_CLASS))
    if labels is not None:
        for at in range(labels, page.events[labels][3]):
            kind, name, attrs, _ = page.events[at]
            if kind == START and name == "a" and LABEL_CLASSES.search(attrs.get("class", "")):
                label = page.text(at)
                if label:
                    tags.append(label)
    body = page.find("div", has_class(MESSAGE_CLASS))
    return (None if body is None else container_or_body(page, body)), tags


PARSERS: dict[str, Parser] = {
    "wordpress": extract_wordpress,
    "khoros": extract_khoros,
    "default": extract_default,
}


HEADINGS = {f"h{level}": "#" * level for level in range(1, 7)}
INLINE_MARKS = {
    "b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~",
    "code": "`", "kbd": "`", "samp": "`",
}
PLAIN_TEXT_TAGS = frozenset({"pre", "code", "kbd", "samp"})
BLOCKS = frozenset({"p", "div", "article", "section", "main", "dl", "dt", "dd", "figure", "body"})
ONE_LINE = frozenset({*HEADINGS, "td", "th"})


def _around(text: str, before: str, after: str) -> str:
    """Marks around a text, with its outer blanks left outside of them."""
    inner = text.strip()
    if not inner:
        return ""
    lead = " " if text[0].isspace() else ""
    trail = " " if text[-1].isspace() else ""
    return f"{lead}{before}{inner}{after}{trail}"


def _link(text: str, attrs: dict) -> str:
    href, title = attrs.get("href", ""), attrs.get("title", "").replace('"', r"\"")
    if not href:
        return text
    if text.replace(r"\_", "_") == href and not title:
        return f"<{href}>"
    return _around(text, "[", f']({href} "{title}")' if title else f"]({href})")


def _image(attrs: dict, one_line: bool) -> str:
    alt, title = attrs.get("alt", ""), attrs.get("title", "").replace('"', r"\"")
    if one_line:
        return alt
    suffix = f' "{title}"' if title else ""
    return f"![{alt}]({attrs.get('src', '')}{suffix})"


def _item(text: str, mark: str) -> str:
    lines = text.strip().split("\n")
    pad = " " * len(mark)
    return mark + "\n".join([lines[0], *(pad + line if line else "" for line in lines[1:])]) + "\n"


def _row(text: str, attrs: dict) -> str:
    """A table row from cells, which were closed with a bar each."""
    row = f"| {text.strip()}\n"
    if attrs.get("first"):
        row += "|" + " --- |" * text.count(" |") + "\n"
    return row


def _element(name: str, text: str, attrs: dict, around: list[str]) -> str:
    """Markdown of one closed element."""
    one_line = not ONE_LINE.isdisjoint(around)
    if name in HEADINGS:
        line = " ".join(text.split())
        return f"\n\n{HEADINGS[name]} {line}\n\n"
    if name in INLINE_MARKS:
        if not PLAIN_TEXT_TAGS.isdisjoint(around):
            return text
        return _around(text, INLINE_MARKS[name], INLINE_MARKS[name])
    if name in BLOCKS:
        if one_line:
            return f" {text.strip()} "
        return f"\n\n{text.strip()}\n\n" if text.strip() else ""
    if name == "a":
        return _link(text, attrs)
    if name == "br":
        return " " if one_line else "  \n"
    if name == "img":
        return _image(attrs, one_line)
    if name == "hr":
        return "\n\n---\n\n"
    if name == "pre":
        return f"\n\n```\n{text}\n```\n\n" if text else ""
    if name == "blockquote":
        quoted = "\n".join(f"> {line}" if line else ">" for line in text.strip().split("\n"))
        return f"\n\n{quoted}\n\n" if text.strip() else ""
    if name == "li":
        return _item(text, f"{attrs['number']}. " if attrs.get("number") else "- ")
    if name in ("ul", "ol"):
        return f"\n{text.rstrip()}\n" if "li" in around else f"\n\n{text}\n"
    if name in ("td", "th"):
        return f" {' '.join(text.split())} |"
    if name == "tr":
        return _row(text, attrs)
    if name == "table":
        return f"\n\n{text.strip()}\n\n"
    if name in ("script", "style"):
        return ""
    return text


def _text(data: str, around: list[str], after_block: bool) -> str:
    if "pre" in around:
        return data
    data = re.sub(r"[ \t]+", " ", re.sub(r"[ \t\r\f]*\n\s*", "\n", data))
    if after_block:
        data = data.lstrip()
    if PLAIN_TEXT_TAGS.isdisjoint(around):
        data = data.replace("*", r"\*").replace("_", r"\_")
    return data


def to_markdown(html: str | Body) -> str:
    """Markdown with ATX headings and ``-`` bullets; images stay external."""
    events = html.events() if isinstance(html, Body) else Page(html).events
    outputs: list[list[str]] = [[]]
    names: list[str] = []
    details: list[dict] = []

    def put(piece: str):
        target = outputs[-1]
        if piece.startswith("\n") and target:
            target[-1] = target[-1].rstrip(" ")
        if piece:
            target.append(piece)

    for kind, name, attrs, _ in events:
        if kind == TEXT:
            before = outputs[-1][-1] if outputs[-1] else ("" if names else "\n")
            put(_text(name, names, before.endswith("\n")))
        elif kind == START and name in VOID_TAGS:
            put(_element(name, "", attrs, names))
        elif kind == START:
            attrs = dict(attrs)
            if name == "li" and names and names[-1] == "ol":
                attrs["number"] = details[-1]["items"] = details[-1].get("items", 0) + 1
            if name == "tr":
                table = next((d for n, d in zip(names[::-1], details[::-1]) if n == "table"), {})
                attrs["first"] = not table.get("rows")
                table["rows"] = True
            names.append(name)
            details.append(attrs)
            outputs.append([])
        else:
            text = "".join(outputs.pop())
            names.pop()
            put(_element(name, text, details.pop(), names))
    return "".join(outputs[0])
