"""HTML functions that need a parser: one event loop over the standard library's tokenizer behind Arrow functions.

Void elements have no end, omitted end tags of paragraphs and list items are implied, and there is no html or body around a fragment.
"""

from __future__ import annotations

import html as html_lib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a clean body may hold, and hosts of frames that may stay.
ALLOWED = frozenset("p h2 h3 h4 ul ol li strong em a blockquote figure figcaption img br".split())
DROPPED = frozenset("script style form object embed noscript svg template".split())
_YOUTUBE = re.compile(r"(?:youtube(?:-nocookie)?\.com/embed/|youtu\.be/)([A-Za-z0-9_-]{11})")


class _Walker(HTMLParser):
    """Calls keep(tag, attrs) for each element and rebuilds what is kept."""

    def __init__(self, keep, limit: int | None = None):
        super().__init__(convert_charrefs=True)
        self.keep, self.limit = keep, limit
        self.out: list[str] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.hidden, self.shown, self.full = 0, 0, False

    def handle_starttag(self, tag, attrs):
        if self.full:
            return
        verdict = self.keep(tag, dict(attrs))
        shown = verdict is not None and verdict is not False and not self.hidden
        if shown:
            self.out.append(verdict if isinstance(verdict, str) else "<" + tag + "".join(f' {k}="{html_lib.escape(v or "")}"' for k, v in attrs) + ">")
        if tag not in VOID:
            self.open.append((tag, shown and not isinstance(verdict, str), verdict is False))
            self.hidden += verdict is False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, shown, hides = self.open.pop()
            self.hidden -= hides
            if shown:
                self.out.append(f"</{t}>")
            if t == tag:
                return

    def handle_data(self, data):
        if self.hidden or self.full:
            return
        if self.limit is not None and self.shown + len(data) > self.limit:
            data = data[: self.limit - self.shown]
            data = data[: data.rfind(" ")] if data.rfind(" ") >= 0.8 * len(data) > 0 else data
            self.full = True
        self.shown += len(data)
        self.out.append(html_lib.escape(data, quote=False))

    def result(self) -> str:
        while self.open:
            t, shown, _ = self.open.pop()
            if shown:
                self.out.append(f"</{t}>")
        return "".join(self.out)


def _walk(fragment: str | None, keep, limit: int | None = None) -> str | None:
    if fragment is None:
        return None
    w = _Walker(keep, limit)
    w.feed(fragment)
    w.close()
    return w.result()


def _sanitised(tag: str, attrs: dict):
    if tag in DROPPED:
        return False
    if tag == "iframe":
        m = _YOUTUBE.search(attrs.get("src") or "")
        return f"<p>https://www.youtube.com/watch?v={m[1]}</p>" if m else False
    if tag not in ALLOWED:
        return None
    kept = {k: v for k, v in attrs.items() if k in ("href", "src", "alt", "title") and not re.match(r"\s*(?:javascript|data|vbscript)\s*:", v or "", re.I)}
    return "<" + tag + "".join(f' {k}="{html_lib.escape(v or "")}"' for k, v in kept.items()) + ">" if kept or tag in VOID else True if not attrs else f"<{tag}>"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(lambda t: None if t is None else html_lib.unescape(t))


@F.pandas_udf(StringType())
def visible_text(fragment: pd.Series) -> pd.Series:
    """Text of a fragment without markup, scripts and styles; white space squeezed."""
    return fragment.map(lambda f: None if f is None else " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", _walk(f, lambda t, a: False if t in DROPPED else True) or "")).split()))


@F.pandas_udf(StringType())
def sanitise(fragment: pd.Series) -> pd.Series:
    """Only allowed elements and attributes; handlers, scripts and foreign frames go, video frames become links."""

    def keep(tag, attrs):
        v = _sanitised(tag, attrs)
        return v

    class Clean(_Walker):
        def handle_starttag(self, tag, attrs):
            verdict = _sanitised(tag, dict(attrs))
            opened = isinstance(verdict, str) and verdict.startswith(f"<{tag}")
            if not self.hidden and isinstance(verdict, str):
                self.out.append(verdict)
            elif not self.hidden and verdict is True:
                self.out.append(f"<{tag}>")
            if tag not in VOID:
                self.open.append((tag, not self.hidden and (opened or verdict is True), verdict is False or tag == "iframe"))
                self.hidden += verdict is False or tag == "iframe"

    def one(f: str | None) -> str | None:
        if f is None:
            return None
        w = Clean(keep)
        w.feed(f)
        w.close()
        return w.result()

    return fragment.map(one)


def truncate_visible(limit: int):
    """Cut a fragment at so many visible characters, at a space where that costs little, with all elements closed."""

    @F.pandas_udf(StringType())
    def run(fragment: pd.Series) -> pd.Series:
        return fragment.map(lambda f: _walk(f, lambda t, a: True, limit))

    return run


class _Outline(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.images, self.heads, self.videos, self.meta, self.sequence = [], [], [], [], {}, []
        self.head: list[str] | None = None
        self.caption: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img":
            size = lambda k: int(a[k]) if (a.get(k) or "").isdigit() else None
            self.images.append((a.get("src") or "", a.get("alt") or "", size("width"), size("height")))
            self.sequence.append("i")
        elif tag == "iframe" and (m := _YOUTUBE.search(a.get("src") or "")):
            self.videos.append(m[1])
        elif re.fullmatch("h[1-6]", tag):
            self.head = [tag]
        elif tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault(a.get("property") or a.get("name"), a.get("content") or "")
        elif tag == "p":
            self.sequence.append("p")

    def handle_endtag(self, tag):
        if self.head and tag == self.head[0]:
            self.heads.append((tag, " ".join("".join(self.head[1:]).split())))
            self.head = None

    def handle_data(self, data):
        if self.head is not None:
            self.head.append(data)
        if data.strip():
            self.sequence.append("t")


OUTLINE = StructType([
    StructField("links", ArrayType(StringType())),
    StructField("images", ArrayType(StructType([StructField("src", StringType()), StructField("alt", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))),
    StructField("headings", ArrayType(StructType([StructField("tag", StringType()), StructField("text", StringType())]))),
    StructField("videos", ArrayType(StringType())),
    StructField("meta", MapType(StringType(), StringType())),
    StructField("stacked_images", BooleanType()),
])


@F.pandas_udf(OUTLINE)
def outline(page: pd.Series) -> pd.DataFrame:
    """Links, images, headings, videos, metadata of a page, and whether two images follow each other without text."""
    rows = []
    for p in page:
        o = _Outline()
        o.feed(p or "")
        o.close()
        flow = [x for x in o.sequence if x != "p"]
        rows.append((o.links, [dict(zip(("src", "alt", "width", "height"), i, strict=True)) for i in o.images], [{"tag": t, "text": x} for t, x in o.heads], list(dict.fromkeys(o.videos)), o.meta, "ii" in "".join(flow)))
    return pd.DataFrame(rows, columns=["links", "images", "headings", "videos", "meta", "stacked_images"])
