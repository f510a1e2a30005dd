"""Repairs of generated articles: headings, links and placeholders in the body; titles and subtitles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import html, urls
from quillspark.functions.text import hits, let, paragraph_key

#: Names of sources by domain, the more general domain after the more special ones that come first in a lookup.
SOURCE_LABELS = {
    "screenrant.com": "ScreenRant", "collider.com": "Collider", "hollywoodreporter.com": "THR", "thewrap.com": "TheWrap", "variety.com": "Variety", "deadline.com": "Deadline", "comicbook.com": "ComicBook", "gamerant.com": "GameRant",
    "cbr.com": "CBR", "empireonline.com": "Empire", "ign.com": "IGN", "ew.com": "Entertainment Weekly", "people.com": "People", "tvline.com": "TVLine", "indiewire.com": "IndieWire", "rollingstone.com": "Rolling Stone", "bbc.com": "BBC",
    "reuters.com": "Reuters", "nytimes.com": "The New York Times", "g1.globo.com": "G1", "globo.com": "Globo", "valor.globo.com": "Valor", "estadao.com.br": "Estadão", "uol.com.br": "UOL", "folha.uol.com.br": "Folha",
}
#: Phrases that fill a text.
PADDING = ("isso pode indicar", "isso sugere", "isso reforça", "os fãs podem esperar", "a série tem potencial", "o filme promete", "isso abre possibilidade", "isso levanta a possibilidade")
#: Body text that leaked into a title; shortest and longest title; lengths of subtitles.
LEAKED = r"(?i)\bem\s+<|<[a-z]|\bOs produzir\b|\bOs \w+ produzir\b"
TITLE, SUBTITLE, SUBTITLE_CUT, SIMILAR = (10, 90), (100, 240), 220, 40


def second_heading(body: Column) -> Column:
    """First-level headings as second-level ones: the page has its own."""
    return F.regexp_replace(F.regexp_replace(body, r"(?i)<h1(\s[^>]*)?>", "<h2$1>"), "(?i)</h1>", "</h2>")


def without_placeholders(body: Column) -> Column:
    """Without lines that only announce an image."""
    return F.when(F.contains(body, F.lit("Imagem")), F.regexp_replace(body, r"(?imd)^\s*(\[?Imagem[^\n<]*\]?)\s*$", "")).otherwise(body)


def without_tag_links(body: Column, domain: str) -> Column:
    """Links to the publisher's tag pages as their text."""
    link = rf"""(?is)<a\s+[^>]*href=["']https?://(?:www\.)?{re.escape(domain)}/tag/[^"'>]+["'][^>]*>(.*?)</a>"""
    return F.regexp_replace(body, link, "$1") if domain else body


def without_naked_links(body: Column) -> Column:
    """Without paragraphs that are nothing but the address of a tag or category page."""
    return F.regexp_replace(body, r"(?i)<p>\s*https?://[^<>\s]+/(?:tag|categoria)/[a-z0-9\-_/]+/?\s*</p>", "")


def padding(text: Column) -> Column:
    """How many of the filling phrases a text has."""
    return let(F.lower(text), lambda t: hits(t, PADDING))


def source_label(url: Column) -> Column:
    """A short name of a source: a known one, else the first label of its host."""
    known = list(SOURCE_LABELS.items())

    def name(host: Column) -> Column:
        found = F.coalesce(*[F.when((host == d) | host.endswith("." + d), F.lit(label)) for d, label in known])
        pretty = F.initcap(F.trim(F.translate(F.substring_index(host, ".", 1), "-_", "  ")))
        return F.when(host == "", "fonte original").otherwise(F.coalesce(found, F.when(pretty == "", "Fonte original").otherwise(pretty)))

    return let(F.coalesce(urls.domain(url), F.lit("")), name)


def similar(left: Column, right: Column) -> Column:
    """Whether two texts say the same: equal keys, or the shorter one, of 40 characters or more, inside the other."""

    def same(k: Column) -> Column:
        short, long = (F.when((F.length(k["a"]) <= F.length(k["b"])) == first, k["a"]).otherwise(k["b"]) for first in (True, False))
        return (k["a"] != "") & (k["b"] != "") & ((k["a"] == k["b"]) | ((F.length(short) >= SIMILAR) & F.contains(long, short)))

    return let(F.struct(paragraph_key(left).alias("a"), paragraph_key(right).alias("b")), same)


def _cut(text: Column, limit: int) -> Column:
    """At most limit characters, whole words where there are any."""
    window = F.left(text, F.lit(limit))
    words = F.trim(F.regexp_extract(window, r"^(.*) [^ ]*$", 1))
    return F.when(F.length(text) <= limit, text).when(words != "", words).otherwise(window)


def final_title(title: Column, fallback: Column) -> Column:
    """struct(title, status): OK as given, SANITIZED, FALLBACK_USED, or INVALID with an empty title."""
    clean = lambda t: _cut(html.visible_text(F.coalesce(t, F.lit(""))), TITLE[1])
    fine = lambda t: (F.length(t) >= TITLE[0]) & ~t.rlike("[<>]") & ~t.rlike(LEAKED)
    both = F.struct(clean(title).alias("own"), clean(fallback).alias("other"), title.alias("given"))
    return let(
        both,
        lambda p: F.when(fine(p["own"]), F.struct(p["own"].alias("title"), F.when(p["own"] == p["given"], "OK").otherwise("SANITIZED").alias("status")))
        .when(fine(p["other"]), F.struct(p["other"].alias("title"), F.lit("FALLBACK_USED").alias("status")))
        .otherwise(F.struct(F.lit("").alias("title"), F.lit("INVALID").alias("status"))),
    )


def compact(text: Column, limit: int) -> Column:
    """Plain text of at most about limit characters; a cut one ends in a full stop."""

    def short(t: Column) -> Column:
        tail = lambda x: F.rtrim(x, F.lit(".,;:"))
        once = tail(_cut(t, limit + 1))
        again = F.when(F.length(once) >= limit, tail(_cut(F.concat(F.left(once, F.lit(limit)), F.lit(" ")), limit))).otherwise(once)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(again, F.lit(".")))

    return let(html.visible_text(F.coalesce(text, F.lit(""))), short)


def final_subtitle(subtitle: Column, title: Column, lead: Column, meta: Column) -> Column:
    """struct(subtitle, status): OK as given, REGENERATED from the lead, or MISSING with an empty subtitle."""
    apart = lambda t, p: ~similar(t, p["title"]) & ~similar(t, p["meta"])
    parts = F.struct(html.visible_text(F.coalesce(subtitle, F.lit(""))).alias("own"), compact(lead, SUBTITLE_CUT).alias("lead"), html.visible_text(F.coalesce(title, F.lit(""))).alias("title"), F.coalesce(meta, F.lit("")).alias("meta"))
    return let(
        parts,
        lambda p: F.when(F.length(p["own"]).between(*SUBTITLE) & apart(p["own"], p), F.struct(p["own"].alias("subtitle"), F.lit("OK").alias("status")))
        .when((F.length(p["lead"]) >= SUBTITLE[0]) & apart(p["lead"], p), F.struct(p["lead"].alias("subtitle"), F.lit("REGENERATED").alias("status")))
        .otherwise(F.struct(F.lit("").alias("subtitle"), F.lit("MISSING").alias("status"))),
    )
