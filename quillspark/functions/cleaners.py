"""Cleaning article pages of known sites: one algorithm on the element tree, driven by a table of sites.

The host picks a site by substring, first match first. The container is the first of the site's selectors that the page
has. In it, elements go by tag, selector, pattern of class or id, or attribute; figures go by what their image is;
elements that hold a phrase of self-promotion go whole, the outermost first; English captions are emptied. Sites with a
list of wanted elements keep only those, one after the other; of wanted elements in each other the outer one is given.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import article
from quillspark.functions.dom import Node, first_below, parse, prune

#: Phrases of self-promotion.
PHRASES = (
    "thank you for reading", "don't forget to subscribe", "subscribe now", "click here", "read more", "sign up", "thanks for reading", "thanks for visiting", "please subscribe", "subscribe to our",
    "stay tuned", "keep up to date", "follow us",
)
#: Class and id patterns of widgets, by group of sites. They are not anchored, so `ad-` also hits `read-`.
COLLIDER = ("tag-interaction", "w-display-card", "w-quick-action-sidebar", "display-card", "sidebar", "related", "recommended", "trending", "widget", "ad-", "banner", "promoted", "sponsored", "carousel", "gallery")
GAMERANT = ("tag-interaction", "display-card", "quick-action-sidebar", "sidebar", "related", "recommended", "author-profile", "trending", "widget", "ad-", "banner", "gallery", "carousel", "promoted", "sponsored")
COMICBOOK = ("display-card", "tag-interaction", "author-info", "related-content", "recommended", "trending", "sidebar", "widget", "ad-", "banner", "gallery-", "carousel", "promoted", "sponsored")
SCREENRANT = ("display-card", "tag-interaction", "author-info", "related-content", "recommended", "trending", "sidebar", "widget", "ad-", "banner", "gallery", "carousel", "promoted", "sponsored")
PENSKE = ("related", "recommended", "sidebar", "widget", "ad-", "advertisement", "banner", "promoted", "sponsored", "newsletter", "social-share", "share-bar", "tags", "trending", "gallery", "carousel")
PENSKE_TAGS = ("script", "style", "noscript", "iframe", "form", "button", "aside", "nav", "footer")
PENSKE_PHRASES = ("thank you for reading", "don't forget to subscribe", "subscribe now", "sign up for", "sign up to", "click here", "read more", "thanks for reading", "please subscribe")
MOVIEWEB = (
    "login", "related", "preference", "popup", "modal", "captcha", "thread", "comment", "newsletter", r"\bad\b", "ad-", "advertisement", "social-share", "share", "gallery", "carousel", "sponsored", "promo", "video",
    "trending", "recommended", "sidebar", "widget", "display-card", "w-display-card", "tag-interaction", "sensa", "quiz", r"\bcast\b", "srdb", "screenrant", "powered-by", "extra-content", "interaction",
)
MOVIEWEB_OUT = (
    ".video", ".gallery", ".carousel", ".newsletter", ".related", ".social-share", ".share", ".ad", ".advertisement", ".sponsored", ".w-login", ".w-valnet-login", ".valnet-login", ".vs-video-modal",
    ".vertical-short", ".display-card", ".w-display-card", ".w-display-card-info", ".w-display-card-media", ".w-display-card-cast", ".tag-interaction-widget", ".w-tag-interaction-popup-menu",
    ".ww-sensa-quiz-widget", ".w-sensa-quiz-widget", ".article-tags", ".article-options",
)
MOVIEWEB_SIGNALS = (
    "advertisement", "subscribe", "subscription", "sign up", "newsletter", "read more", "more from", "follow us", "keep reading", "create an account", "log in", "continue with", "by creating an account",
    "terms of use", "privacy policy", "release date", "runtime", "director", "writers", "producers", "powered by", "see all", "report error", "start quiz",
)
GE_OUT = ("div.video-player", "article.content-video", "div.show-multicontent-playlist-container", "div.related-materia", "div#gm-widget-mais-escalados-root")
ICONS = (".svg", "logo", "icon")
_WIDE = ("p", "div", "span", "article", "blockquote", "section")


@dataclass(frozen=True)
class Site:
    host: str
    containers: tuple[str, ...]
    #: A narrower container inside the first one, where there is one.
    within: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("script", "style")
    out: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    attribute: str = ""
    attribute_prefix: str = ""
    #: Parts of image URLs (and of alternative texts) by which figures go; () leaves figures alone.
    icons: tuple[str, ...] = ()
    icons_in_alt: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    phrase_tags: tuple[str, ...] = _WIDE
    blank_captions: bool = True
    #: Wanted elements; if given, nothing else is kept.
    only: tuple[str, ...] = ()
    least_chars: int = 0


_VALNET = {"attribute": "data-is-tag-interaction", "tags": ("script", "style", "aside"), "icons": (*ICONS, "sr-db"), "icons_in_alt": ("sr-db",), "phrases": PHRASES}
_PENSKE = {"tags": PENSKE_TAGS, "patterns": PENSKE, "icons": ICONS, "phrase_tags": ("p", "div", "span")}
#: Fixed values, in order of routing: the first host that is part of the page's host decides.
SITES = (
    Site("lance.com.br", ("article",), only=("p", "h2", "figure", "blockquote.twitter-tweet"), tags=(), blank_captions=False),
    Site("ge.globo.com", ("div.materia-conteudo", "article.post-content", "div.mc-article-body"), out=GE_OUT, blank_captions=False),
    Site("comicbook.com", ("article",), (".article-body",), patterns=COMICBOOK, attribute_prefix="data-stnl-", **_VALNET),
    Site("screenrant.com", ("article",), (".article-body",), patterns=SCREENRANT, attribute_prefix="data-stnl-", **_VALNET),
    Site("gamerant.com", ("article", "[id*=article]", "[class*=article-body]"), ("#article-body", ".article-body", "[itemprop=articleBody]"), patterns=GAMERANT, **_VALNET),
    Site("collider.com", ("#article-body", ".article-body", "[itemprop=articleBody]", "article"), patterns=COLLIDER, **_VALNET),
    Site("variety.com", ("[data-testid=article-body]", ".article-body", ".entry-content", ".c-entry-content", "[itemprop=articleBody]", ".c-content", "article"), phrases=(*PENSKE_PHRASES, "subscribe to variety"), **_PENSKE),
    Site("hollywoodreporter.com", ("[data-testid=article-body]", ".article-content", ".article-body", ".entry-content", "[itemprop=articleBody]", ".c-content", "article"), phrases=PENSKE_PHRASES, **_PENSKE),
    Site(
        "movieweb.com", ("[itemprop=articleBody]", "#article-body", ".article-body", ".w-article-body", ".article-content", ".entry-content", ".post-content", "main article", "article", "main"),
        tags=("script", "style", "noscript", "iframe", "form", "button", "nav", "footer", "aside", "header"), out=MOVIEWEB_OUT, patterns=MOVIEWEB, phrases=MOVIEWEB_SIGNALS,
        only=("p", "h2", "h3", "blockquote", "ul", "ol", "figure"), least_chars=20,
    ),
)


def site_of(host: str | None) -> Site | None:
    return next((s for s in SITES if s.host in (host or "").lower()), None)


_SIMPLE = re.compile(r"([a-z0-9]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(\*?=)([^\]]*)\]")


@cache
def _parts(selector: str) -> tuple[tuple[str, ...], ...]:
    return tuple(_SIMPLE.findall(selector))


def matches(node: Node, selector: str) -> bool:
    """Whether an element fits a selector of tag, #id, .class, [attribute=value] and [attribute*=part]."""
    for tag, own_id, name, attr, how, value in _parts(selector):
        if (tag and node.tag != tag) or (own_id and node.get("id") != own_id) or (name and name not in node.classes):
            return False
        if attr and not (value in node.get(attr) if how == "*=" else node.get(attr) == value):
            return False
    return True


def first(root: Node, selectors: tuple[str, ...]) -> Node | None:
    """The first element that fits the first selector that any element fits; a selector may name an outer and an inner element."""
    for selector in selectors:
        *outer, inner = selector.split()
        places = root.outermost(lambda n: matches(n, outer[0])) if outer else [root]  # noqa: B023
        found = next((n for p in places for n in p.walk() if n is not p and matches(n, inner)), None)
        if found is not None:
            return found
    return None


def _holding(root: Node, phrases: tuple[str, ...], sep: str) -> Iterator[tuple[Node, bool, str]]:
    """Each element below root in order, whether its text holds a phrase, and its text's beginning (trimmed pieces joined).

    The whole text is laid out once; an element holds a phrase if one lies between where it begins and ends.
    """
    pieces, at, size = [], {}, 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    order: list[Node] = []
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            if text := node.strip():
                pieces.append(text + sep)
                size += len(text) + len(sep)
        elif done:
            at[id(node)] = (at[id(node)][0], size)
        else:
            order.append(node)
            at[id(node)] = (size, size)
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    whole = "".join(pieces)
    low = whole.lower()
    if len(low) != len(whole):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in whole)
    found = sorted((m.start(), m.start() + len(p)) for p in phrases for m in re.finditer(f"(?={re.escape(p)})", low))
    starts = [a for a, _ in found]
    ends = [b for _, b in found]
    for k in range(len(ends) - 2, -1, -1):
        ends[k] = min(ends[k], ends[k + 1])
    for node in order[1:]:
        a, b = at[id(node)]
        k = bisect_left(starts, a)
        yield node, k < len(starts) and ends[k] <= b, whole[a : min(b, a + 40)].strip()


def _bad_figure(img: Node | None, site: Site) -> bool:
    if img is None:
        return True
    src, alt = img.get("src").lower(), img.get("alt").lower()
    return any(x in src for x in (*site.icons, *article.THUMBNAILS)) or any(x in alt for x in site.icons_in_alt)


def _wanted(container: Node, site: Site) -> Node | None:
    """The site's wanted elements of a container, none inside another."""
    ok: dict[int, bool] = {}
    image = first_below(list(container.walk()), "img")
    for node, holds, text in _holding(container, site.phrases, " "):
        fits = any(matches(node, s) for s in site.only) and not holds
        if fits and node.tag == "figure":
            img = image.get(id(node))
            fits = img is not None and (article.usable(img.get("src") or img.get("data-src") or img.get("data-img-url")) if site.least_chars else not img.get("src").endswith(".svg"))
        elif fits and node.tag not in ("ul", "ol"):
            fits = len(text) >= site.least_chars
        ok[id(node)] = fits
    kept = Node("article")
    for node in container.outermost(lambda n: ok.get(id(n), False)):
        kept.append(node)
    return kept if kept.children else None


def clean(root: Node, site: Site, url: str = "") -> tuple[Node, dict[str, str]] | None:
    """The container without what the site drops, and the captions that were emptied; None if there is no container or nothing is left."""
    container = first(root, site.containers)
    if container is None:
        return None
    container = first(container, site.within) or container
    drop = re.compile("|".join(site.patterns), re.I) if site.patterns else None
    prune(container, lambda n: n.tag in site.tags or any(matches(n, s) for s in site.out))
    named = lambda n: bool(drop) and bool(drop.search(" ".join(n.classes)) or drop.search(n.get("id")))
    marked = lambda n: bool(site.attribute and n.get(site.attribute)) or bool(site.attribute_prefix and any(a.startswith(site.attribute_prefix) for a in n.attrs))
    prune(container, lambda n: named(n) or marked(n))
    if site.only:
        up = container
        while site.least_chars and up is not None:
            if named(up):
                return None
            up = up.parent
        container = _wanted(container, site)
        if container is None:
            return None
    else:
        if site.icons:
            context = root.find("p", "h2", "h3", "blockquote") is not None
            image = first_below(list(container.walk()), "img")
            prune(container, lambda n: n.tag == "figure" and (not context or _bad_figure(image.get(id(n)), site)))
        if site.phrases:
            gone = {id(n) for n, holds, _ in _holding(container, site.phrases, "") if holds and n.tag in site.phrase_tags}
            prune(container, lambda n: id(n) in gone)
    return container, article.blank_english_captions(container, url) if site.blank_captions else {}


def cleaned(page: str | None, host: str | None) -> str | None:
    """Markup of the cleaned container; NULL for unknown hosts and pages without container, which generic extraction handles."""
    site = site_of(host)
    found = clean(parse(page), site) if site and page else None
    return found[0].html() if found else None


@F.pandas_udf(StringType())
def clean_page(host: pd.Series, page: pd.Series) -> pd.Series:
    """cleaned() of columns."""
    return pd.Series([cleaned(p, h) for h, p in zip(host, page, strict=True)], dtype="object")
