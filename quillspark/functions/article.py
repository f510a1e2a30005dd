"""The article of a page: where its body is, what goes before it is read, its text, images, captions, embeds and metadata.

All of it works on one element tree (`dom`) in time that grows with the page. The order of fallbacks for the body: an
article element; the containers that publishing systems name; the container with the densest text; main; the page.
"""

from __future__ import annotations

import html as html_lib
import re
from urllib.parse import unquote, urljoin, urlsplit

from quillspark.functions.dom import HEADINGS, Node, first_below, parse, prune, squeeze
from quillspark.functions.media import BAD_HOSTS, BAD_WORDS, JUNK_NAMES, THUMBNAILS

#: Sections that are no article, by a part of class or id.
BAD_SECTION = re.compile(
    "related|trending|more|sidebar|aside|recommend|recommended|gallery|carousel|slideshow|video|playlist|social|share|footer|header|nav|subscribe|newsletter|ad|advert|sponsor|"
    "cta|banner|paid|outbrain|taboola|screen-hub|screenhub|hub|most-popular|popular",
    re.I,
)
#: Classes of containers that hold an article's body.
BODY_CLASSES = frozenset("post-content single-content post-body article-body article-content".split())
#: Headings of lists of further articles, and classes and marks of links to them.
RELATED_HEADING = re.compile(r"(leia também|veja também|relacionad[oa]s|recomendad[oa]s|tópicos relacionados)", re.I)
RELATED_LINK = ("relacion", "related", "leia", "veja")
RELATED_MARKS = ("related", "see_more")
#: What is taken out before reading, by element, class, part of the class attribute, part of the id, and attribute.
OUT_TAGS = frozenset("header footer nav aside".split())
OUT_CLASSES = frozenset(
    "cta-middle infomoney-read-more read-more post__related sharing share social banner ads advertisement sponsored paid-content partner outbrain taboola review score meter "
    "comments author author-box post-author byline entry-author avatar author__image author-profile subscribe".split()
)
OUT_CLASS_PART = re.compile("srdb|rating|related|relacionad|relaciona|recommend|veja-tambem|leia-tambem|trending|sidebar|recommended|screen-hub|screenhub|most-popular|popular|newsletter|ad-|advert")
OUT_ID_PART = re.compile("related|relacionad|leia|trending|sidebar|most-popular|popular|newsletter|ad-|advert")
OUT_ATTRS = ("data-ad", "data-ad-slot")
OUT_LABELS = ("Leia", "Relacionad")
OUT_TEXT = "powered by srdb"
#: Further classes on two portals.
OUT_BY_HOST = {
    "infomoney.com.br": frozenset("single__related article__related post-related related-posts rm-related block-related single__sidebar article__sidebar single__see-also wp-block-infomoney-blocks-infomoney-read-more".split()),
    "estadao.com.br": frozenset("links-relacionados mat-relacionadas es-relacionadas stories-related see-also link-relacionado box-relacionadas".split()),
}
#: A message and labels of fact boxes.
FORBIDDEN_TEXT = "Your comment has not been saved"
LABELS = ("Release Date", "Runtime", "Director", "Directors", "Writer", "Writers", "Producer", "Producers", "Cast")
_LABEL_RES = [re.compile(rf"(?:^|\n)\s*{re.escape(x)}\s*(?:\n|$|:)", re.I) for x in LABELS]
#: Elements that make a container worth keeping though it has no text.
KEEPABLE = frozenset("p img figure iframe blockquote ul ol h2 h3 h4".split())
#: Where an image's URL stands, in order.
SOURCES = ("src", "data-src", "data-original", "data-lazy-src", "data-image", "data-img-url")
_PARAGRAPHS = frozenset("p li blockquote pre td h2 h3 h4".split())
_CONTAINERS = frozenset("div section article main td body center".split())
_STATUS = re.compile(r"https?://(?:www\.)?(?:x|twitter)\.com/[^/\s]+/status/(\d+)", re.I)
_YOUTUBE = re.compile(r"(?:youtube\.com/(?:embed/|shorts/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})")
_WATCH = re.compile(r"youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?=[&#]|$)")
#: Words below which a site's cleaner is doubted.
MIN_WORDS = 150
_WORD = re.compile(r"\b\w+\b")


# --- Images ----------------------------------------------------------------


def widest(srcset: str) -> str:
    """The URL with the largest declared width; of equal ones the last."""
    best, width = "", -1
    for part in srcset.split(","):
        words = part.split()
        if words:
            w = int(words[1][:-1]) if len(words) > 1 and re.fullmatch(r"\d+w", words[1]) else 0
            if w >= width:
                best, width = words[0], w
    return best


def absolute(url: str, base: str) -> str:
    """A URL on the page's address; the last one of several run together; nothing for data."""
    url = html_lib.unescape(url).strip()
    if not url or url.startswith("data:"):
        return ""
    starts = [m.start() for m in re.finditer("https?://", url, re.I)]
    try:
        return urljoin(base, url[starts[-1] :] if len(starts) > 1 else url)
    except ValueError:
        return ""


def source(img: Node) -> str:
    """The URL of an image element: the first attribute that has one, else the widest of its set."""
    return next((img.get(a) for a in SOURCES if img.get(a)), "") or widest(img.get("srcset"))


def images(body: Node, base: str) -> list[str]:
    """Absolute URLs of all images of a body, distinct in the order in which the kinds of places name them.

    Image elements, sources of pictures, images for readers without scripts, data attributes, backgrounds, figures.
    """
    nodes = [n for n in body.walk() if n is not body]
    found = [source(n) for n in nodes if n.tag == "img" and n.get("aria-hidden") != "true"]
    found += [widest(n.get("srcset")) for p in body.outermost(lambda n: n.tag == "picture") for n in p.all("source") if n.get("srcset")]
    for n in nodes:
        if n.tag == "noscript":
            found += [i.get("src") or i.get("data-src") or i.get("data-original") for i in parse("".join(n.texts())).all("img")]
    found += [next((n.get(a) for a in ("data-img-url", "data-image", "data-src", "data-original") if n.get(a)), "") for n in nodes]
    for n in nodes:
        if "background-image" in n.get("style") and (m := re.search(r"url\((.*?)\)", n.get("style"))):
            found.append(m[1].strip().strip("'\""))
    return list(dict.fromkeys(u.rstrip("/") for u in (absolute(x, base) for x in found if x) if u))


def usable(url: str) -> bool:
    """Whether an image may stand in an article; the same rule as media.usable, for use inside a page."""
    low = url.lower()
    try:
        host, path, query = (urlsplit(url).hostname or ""), urlsplit(url).path, urlsplit(url).query
    except ValueError:
        return False
    if not url or url.startswith("data:") or host.endswith(BAD_HOSTS) or any(w in low for w in (*BAD_WORDS, *THUMBNAILS)) or any(w in path.rsplit("/", 1)[-1].lower() for w in JUNK_NAMES):
        return False
    asked = dict(re.findall(r"(?:^|&)(width|w|height|h)=(\d{1,6})", query)[::-1])
    size = (asked.get("width") or asked.get("w"), asked.get("height") or asked.get("h"))
    if not all(size):
        suffix = re.search(r"-(\d{2,5})x(\d{2,5})(?:\.|$)", path)
        size = suffix.groups() if suffix else ()
    if len(size) < 2:
        return True
    w, h = int(size[0]), int(size[1])
    return w >= 600 and h >= 315 and 0.6 <= w / h <= 2.2


def caption_keys(url: str) -> list[str]:
    """Under which names a caption is kept: the file's name and the path, decoded and in lower case."""
    try:
        path = unquote(urlsplit(html_lib.unescape(url)).path or url).strip().lower()
    except ValueError:
        path = unquote(url).strip().lower()
    return [k for k in (path.rsplit("/", 1)[-1], path) if k]


def captions(body: Node, base: str) -> dict[str, str]:
    """Captions of figures by their images' names; the first of a name stays, and the outer of figures in each other."""
    nodes = list(body.walk())
    filled = _sums(nodes, {id(n): any(isinstance(c, str) and c.strip() for c in n.children) for n in nodes})
    first = first_below(nodes, "figcaption")

    def captioned(n: Node) -> bool:
        return n.tag == "figure" and id(n) in first and filled[id(first[id(n)])] > 0

    out: dict[str, str] = {}
    for figure in body.outermost(captioned):
        text = first[id(figure)].text()
        for img in figure.all("img") if text else []:
            if url := source(img):
                for key in caption_keys(absolute(url, base)):
                    out.setdefault(key, text)
    return out


#: Common words by which a caption's language is told.
ENGLISH = frozenset("the and in as from to at by for with is are was been be have has had do does did will would could should may can might of or a an on it that this which who what where when why how all each every both".split())
PORTUGUESE = frozenset("o a os as e é em de da do das dos um uma umas uns para por que com seu sua seus suas mais como mas foi está estão são não tem temos tenho tinha ser estar ir vou vai vão foram ele ela eles elas nós".split())


def likely_english(text: str) -> bool:
    """Whether a caption reads as English: by common words of both languages, prepositions between names, and how it begins."""
    low = text.lower().strip()
    words = _WORD.findall(low)
    if len(low) < 3 or len(words) < 2:
        return False
    english, portuguese = sum(w in ENGLISH for w in words), sum(w in PORTUGUESE for w in words)
    if portuguese > english:
        return False
    capital = sum(w[0].isupper() for w in _WORD.findall(text))
    if capital > 0.4 * len(words) and english and any(p in low for p in (" in ", " as ", " from ")):
        return True
    return english > 0.3 * len(words) or low.startswith(("the ", "a ", "an ", "this ", "that "))


def blank_english_captions(root: Node, base: str) -> dict[str, str]:
    """Empty captions that read as English; what they said is returned by their images' names."""
    out: dict[str, str] = {}
    for caption in root.outermost(lambda n: n.tag == "figcaption"):
        text = caption.text("")
        if text and likely_english(text):
            figure = caption.parent
            while figure is not None and figure.tag != "figure":
                figure = figure.parent
            for img in (figure or caption.parent or caption).all("img"):
                if url := source(img):
                    for key in caption_keys(absolute(url, base)):
                        out.setdefault(key, text)
            caption.children = []
    return out


# --- Embeds ----------------------------------------------------------------


def youtube_ids(root: Node) -> list[str]:
    """Videos of frames and players, each once in order."""
    found = []
    for n in root.walk():
        if n.tag == "iframe":
            m = _YOUTUBE.search(n.get("src")) or _WATCH.search(n.get("src"))
            found.append(m[1] if m else "")
        elif n.get("data-youtube-id") or (n.get("id") and {"w-youtube", "youtube"} & set(n.classes)):
            found.append(n.get("id") or n.get("data-youtube-id"))
    return [x for x in dict.fromkeys(found) if x]


def _status(quote: Node) -> str:
    """What tells one quoted post from another: the number in its link, else its text."""
    links = (m[1] for a in quote.all("a") if (m := _STATUS.search(a.get("href"))))
    return next(links, "") or squeeze(quote.text()).lower()


def posts(root: Node) -> dict[str, str]:
    """Markup of quoted posts without scripts, by what tells them apart; the first of each."""
    out: dict[str, str] = {}
    for quote in root.outermost(lambda n: n.tag == "blockquote" and "twitter-tweet" in n.classes):
        key = _status(quote)
        if key and key not in out:
            copy = parse(quote.html())
            prune(copy, lambda n: n.tag == "script")
            out[key] = copy.inner()
    return out


# --- The body --------------------------------------------------------------


def _sums(nodes: list[Node], own: dict[int, float]) -> dict[int, float]:
    """For each of the nodes, given in the order of the page, the sum of a number over it and all below."""
    total = {id(n): own.get(id(n), 0) for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None and id(n.parent) in total:
            total[id(n.parent)] += total[id(n)]
    return total


def densest(root: Node) -> Node | None:
    """The container whose paragraphs have the most text, less what stands in links; a share of it counts for the next outer one."""
    nodes = list(root.walk())
    plain = _sums(nodes, {id(n): sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in nodes if n.tag not in ("script", "style", "noscript", "title")})
    link = _sums(nodes, {id(n): plain[id(n)] for n in nodes if n.tag == "a"})
    score: dict[int, float] = {}
    for n in nodes:
        if n.tag in _PARAGRAPHS:
            worth, outer, share = plain[id(n)] - 2 * link[id(n)], n.parent, 1.0
            for _ in range(8):  # lists and tables lie between a paragraph and its container, but not many
                if outer is None or share < 0.2:
                    break
                if outer.tag in _CONTAINERS:
                    score[id(outer)] = score.get(id(outer), 0) + share * worth
                    share /= 2
                outer = outer.parent
    return max((n for n in nodes if score.get(id(n), 0) > 0 and not BAD_SECTION.search(n.named)), key=lambda n: score[id(n)], default=None)


def find_body(root: Node) -> Node:
    """The element that holds the article."""
    if article := root.find("article"):
        return article
    nodes = list(root.walk())
    named = [n for n in nodes if BODY_CLASSES & set(n.classes) or n.get("itemprop") == "articleBody"]
    named = [n for n in named if n.tag not in OUT_TAGS and not BAD_SECTION.search(n.named)]
    if named:
        count = _sums(nodes, {id(n): 1 for n in nodes if n.tag in ("p", "figure")})
        return max(named, key=lambda n: count[id(n)])
    return densest(root) or root.find("main") or root.find("body") or root


def _related(root: Node) -> set[int]:
    """Elements of lists of further articles: the container of such a heading if it has at most two headings, else heading and list.

    Headings are taken from the last to the first. Each knows its nearest container and its place among the headings
    that are left, so that counting those in a container looks at two neighbours on each side.
    """
    order = {id(n): i for i, n in enumerate(root.walk())}
    nodes = list(root.walk())
    last = {i: i for i in order.values()}
    for n in reversed(nodes):
        if n.parent is not None and id(n.parent) in order:
            outer = order[id(n.parent)]
            last[outer] = max(last[outer], last[order[id(n)]])
    holder: dict[int, Node | None] = {}
    for n in nodes:
        up = n.parent
        holder[id(n)] = None if up is None else up if up.tag in ("section", "aside", "div") else holder.get(id(up))
    # For each parent its elements, and where the next one lies that is not gone.
    seat, row, skip = {}, {}, {}
    for n in nodes:
        row[id(n)] = [c for c in n.children if isinstance(c, Node)]
        seat.update((id(c), k) for k, c in enumerate(row[id(n)]))
        skip[id(n)] = list(range(len(row[id(n)]) + 1))

    def lost(n: Node) -> None:
        gone.add(id(n))
        if n.parent is not None and id(n.parent) in skip:
            skip[id(n.parent)][seat[id(n)]] = seat[id(n)] + 1

    def following(n: Node) -> Node | None:
        if n.parent is None or id(n.parent) not in skip:
            return None
        to, k = skip[id(n.parent)], seat[id(n)] + 1
        while to[k] != k:
            to[k] = to[to[k]]
            k = to[k]
        return row[id(n.parent)][k] if k < len(row[id(n.parent)]) else None

    heads = [n for n in nodes if n.tag in HEADINGS]
    place = [order[id(n)] for n in heads]
    before, after = list(range(-1, len(heads) - 1)), list(range(1, len(heads) + 1))
    gone: set[int] = set()
    dead = [False] * len(heads)

    def kill(k: int) -> None:
        dead[k] = True
        if before[k] >= 0:
            after[before[k]] = after[k]
        if after[k] < len(heads):
            before[after[k]] = before[k]

    def near(k: int, step: list[int]) -> list[int]:
        out = []
        while len(out) < 2 and 0 <= (k := step[k]) < len(heads):
            out.append(k)
        return out

    def take(n: Node, k: int) -> None:
        """Take an element out, and the headings in it, which lie next to each other."""
        lost(n)
        for step in (before, after):
            j = k
            while 0 <= (j := step[j]) < len(heads) and order[id(n)] <= place[j] <= last[order[id(n)]]:
                kill(j)

    for k in range(len(heads) - 1, -1, -1):
        if dead[k] or not RELATED_HEADING.search(heads[k].text()):
            continue
        box = holder[id(heads[k])]
        others = [j for j in near(k, before) + near(k, after) if box is not None and order[id(box)] <= place[j] <= last[order[id(box)]]]
        if box is not None and len(others) < 2:
            take(box, k)
        else:
            sibling = following(heads[k])
            if sibling is not None and sibling.tag in ("div", "ul", "section", "ol"):
                take(sibling, k)
            lost(heads[k])
        kill(k)
    return gone


def _out(n: Node, host_classes: frozenset[str]) -> bool:
    classes, raw = set(n.classes), n.get("class")
    return bool(
        n.tag in OUT_TAGS
        or classes & OUT_CLASSES
        or classes & host_classes
        or (raw and OUT_CLASS_PART.search(raw))
        or (n.get("id") and (OUT_ID_PART.search(n.get("id")) or n.get("id") == "comments"))
        or (n.tag == "div" and "widget" in classes)
        or any(a in n.attrs for a in OUT_ATTRS)
        or (n.tag == "section" and any(x in n.get("aria-label") for x in OUT_LABELS))
        or (n.tag == "a" and (any(k in raw.lower() for k in RELATED_LINK) or n.get("data-gtm-cta") in RELATED_MARKS))
        or any(isinstance(c, str) and OUT_TEXT in c.lower() for c in n.children)
    )


def pre_clean(root: Node, url: str) -> None:
    """Take out widgets, adverts, navigation, comments, bylines and lists of further articles."""
    gone = _related(root)
    host = host_of(url)
    prune(root, lambda n: id(n) in gone or _out(n, OUT_BY_HOST.get(host, frozenset())))


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").replace("www.", "")
    except ValueError:
        return ""


def content(root: Node) -> str:
    """Markup of the body without scripts, forms, sections that are no article, and empty containers."""
    body = find_body(root)
    body = body if body.tag in ("article", "main") else body.find("article", "main") or body
    prune(body, lambda n: n.tag in ("script", "style", "noscript", "form", "button", "svg", "canvas") or n.tag in OUT_TAGS or bool(BAD_SECTION.search(n.named)))
    nodes = list(body.walk())
    worth = _sums(nodes, {id(n): (n.tag in KEEPABLE) + any(isinstance(c, str) and c.strip() for c in n.children) for n in nodes})
    prune(body, lambda n: n.tag in ("div", "section") and not worth[id(n)])
    return body.inner().strip()


def without_fact_boxes(root: Node) -> None:
    """Take out messages, containers that hold two labels of a fact box or more, and such labels that stand alone."""
    prune(root, lambda n: any(isinstance(c, str) and c.strip() == FORBIDDEN_TEXT for c in n.children))
    nodes = list(root.walk())
    # Labels are looked for in the innermost text of each element; sets of them are united upwards.
    seen: dict[int, set[int]] = {id(n): set() for n in nodes}
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, str):
                text = "\n".join(x.strip() for x in c.splitlines())
                seen[id(n)] |= {k for k, r in enumerate(_LABEL_RES) if r.search(text)}
        if n.parent is not None and id(n.parent) in seen:
            seen[id(n.parent)] |= seen[id(n)]
    prune(root, lambda n: n.tag in ("div", "section", "aside", "ul", "ol") and len(seen[id(n)]) >= 2)
    alone = frozenset((FORBIDDEN_TEXT, *LABELS))
    # Text of each element, as far as it is short enough to be such a label.
    short: dict[int, str] = {}
    for n in reversed(list(root.walk())):
        text = ""
        for c in n.children:
            text += c if isinstance(c, str) else short[id(c)]
            if len(text.strip()) > 60:
                break
        short[id(n)] = text if len(text) < 200 else text.strip()[:61]
    prune(root, lambda n: n.tag in ("p", "li", "span", "h3", "h4") and short[id(n)].strip().rstrip(":").strip() in alone)


def figures_of_data(root: Node) -> None:
    """Turn containers that only name an image into figures, their text into the caption."""
    for div in root.outermost(lambda n: n.tag == "div" and n.get("data-img-url") != ""):
        text = div.text("")
        img = Node("img", {"src": div.get("data-img-url")} | ({"alt": text} if text else {}))
        div.tag, div.attrs, div.children = "figure", {}, []
        div.append(img)
        if text:
            caption = Node("figcaption")
            caption.append(text)
            div.append(caption)


def words(fragment: str) -> int:
    return len(_WORD.findall(parse(fragment).text()))


# --- The page --------------------------------------------------------------


def _meta(root: Node, key: str, value: str) -> str:
    return next((n.get("content") for n in root.walk() if n.tag == "meta" and n.get(key) == value and n.get("content")), "")


def largest_image(root: Node) -> str:
    """The image of the first article element with the largest declared area."""
    article, best, area = root.find("article"), "", 0
    for img in article.all("img") if article else []:
        w, h = img.get("width"), img.get("height")
        url = img.get("src") or img.get("data-src")
        if url and w.isdecimal() and h.isdecimal() and len(w) + len(h) < 12 and int(w) * int(h) > area:
            best, area = url, int(w) * int(h)
    return best


def metadata(root: Node) -> dict:
    """Title, excerpt, the page's shared image, the largest image of the article, and texts of JSON-LD scripts."""
    title = root.find("title")
    return {
        "title": (_meta(root, "property", "og:title") or ("".join(title.texts()) if title else "") or "No Title Found").strip(),
        "excerpt": (_meta(root, "name", "description") or _meta(root, "property", "og:description")).strip(),
        "shared_image": _meta(root, "property", "og:image"),
        "largest_image": largest_image(root),
        "json_ld": [t for t in ("".join(n.texts()) for n in root.all("script") if n.get("type") == "application/ld+json") if t],
    }


def read(page: str | None, url: str | None) -> dict:
    """Everything that is found in a page: by its site's cleaner, or by the generic reader if there is none or it finds too little."""
    from quillspark.functions import cleaners  # it uses this module

    root, url = parse(page), url or ""
    out = metadata(root) | {"videos": youtube_ids(root), "raw_words": len(_WORD.findall(root.text())), "site": None}
    embeds = posts(root)
    site = cleaners.site_of(host_of(url))
    found = cleaners.clean(root, site, url) if site else None
    own = None
    if found:
        body, emptied = found
        own = {"site": site.host, "body_tag": body.tag, "captions": captions(body, url), "images": [u for u in (absolute(source(i), url) for i in body.all("img")) if u and usable(u)]}
        own["captions"] = emptied | own["captions"]
        own["videos"] = list(dict.fromkeys(youtube_ids(body) + out["videos"]))
        plain = parse(body.html())
        prune(plain, lambda n: n.tag == "blockquote" and "twitter-tweet" in n.classes)
        own["words"] = len(_WORD.findall(plain.text()))
        own["content"] = _with_posts(body.html(), posts(body), embeds)
        if site.host == "movieweb.com" and (head := _headline(parse(page))):
            own["title"] = head
        if own["words"] >= MIN_WORDS or out["raw_words"] <= MIN_WORDS:
            return out | own
    if site:  # the cleaner has taken the tree apart
        root = parse(page)
    pre_clean(root, url)
    figures_of_data(root)
    body = find_body(root)
    out |= {"body_tag": body.tag, "captions": captions(body, url), "images": images(body, url)}
    final = parse(content(root))
    without_fact_boxes(final)
    out["content"] = _with_posts(final.inner(), posts(final), embeds)
    out["words"] = words(out["content"])
    return out | own if own and out["words"] <= own["words"] else out


def _with_posts(markup: str, present: dict[str, str], embeds: dict[str, str]) -> str:
    return markup + "".join(m for k, m in embeds.items() if k not in present)


def _headline(root: Node) -> str:
    head = (root.find("article") or root).find("h1") or root.find("h1")
    return head.text() if head else ""
