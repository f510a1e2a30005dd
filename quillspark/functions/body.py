"""Editing the body of an article on its element tree: links, images, videos, figures, credits, captions.

Every function takes markup and gives markup, or None for None; each in time that grows with the body. Editing a body
that was edited already changes nothing more: media that are there are not put in again, figures in order stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillspark.functions import names
from quillspark.functions.article import widest
from quillspark.functions.dom import HEADINGS, VOID, Node, first_below, parse, prune, squeeze

#: Elements whose text takes no links.
UNLINKED = HEADINGS | frozenset("a blockquote code pre figure figcaption script style".split())


def _insert_after(at: Node, new: Node) -> None:
    parent = at.parent
    parent.children.insert(next(i for i, c in enumerate(parent.children) if c is at) + 1, new)
    new.parent = parent


def _element(tag: str, text: str = "", **attrs: str) -> Node:
    node = Node(tag, attrs)
    if text:
        node.append(text)
    return node


# --- Links -----------------------------------------------------------------


@dataclass(frozen=True)
class Link:
    """A page that can be linked to. `rank` orders links of one tier; pillars are the first tier, shared categories the second."""

    url: str
    title: str
    keywords: tuple[str, ...]
    categories: frozenset[int] = frozenset()
    pillar: bool = False
    rank: int = 0

    @property
    def label(self) -> str:
        return self.title or next((k.strip() for k in self.keywords if k.strip()), "Leia tambem")


class Linker:
    """Pages in the order in which an article of some categories would link to them, and the dictionary of their keywords."""

    def __init__(self, links: list[Link], categories: frozenset[int] = frozenset()) -> None:
        self.tier = lambda x: 0 if x.pillar else 1 if categories & x.categories else 2
        self.ordered = sorted((x for x in links if x.keywords and x.url), key=lambda x: (self.tier(x), x.rank))
        # Keys of the dictionary, and for each the pages that have it with the keyword's place among theirs.
        of: dict[str, list[tuple[int, int, str]]] = {}
        for k, link in enumerate(self.ordered):
            for n, word in enumerate(sorted((w for w in link.keywords if w.strip()), key=len, reverse=True)):
                of.setdefault(names._plain(word)[0].strip(), []).append((k, n, word))
        self.pages = list(of.values())
        self.dictionary = names.automaton.__wrapped__(tuple(of))

    def first(self) -> Link:
        """The page to fall back to."""
        return next((x for x in self.ordered if self.tier(x) == 1), None) or self.ordered[0]


def add_links(markup: str | None, links: list[Link] | Linker, categories: frozenset[int] = frozenset(), most: int = 6) -> tuple[str | None, list[str]]:
    """The body with links to other pages, and the pages linked, in order.

    Texts outside links, headings, quotations, code and figures are taken in order; in each the first keyword of the best page that
    is not linked yet becomes a link (pages by tier, then rank; of a page's keywords the longest). A page is linked once, a text
    takes one link, a body `most`. If no keyword occurs, a paragraph with a link to the first page of the article's categories,
    else the first pillar, else the first page, follows the second paragraph.
    """
    linker = links if isinstance(links, Linker) else Linker(links, categories)
    ordered = linker.ordered
    if not markup or not ordered:
        return markup, []
    root, used, done = parse(markup), set(), []
    changed: dict[int, dict[int, list[Node | str]]] = {}
    for node, i in _texts(root):
        if len(done) >= most:
            break
        text = node.children[i]
        best = None
        for a, z, key in names.found_by(linker.dictionary, text, overlaps=True):
            for k, n, word in linker.pages[key]:
                if ordered[k].url not in used:
                    best = min(best, (k, n, a, z, word)) if best else (k, n, a, z, word)
                    break
        if best:
            k, _, a, z, word = best
            used.add(ordered[k].url)
            done.append(ordered[k].url)
            changed.setdefault(id(node), {})[i] = [x for x in (text[:a], _element("a", word, href=ordered[k].url), text[z:]) if x != ""]
    for node in root.walk():
        if id(node) in changed:
            node.children = [x for i, c in enumerate(node.children) for x in changed[id(node)].get(i, [c])]
    if not done and most > 0:
        first = linker.first()
        again = _element("p", "Leia tambem: ")
        again.append(_element("a", first.label, href=first.url))
        paragraphs = root.all("p")
        if paragraphs:
            _insert_after(paragraphs[1] if len(paragraphs) > 1 else paragraphs[-1], again)
        else:
            (root.find("body") or root).append(again)
        done = [first.url]
    return root.inner(), done


def _texts(root: Node) -> list[tuple[Node, int]]:
    """Elements and places of the texts that may take a link, in the order of the page."""
    out: list[tuple[Node, int]] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, i = stack.pop()
        while i < len(node.children):
            c = node.children[i]
            i += 1
            if isinstance(c, str):
                out.append((node, i - 1))
            elif c.tag not in UNLINKED:
                stack += [(node, i), (c, 0)]
                break
    return out


# --- Images and videos -----------------------------------------------------


def image_key(url: str) -> str:
    return url.strip().rstrip("/").lower()


def _name_of(url: str) -> str:
    """A description made of a file's name."""
    name = re.sub(r"\.(jpg|jpeg|png|gif|webp)$", "", url.split("/")[-1].split("?")[0], flags=re.I)
    return re.sub("[-_]", " ", name).strip()


def _spread(paragraphs: list[Node], count: int) -> list[Node]:
    """The paragraphs after which so many elements stand evenly, first after the first one."""
    return [paragraphs[k * len(paragraphs) // count] for k in range(count)]


def _place(root: Node, new: list[Node], spread: bool) -> None:
    paragraphs = root.all("p")
    if not paragraphs:
        for node in new:
            (root.find("body") or root).append(node)
    elif spread:
        for at, node in reversed(list(zip(_spread(paragraphs, len(new)), new, strict=True))):
            _insert_after(at, node)
    else:
        for node in reversed(new):
            _insert_after(paragraphs[0], node)


def merge_images(markup: str | None, images: list[dict], most: int = 6, spread: bool = False) -> str:
    """The body with images (url, alt, caption) that it does not have, as figures after the first paragraph, or spread evenly over all.

    An image is there if one with the same URL is, case and a last slash aside, in a srcset too. A description is made of the file's name.
    """
    root = parse(markup)
    present = set()
    for img in root.all("img"):
        present |= {image_key(u) for u in [img.get("src"), *(c.split()[0] for c in img.get("srcset").split(",") if c.split())] if u}
    new = []
    for image in images:
        url = (image.get("url") or "").strip()
        key = image_key(url)
        if not key or key in present or len(new) >= most:
            continue
        present.add(key)
        alt = (image.get("alt") or "").strip() or _name_of(url)
        figure = Node("figure")
        figure.append(_element("img", src=url, alt=alt))
        figure.append(_element("figcaption", (image.get("caption") or "").strip() or alt or "Imagem"))
        new.append(figure)
    if new:
        _place(root, new, spread)
    return root.inner()


_VIDEO = re.compile(r"^https?://(?:(?:www\.|m\.)?youtube\.com/(?:embed/|shorts/|watch\?(?:[^#]*&)?v=)|(?:www\.)?youtu\.be/)([^/?&#\s]+)", re.I)


def video_id(url: str) -> str:
    m = _VIDEO.match(url.strip())
    return m[1] if m else ""


def merge_videos(markup: str | None, urls: list[str], most: int = 2, spread: bool = False) -> str | None:
    """The body with videos that it does not have, as paragraphs with their address."""
    if not urls:
        return markup
    root = parse(markup)
    present = {video_id(n.get("src")) for n in root.all("iframe")}
    # A paragraph in another can't be, so texts are read once.
    present |= {video_id(n.text()) for n in root.outermost(lambda n: n.tag in ("p", "a"))} | {video_id(n.text()) for n in root.outermost(lambda n: n.tag == "a")}
    wanted = [x for x in dict.fromkeys(video_id(u) for u in urls if u) if x and x not in present][:most]
    if wanted:
        _place(root, [_element("p", f"https://www.youtube.com/watch?v={x}") for x in wanted], spread)
    return root.inner()


# --- Figures ---------------------------------------------------------------

_URL_IN = re.compile(r"https?://[^\s\"'<>]+")


def fix_figures(markup: str | None, with_captions: bool = True) -> str | None:
    """Every image in a figure with a description and, if asked, a caption; figures without a usable image go.

    An address that holds markup is replaced by the first address in it, or its figure goes. A paragraph can't hold a figure, so one
    that comes to hold one becomes a div.
    """
    if not markup:
        return markup
    root = parse(markup)
    lost: set[int] = set()
    stack: list[tuple[Node, Node | None, Node | None]] = [(root, None, None)]
    while stack:
        node, figure, paragraph = stack.pop()
        children: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node) and c.tag == "img":
                src = c.get("src").strip()
                if "<" in src:
                    found = _URL_IN.search(src)
                    if not found:
                        lost.add(id(figure or c))
                        continue
                    c.attrs["src"] = src = found[0]
                c.attrs["alt"] = alt = c.get("alt") or "Imagem"
                if figure is None:
                    own = Node("figure")
                    own.parent = node
                    own.append(c)
                    if paragraph is not None:
                        paragraph.tag = "div"
                    if with_captions:
                        own.append(_element("figcaption", alt))
                    children.append(own)
                else:
                    children.append(c)
            else:
                children.append(c)
                if isinstance(c, Node):
                    stack.append((c, c if c.tag == "figure" else figure, c if c.tag == "p" else paragraph))
        node.children = children
    nodes = list(root.walk())
    image, caption = first_below(nodes, "img"), first_below(nodes, "figcaption")
    for figure in (n for n in nodes if n.tag == "figure"):
        img = image.get(id(figure))
        if img is None or not img.get("src").strip().startswith(("http://", "https://")):
            lost.add(id(figure))
        elif with_captions and id(figure) not in caption:
            figure.append(_element("figcaption", img.get("alt")))
    prune(root, lambda n: id(n) in lost)
    return root.inner()


def _words_of(nodes: list[Node]) -> dict[int, bool]:
    """Whether an element has any text."""
    some: dict[int, bool] = {id(n): any(isinstance(c, str) and c.strip() for c in n.children) for n in nodes}
    for n in reversed(nodes):
        if some[id(n)] and n.parent is not None and id(n.parent) in some:
            some[id(n.parent)] = True
    return some


def without_credits(markup: str | None) -> str | None:
    """Credit lines go, frames of videos become paragraphs with the address, other frames go, figures around nothing but that are undone."""
    if not markup:
        return markup
    root = parse(markup)
    starts: dict[int, str] = {}
    for n in reversed(list(root.walk())):
        text = ""
        for c in n.children:
            text += c if isinstance(c, str) else starts[id(c)]
            text = text.lstrip()
            if len(text) >= 10:
                break
        starts[id(n)] = text[:10]
    prune(root, lambda n: n.tag in ("figcaption", "p", "span") and starts[id(n)].lower().startswith(("crédito:", "credito:", "fonte:")))
    for node in root.walk():
        if any(isinstance(c, Node) and c.tag == "iframe" for c in node.children):
            children: list[Node | str] = []
            for c in node.children:
                if not (isinstance(c, Node) and c.tag == "iframe"):
                    children.append(c)
                elif video_id(c.get("src")) and "URL_DO_EMBED_AQUI" not in c.get("src"):
                    children.append(_element("p", f"https://www.youtube.com/watch?v={video_id(c.get('src'))}"))
                    children[-1].parent = node
            node.children = children
    nodes = list(root.walk())
    image, some = first_below(nodes, "img"), _words_of(nodes)
    for node in reversed(nodes):
        if not any(isinstance(c, Node) and c.tag == "figure" and id(c) not in image for c in node.children):
            continue
        children = []
        for c in node.children:
            inner = [x for x in c.children if isinstance(x, Node)] if isinstance(c, Node) and c.tag == "figure" and id(c) not in image else None
            if inner is not None and len(inner) == 1 and inner[0].tag == "p" and video_id(inner[0].text()):
                children.append(inner[0])
                inner[0].parent = node
            elif inner is not None and not some[id(c)]:
                for x in c.children:
                    children.append(x)
                    if isinstance(x, Node):
                        x.parent = node
            else:
                children.append(c)
        node.children = children
    some = _words_of(list(root.walk()))
    prune(root, lambda n: n.tag == "p" and not some[id(n)] and not any(isinstance(c, Node) for c in n.children))
    return root.inner()


# --- Last cleaning ---------------------------------------------------------

#: What gives away an image's raw description, and captions to put in its place by what it names.
RAW_CAPTION = (
    re.compile(r"\b(in front of|have tense meeting|looking at|sitting at|standing in|from season|in the \w+ season|as \w+ in|stares down|faces off|appears in|is seen in|talking to|walks through|arrives at|confronts)\b", re.I),
    re.compile(r"\b(homelander|butcher|hughie|starlight)\b.{0,40}\b(in|at|from|during|while|as)\b", re.I),
    re.compile(r"^[a-z][a-z0-9 '-]{0,120}$"),
)
INSTEAD = (
    (r"\bhomelander\b.*\bbutcher\b|\bbutcher\b.*\bhomelander\b", "Butcher e Homelander em cena de tensão na série The Boys."),
    (r"\bhomelander\b", "Homelander em momento decisivo da trama de The Boys."),
    (r"\bbutcher\b", "Billy Butcher retorna ao centro do conflito em The Boys."),
    (r"\bstarlight\b", "Starlight em cena da série The Boys."),
    (r"\bthe\s+boys\b", "Cena da série The Boys."),
    (r"\bstranger\s+things\b", "Cena da série Stranger Things."),
    (r"\bgame\s+of\s+thrones\b", "Cena da série Game of Thrones."),
    (r"\bhouse\s+of\s+the\s+dragon\b", "Cena da série House of the Dragon."),
    (r"\bstar\s+wars\b", "Cena do universo Star Wars."),
)
_SPELLED_IN = frozenset("p h2 h3 h4 li strong em blockquote span a".split())


def clean_caption(caption: str | None, title: str = "") -> str | None:
    """A caption fit for print, or None if it should go: internal credits off, raw descriptions replaced by what they name, names spelled."""
    text = re.sub(r"\s+via\s+RSSPRIME\s+Superfeed(?=\s*\.|\b)", "", (caption or "").strip(), flags=re.I)
    text = squeeze(re.sub(r"\s*Cr[eé]dito:\s*RSSPRIME\s+Superfeed\.?\s*$", "", text, flags=re.I))
    if not text:
        return None
    if not re.search(r"\bcr[eé]dito:\b", text, re.I):
        if len(text) < 12 or (len(text) > 140 and not re.search("[.,;!?]", text)):
            return None
        if any(p.search(text) for p in RAW_CAPTION):
            return next((said for p, said in INSTEAD if re.search(p, text, re.I) or (title and re.search(p, title, re.I))), None)
    return names.spelled(text, names.BODY_NAMES)[0]


def finish(markup: str | None, title: str | None = "") -> str | None:
    """Names spelled in texts of paragraphs, headings, lists and links; captions cleaned, repeated ones dropped. Attributes stay as they are."""
    if not markup:
        return markup
    root = parse(markup)
    for node in root.walk():
        if node.tag in _SPELLED_IN:
            node.children = [names.spelled(c, names.BODY_NAMES)[0] if isinstance(c, str) else c for c in node.children]
    seen: set[str] = set()
    gone: set[int] = set()
    for own in (c for f in root.outermost(lambda n: n.tag == "figure") for c in f.outermost(lambda n: n.tag == "figcaption")):
        text = own.text()
        key = squeeze(text).lower()
        said = clean_caption(text, title or "") if key not in seen else None
        seen.add(key)
        if said is None:
            gone.add(id(own))
        elif said != text:
            own.children = [said]
    prune(root, lambda n: id(n) in gone)
    return root.inner()


def images_stacked(markup: str | None) -> bool:
    """Whether two images follow each other with no text of more than 30 characters between."""
    root = parse(markup)
    nodes = list(root.walk())
    image = first_below(nodes, "img")
    size: dict[int, int] = {}
    for n in reversed(nodes):
        size[id(n)] = sum(len(c.strip()) if isinstance(c, str) else size[id(c)] for c in n.children)
    run = 0
    for n in nodes:
        if n.tag in ("figure", "img"):
            if n.tag == "img" and n.parent is not None and n.parent.tag == "figure":
                continue
            run += 1
        elif n.tag in ("p", "h2", "h3", "ul", "ol", "blockquote"):
            run = run + 1 if size[id(n)] <= 30 and id(n) in image else 0
        if run >= 2:
            return True
    return False


# --- Cutting ---------------------------------------------------------------


def cut(markup: str | None, most: int) -> str:
    """The body up to so many visible characters (white space squeezed), at a space where that costs little, all elements closed and none empty."""
    if not markup or most <= 0:
        return ""
    out, left = Node("#cut"), most
    stack: list[tuple[Node | str, Node]] = [(c, out) for c in reversed(parse(markup).children)]
    while stack and left > 0:
        node, into = stack.pop()
        if isinstance(node, str):
            text = re.sub(r"\s+", " ", node)
            if len(text) > left:
                text = text[:left]
                space = text.rfind(" ")
                text = (text[:space] if space >= max(1, int(left * 0.8)) else text).rstrip()
                left = 0
            if text:
                into.append(text)
            left = max(left - len(text), 0)
        elif node.tag not in ("script", "style", "noscript"):
            copy = Node(node.tag, node.attrs)
            into.append(copy)
            stack.extend((c, copy) for c in reversed(node.children))
    nodes = list(out.walk())
    filled: set[int] = set()
    for n in reversed(nodes):
        if n.tag in VOID or id(n) in filled or any(isinstance(c, str) for c in n.children):
            filled |= {id(n), id(n.parent)}
    prune(out, lambda n: id(n) not in filled)
    return out.inner()
