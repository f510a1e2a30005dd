"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative,
each by a weight for its place (inside a link, a menu, a notice, a heading, a
paragraph ...), and one linear scan finds the contiguous run with the highest
sum. Weights are log odds learned from labelled pages: pages of the input whose
markup names one article or main region label their own tokens; where there are
none, the weights of FALLBACK hold. Blocks inside the run that are menus,
notices, forms or comments by name are left out.

Edge cases: a null or empty page, or one without visible words, has an empty
text; unclosed and unmatched tags are tolerated; texts are read whole; equal
pages give equal texts; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches

#: Pages whose tokens train the weights, at most.
MAX_TRAIN = 4000

#: Outside quotes a tag ends at the next < if no > comes before, so that no part of a page is looked at again and again.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*>|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<))|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that start and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never belong to the main text.
JUNK_TAGS = frozenset("nav footer aside form head header select button menu dialog".split())
#: Words of class, id or role that name a notice, an advert, a menu or comments.
JUNK_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead comment comments "
    "disqus respond replies cookie cookies consent notice newsletter subscribe signup login share sharing social related recommended popup modal widget contentinfo complementary search pagination pager".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
#: Attributes of an element that has no content; a slash that ends an unquoted value is part of it.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
#: An element that is open when one of these starts is closed first: omitted end tags.
_CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

#: Weights by place, as log odds; used as they are where no page is labelled.
FALLBACK = {"w:junk": -3.0, "w:link": -0.5, "w:heading": 1.0, "w:p": 1.0, "w:other": 0.2, "t:junk": -6.0, "t:a": -2.0, "t:li": -1.5, "t:p": -0.5, "t:inline": -0.5, "t:heading": -0.2, "t:block": -2.0}


def _is_junk(tag: str, attrs: str) -> bool:
    if tag in JUNK_TAGS:
        return True
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            if any(w in JUNK_WORDS for w in re.split(r"[\s_-]+", value)):
                return tag not in ("article", "main", "body", "html")
    return False


def tokens(page: str) -> tuple[list[tuple[str, int, str, int, bool]], bool]:
    """(place, words, text, block, inside a named main region) of each run of text and tag, and whether exactly one such region was named."""
    out: list[tuple[str, int, str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, junk, main
    opened: Counter[str] = Counter()  # how many of each element are open
    around: list[str] = []  # places of the open headings and paragraphs
    block, regions, junk, main, link = 0, 0, 0, 0, 0

    def pop() -> None:
        nonlocal junk, main, link
        tag, j, m = stack.pop()
        junk, main, link = junk - j, main - m, link - (tag == "a")
        opened[tag] -= 1
        if tag in HEADINGS or tag in PARAGRAPHS:
            around.pop()

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            text = m["text"]
            words = len(text.split())
            place = "w:junk" if junk else "w:link" if link else around[-1] if around else "w:other"
            out.append((place, words, text, block, main > 0))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if opened[tag]:
                was_junk = junk > 0
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in BLOCKS:
                continue
            else:
                was_junk = junk > 0
        else:
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                pop()
            if tag in BLOCKS and tag != "p" and stack and stack[-1][0] == "p":
                pop()
            j = _is_junk(tag, m["attrs"])
            is_main = tag in ("article", "main") and not junk
            if is_main and not main:
                regions += 1
            if tag not in VOID and not _CLOSED.search(m["attrs"]):
                stack.append((tag, j, is_main))
                opened[tag] += 1
                if tag in HEADINGS or tag in PARAGRAPHS:
                    around.append("w:heading" if tag in HEADINGS else "w:p")
                junk, main, link = junk + j, main + is_main, link + (tag == "a")
            was_junk = junk > 0
        if tag in BLOCKS:
            block += 1
        kind = "t:junk" if was_junk else "t:a" if tag == "a" else "t:li" if tag in ("li", "ul", "ol") else "t:p" if tag == "p" else "t:heading" if tag in HEADINGS else "t:block" if tag in BLOCKS else "t:inline"
        out.append((kind, 0, " " if tag == "br" else "", block, main > 0))
    return out, regions == 1


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the highest sum; of equal sums the first, and of those the longest to the left. Empty if no score is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def extract_text(page: str, weights: dict[str, float]) -> str:
    seq, _ = tokens(page)
    low, high = best_run([weights[place] * (words if place[0] == "w" else 1) for place, words, *_ in seq])
    blocks: dict[int, list[str]] = {}
    # A block that the run cuts is taken whole.
    if low < high:
        first, last = seq[low][3], seq[high - 1][3]
        for place, _, text, block, _ in seq:
            if first <= block <= last and text and place != "w:junk":
                blocks.setdefault(block, []).append(text)
    done = (" ".join(html_lib.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in done if x)


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from labelled pages; the driver gets two counts for each place."""
    spark = pages.sparkSession
    bound_batches(spark, rows=256)
    n = pages.count()
    share = int(min(1.0, MAX_TRAIN / max(n, 1)) * 1_000_000)
    sample = pages.where(F.pmod(F.xxhash64(html_col, F.lit(5)), F.lit(1_000_000)) < share).select(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                if page:
                    seq, labelled = tokens(page)
                    if labelled:
                        for place, words, _, _, inside in seq:
                            seen[(place, inside)] += words if place[0] == "w" else 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], ["place", "inside", "n"])

    got = sample.mapInArrow(run, "place string, inside boolean, n long").groupBy("place", "inside").agg(F.sum("n").alias("n")).collect()
    count = {(r.place, r.inside): r.n for r in got}
    if not count:
        return dict(FALLBACK)
    out = {}
    for place, held in FALLBACK.items():
        a, b = count.get((place, True), 0), count.get((place, False), 0)
        learned = math.log((a + 5) / (b + 5)) if a + b else held
        # Words outside junk may not score against themselves, nor tags for themselves: the method's signs.
        out[place] = min(learned, -1.0) if place == "w:junk" else min(learned, -0.05) if place[0] == "t" else max(learned, 0.05)
        if place in ("t:junk",):
            out[place] = min(out[place], -4.0)
    return out


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""
    bound_batches(pages.sparkSession, rows=256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(p, weights) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.select(id_col, url_col).dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
