"""The element tree and what is read from it."""

import random
import re
import time

import pytest

from quillspark.functions import article, dom
from quillspark.functions.dom import parse

PAGE = """<!doctype html><html><head><title> Tit &amp; le</title><meta property="og:title" content=""><meta name=description content="Desc"></head><body><header>menu</header>
<div class="wrap"><article><header>kicker</header><h1>Head</h1><p>Text one two.</p><figure><img data-src="a/B%20c.jpg?x=1" src=""><figcaption>The cat in the hat</figcaption></figure>
<div class="read-more">more</div><div data-img-url="/d.jpg">cap</div><section><h2>Leia também</h2><ul><li>x</li></ul></section><div><h2>a</h2><h3>b</h3><h4>Veja também</h4><ul><li>y</li></ul><p>stays</p></div>
<div><p>Director: A</p></div><ul><li>Release Date: 1</li><li>Runtime: 2</li></ul><p>Cast:</p><span>Your comment has not been saved</span><div class="broad">wide</div>
<blockquote class="twitter-tweet"><p>tweet</p><a href="https://x.com/u/status/77">l</a><script>s</script></blockquote><blockquote class="twitter-tweet"><a href="https://twitter.com/v/status/77">again</a></blockquote>
<div class="related"><blockquote class="twitter-tweet">Lost  post</blockquote></div></article></div><footer>f</footer></body></html>"""


@pytest.mark.parametrize("given, want", [
    ("<p>a<p>b<div>c</p>d", "<p>a</p><p>b</p><div>cd</div>"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<a href=x/>y</a><br/>z", '<a href="x/">y</a><br>z'),
    ("<script>if(a<b)</script>t<!-- x --> &amp; <b", "<script>if(a<b)</script>t &amp; <b></b>"),
    ('<p class="a b" id=q data-x>t</p>', '<p class="a b" id="q" data-x>t</p>'),
    ('<a b="<c>d', '<a b="&quot;"><c>d</c></a>'),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"),
    ("x < y <3", "x &lt; y &lt;3"),
    ('<div """ class=y>k</div>', '<div class="y">k</div>'),
    ("<h2>a<h3>b</h3>", "<h2>a</h2><h3>b</h3>"),
    ("</p>q<TITLE>a &amp; b</title>", "q<title>a &amp; b</title>"),
    (None, ""), ("", ""),
])
def test_tree(given, want):
    assert parse(given).inner() == want
    assert parse(want).inner() == want


def test_any_markup_gives_a_tree_that_reads_as_itself():
    rng = random.Random(7)
    parts = ["<p>", "</p>", "<div class='a'>", "</div>", "<ul>", "<li>", "</ul>", "x ", "&lt;", "<", ">", '"', "<br>", "<a href=\"q\">", "</a>", "<!--", "-->", "<h2>", "<td", " b=c", "<script>", "</script>", "é", "<b/>"]
    for _ in range(800):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        once = parse(page).inner()
        assert parse(once).inner() == once, page
        for node in parse(page).walk():
            assert all(isinstance(c, str) or c.parent is node for c in node.children)


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<div>x", "</p><b>", "<li>", "<!--", "<p>", "< ", "<script>", '<a    "  ', "<h2>Leia também</h2><p>x</p>", "<h2>Leia também</h2>", "<section><h2>a</h2>", "<ul><li>Runtime: x", "<figure><img src=a>",
                                   "<div class=a><p>", "<blockquote class=twitter-tweet>x", "<figcaption>the cat", "<span>", "<picture><source srcset=a>", "<div data-img-url=a>", "<a><p>x"])
def test_reading_takes_time_in_proportion(piece):
    """Malformed and deep pages: four times the page takes well under sixteen times as long."""
    def seconds(n: int) -> float:
        start = time.perf_counter()
        article.read(piece * n, "http://a.b/")
        return time.perf_counter() - start

    seconds(500)
    small, large = seconds(1500), seconds(6000)
    assert large < 9 * small + 0.3, (piece, small, large)


def test_a_page_is_read():
    got = article.read(PAGE, "https://s.com/p/q")
    assert (got["title"], got["excerpt"], got["body_tag"]) == ("Tit & le", "Desc", "article")
    assert got["images"] == ["https://s.com/p/a/B%20c.jpg?x=1", "https://s.com/d.jpg"]
    assert got["captions"] == {"b c.jpg": "The cat in the hat", "/p/a/b c.jpg": "The cat in the hat", "d.jpg": "cap", "/d.jpg": "cap"}
    text = dom.squeeze(parse(got["content"]).text())
    assert text == "Head Text one two. The cat in the hat cap a b stays Director: A tweet l again Lost post"
    assert got["words"] == len(re.findall(r"\w+", text))
    assert got["content"].count("status/77") == 2 and "<script>" not in got["content"]


def test_bodies_in_order():
    body = lambda page: article.find_body(parse(page))
    assert body('<div class="post-content"><p>x</p></div><article>y</article>').tag == "article"
    assert body('<div class="post-body"><p>1</p></div><div class="article-body"><p>1</p><p>2</p></div>').named.strip() == "article-body"
    assert body('<div class="article-body sidebar"><p>1</p><p>2</p></div><section itemprop="articleBody">x</section>').tag == "section"
    links = "<ul>" + "<li><a href=x>many words in this link here</a></li>" * 30 + "</ul>"
    assert body(f'<body><div id=a>{links}</div><div><div id=b><p>{"plain words " * 20}</p><p>{"more words " * 20}</p></div></div></body>').get("id") == "b"
    assert body("<body><main></main></body>").tag == "main" and body("").tag == "#root"


def test_captions_in_english():
    assert article.likely_english("The star of the show") and article.likely_english("Tom Holland as Peter Parker in the film")
    assert not article.likely_english("O ator no filme de ação") and not article.likely_english("Tom Holland") and not article.likely_english("")
    root = parse('<figure><img src="/i/A.jpg"><figcaption>This is the end</figcaption></figure><figure><img src="b.jpg"><figcaption>Uma cena de ação do filme</figcaption></figure>')
    assert article.blank_english_captions(root, "http://h/") == {"a.jpg": "This is the end", "/i/a.jpg": "This is the end"}
    assert root.inner().count("<figcaption></figcaption>") == 1 and "Uma cena de ação do filme" in root.inner()


def test_widest_and_absolute():
    assert article.widest("a.jpg 300w, b.jpg 900w, c.jpg 900w, d.jpg 2x") == "c.jpg" and article.widest(" , ") == ""
    assert article.absolute("https://a/b.jpghttps://c/d.jpg", "http://h/") == "https://c/d.jpg"
    assert article.absolute("data:x", "http://h/") == "" and article.absolute("http://[", "http://h/") == "" and article.absolute("&amp;x", "http://h/p/") == "http://h/p/&x"
    assert dom.squeeze(" a\n b ") == "a b"


def test_sites_and_their_fallback():
    long = "<p>" + "word " * 160 + "</p>"
    page = f'<head><title>t</title></head><body><article><div class="article-body"><h1>Top</h1><p>short but own text here</p></div></article><section><p>{long}</p></section></body>'
    own = article.read(f'<article><div class="article-body">{long}</div></article>', "https://www.collider.com/a")
    assert (own["site"], own["body_tag"], own["words"]) == ("collider.com", "div", 160)
    # Few words of the site's own, but the generic reader takes the article too and finds no more.
    assert article.read(page, "https://collider.com/a")["site"] == "collider.com"
    # The container is a small box elsewhere; the generic reader finds the article.
    boxed = f'<article>{long}</article><div class="article-body"><p>box</p></div>'
    got = article.read(boxed, "https://collider.com/a")
    assert got["site"] is None and got["words"] == 160
    movie = article.read(f'<article><h1>Real title</h1>{long}<iframe src="https://youtu.be/abcdefghijk"></iframe></article>', "https://movieweb.com/x")
    assert movie["title"] == "Real title" and movie["videos"] == ["abcdefghijk"] and movie["site"] == "movieweb.com"
    for piece in ("<figure>", "<div><p>read more", "<ul><li>x", "<blockquote>word"):
        start = time.perf_counter()
        article.read("<article>" + piece * 8000, "https://movieweb.com/x")
        article.read("<article>" + piece * 8000, "https://collider.com/x")
        assert time.perf_counter() - start < 20, piece


def test_odd_pages_through_spark(spark):
    from quillspark.operators import extraction

    rows = [(None, None, None, 1), (1, "", "", 1), (1, "not a url", "<p>x", 1), (2, "http://[", "<article>" + "<p>word</p>" * 50_000, 1), (2, "http://h/", PAGE, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, words int")
    got = extraction.extract(pages).collect()
    assert sorted((r.words for r in got)) == [0, 0, 1, 20, 50_000]
    assert extraction.extract(pages.limit(0)).count() == 0


def test_batches_of_pages_are_bounded(spark):
    """A worker gets few pages at once, whatever the table; a smaller bound stays."""
    from quillspark.operators import bodies, extraction
    from quillspark.plans import catalogue
    from quillspark.session import BATCH

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.range(2).selectExpr("id as page_id", "'https://i.ex/' as url", "'<p>x</p>' as html")
    links = spark.createDataFrame([("https://i.ex/1", "x", ["abc"], [], False, 1)], "link string, title string, keywords array<string>, categories array<int>, pillar boolean, position int")
    for run in (lambda: extraction.extract(pages), lambda: bodies.link_bodies(pages, links), lambda: catalogue.table(spark, "/root/testdata/sf0.001", "pages")):
        for before, after in (("10000", BATCH), ("0", BATCH), ("7", "7")):
            spark.conf.set(name, before)
            run()
            assert spark.conf.get(name) == after
