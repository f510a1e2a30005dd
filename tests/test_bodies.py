"""Editing of bodies against plain versions and their own repetition."""

import random
import re
import time

import pytest

from quillspark.functions import body
from quillspark.functions.body import Link
from quillspark.functions.dom import parse

WORDS = ["alpha", "beta", "gamma", "delta", "alpha beta", "Beta Gamma", "omega", "sigma+"]


def plain_links(markup, links, categories, most):
    """Texts in order, pages in order, keywords in order: the search as it is stated, without a dictionary."""
    usable = [x for x in links if x.keywords and x.url]
    if not usable:
        return markup, []
    tier = lambda x: 0 if x.pillar else 1 if categories & x.categories else 2
    ordered = sorted(usable, key=lambda x: (tier(x), x.rank))
    root, done = parse(markup), []

    def visit(node):
        out = []
        for c in node.children:
            if not isinstance(c, str):
                if c.tag not in body.UNLINKED:
                    visit(c)
                out.append(c)
                continue
            for link in ordered if len(done) < most else []:
                if link.url in done:
                    continue
                hit = None
                for word in sorted(link.keywords, key=len, reverse=True):
                    pattern = r"(?<!\w)" + re.escape(word).replace(r"\ ", r"\s+") + (r"(?!\w)" if word[-1].isalnum() else "")
                    hit = re.search(pattern, c, re.I)
                    if hit:
                        break
                if hit:
                    done.append(link.url)
                    out += [x for x in (c[: hit.start()], body._element("a", word, href=link.url), c[hit.end() :]) if x != ""]
                    break
            else:
                out.append(c)
        node.children = out

    visit(root)
    return (root.inner(), done) if done else (None, None)


def test_links_equal_the_plain_search():
    rng = random.Random(1)
    seen = set()
    for _ in range(400):
        links = [Link(f"u{k}", f"T{k}" if rng.random() < 0.5 else "", tuple(rng.sample(WORDS, rng.randint(0, 3))), frozenset(rng.sample(range(4), rng.randint(0, 2))), rng.random() < 0.2, k) for k in range(rng.randint(0, 6))]
        text = lambda: " ".join(rng.choice([*WORDS, "x", "y", "alphabet", "BETA"]) for _ in range(rng.randint(0, 5)))
        markup = "".join(f"<{t}>{text()}<b>{text()}</b>{text()}</{t}>" for t in (rng.choice(["p", "p", "div", "h2", "a", "li", "blockquote"]) for _ in range(rng.randint(0, 5))))
        categories, most = frozenset(rng.sample(range(4), rng.randint(0, 2))), rng.choice([0, 1, 3, 6])
        want, urls = plain_links(markup, links, categories, most)
        got = body.add_links(markup, links, categories, most)
        if want is not None and urls is not None and (urls or not [x for x in links if x.keywords]):
            assert got == (want, urls), (markup, links)
            seen.add(len(urls))
        elif most and markup:
            assert len(got[1]) == 1 and "Leia tambem: " in got[0]
        assert all(got[1].count(u) == 1 for u in got[1]) and len(got[1]) <= max(most, 0) or not most
    assert seen >= {1, 2, 3}


def test_fallback_link():
    links = [Link("a", "A & b", ("zzz",), frozenset({1}), False, 0), Link("p", "", ("yyy",), frozenset(), True, 1), Link("c", "C", ("xxx",), frozenset({7}), False, 2)]
    assert body.add_links("<p>1</p><p>2</p><p>3</p>", links)[0] == '<p>1</p><p>2</p><p>Leia tambem: <a href="p">yyy</a></p><p>3</p>'
    assert body.add_links("<p>1</p>", links, frozenset({7}))[0] == '<p>1</p><p>Leia tambem: <a href="c">C</a></p>'
    assert body.add_links("text", links[:1])[0] == 'text<p>Leia tambem: <a href="a">A &amp; b</a></p>'
    assert body.add_links(None, links) == (None, []) and body.add_links("", links) == ("", []) and body.add_links("<p>x</p>", []) == ("<p>x</p>", [])


def test_links_of_a_large_table_are_the_same(spark):
    """The table sent whole, and searched for in blocks."""
    from quillspark.operators import bodies

    rng = random.Random(6)
    syllables = ["ba", "co", "di", "fu", "ge", "lo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(2))
    rows = [(f"https://x/{k}", f"T{k}", [" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 3))], [rng.randrange(5)], k % 9 == 4, k) for k in range(30)]
    links = spark.createDataFrame(rows + [(None, "t", ["ba"], [1], True, -1)], "link string, title string, keywords array<string>, categories array<int>, pillar boolean, position long")
    texts = ["<p>" + " ".join(word() for _ in range(rng.randint(0, 40))) + "</p><p>" + " ".join(word() for _ in range(20)) + "</p>" for _ in range(40)]
    articles = spark.createDataFrame([(i % 30, t, [i % 6], 5) for i, t in enumerate(texts + [None, "", "<p>zz</p>", "<p>zz</p>", texts[0]])], "id long, html string, cats array<int>, links int")
    whole = bodies.link_bodies(articles, links, "html", "cats", 3)
    assert whole.columns == ["id", "cats", "html", "links"]
    key = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    assert key(bodies.link_bodies(articles, links, "html", "cats", 3, block_bytes=60)) == key(whole)
    assert bodies.link_bodies(articles.limit(0), links).count() == 0 and bodies.link_bodies(articles, links.limit(0)).where("size(links) > 0").count() == 0


def test_media_are_put_in_once():
    images = [{"url": f"https://h/{k}.jpg", "alt": None, "caption": None} for k in range(5)]
    for n in range(0, 7):
        for spread in (False, True):
            once = body.merge_images("<p>x</p>" * n, images, 4, spread)
            assert body.merge_images(once, images[:4], 4, spread) == once
            assert [i.get("src") for i in parse(once).all("img")] == [f"https://h/{k}.jpg" for k in range(4)]
            if spread and n >= 4:
                assert "</figure><figure>" not in once
    assert body.merge_images(None, []) == "" and body.merge_images("<b>x</b>", [{"url": "a/b_c.png"}]) == '<b>x</b><figure><img src="a/b_c.png" alt="b c"><figcaption>b c</figcaption></figure>'
    videos = ["https://www.youtube.com/watch?v=abc", "https://youtu.be/abc", "https://m.youtube.com/watch?t=1&v=def", "x"]
    once = body.merge_videos("<p>1</p><p>2</p>", videos)
    assert once == "<p>1</p><p>https://www.youtube.com/watch?v=abc</p><p>https://www.youtube.com/watch?v=def</p><p>2</p>" and body.merge_videos(once, videos) == once
    assert body.merge_videos(None, []) is None and body.merge_videos(None, ["https://youtu.be/q"]) == "<p>https://www.youtube.com/watch?v=q</p>"


@pytest.mark.parametrize("edit", [body.fix_figures, body.without_credits, body.finish])
def test_a_second_time_changes_nothing(edit):
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<figure>", "</figure>", '<img src="https://h/a.jpg">', '<img src="x">', '<img src="<img src=https://h/b.jpg>" alt="q">', "<figcaption>Uma legenda da netflix.</figcaption>", "<figcaption>curta</figcaption>",
             "texto marvel ", "Fonte: x", '<iframe src="https://youtu.be/abcdefghijk"></iframe>', "<iframe></iframe>", "<div>", "</div>", "<span> Crédito: y</span>", "<b>z</b>"]
    for _ in range(500):
        markup = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        once = edit(markup)
        twice = edit(once)
        assert edit(twice) == twice, markup
        if edit is body.fix_figures:
            assert twice == once, markup
            for figure in parse(once).all("figure"):
                img = figure.find("img")
                assert img.get("src").startswith("https://") and img.get("alt") and figure.find("figcaption")
            assert all(n.tag == "figure" for n in parse(once).outermost(lambda n: n.tag in ("img", "figure")))
    assert edit(None) is None and edit("") == ""


@pytest.mark.parametrize("piece", ["<figure>", "<p>x", "<div><img src=https://h/a>", "<figure><img src=https://h/a>", "<span>", "<iframe src=x></iframe>", "<figure><figcaption>Uma legenda boa"])
def test_time_in_proportion(piece):
    links = [Link("u", "t", ("nowhere",))]

    def seconds(n):
        start = time.perf_counter()
        for edit in (body.fix_figures, body.without_credits, body.finish, body.images_stacked, lambda m: body.add_links(m, links), lambda m: body.merge_images(m, [{"url": "https://h/z.jpg"}]), lambda m: body.merge_videos(m, ["https://youtu.be/q"])):
            edit(piece * n)
        return time.perf_counter() - start

    seconds(300)
    small, large = seconds(1000), seconds(4000)
    assert large < 9 * small + 0.3, (small, large)


def test_captions():
    assert body.clean_caption("") is None and body.clean_caption(None) is None and body.clean_caption("Curta") is None and body.clean_caption("x" * 150) is None
    assert body.clean_caption("Foto via RSSPRIME Superfeed. Crédito: RSSPRIME Superfeed.") is None
    assert body.clean_caption("Homelander stares down Butcher") == "Butcher e Homelander em cena de tensão na série The Boys."
    assert body.clean_caption("someone looking at a thing", "Sobre Stranger Things") == "Cena da série Stranger Things."
    assert body.clean_caption("Cena de game of thrones, na hbo max.") == "Cena de Game of Thrones, na HBO Max."
