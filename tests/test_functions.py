"""Column expressions on single values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import canonical, html, ids, similarity, text, urls, values


@pytest.fixture(scope="module")
def one(spark):
    def call(expr, *args):
        cols = [F.lit(a) if not isinstance(a, list) else F.array(*[F.lit(x) for x in a]) for a in args]
        cols = [c.cast("string") if a is None else c for c, a in zip(cols, args)]
        return spark.range(1).select(expr(*cols).alias("v")).first()["v"]

    return call


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com//a///b/?q=1#x", "example.com/a/b"),
        ("http://example.com", "example.com/"),
        ("https://example.com/a+b%20c/", "example.com/a+b c"),
        ("https://example.com/%zz", "example.com/%zz"),
        ("", ""),
        (None, ""),
        ("https://user@WWW.Ex.com:8080/P", "ex.com/p"),
    ],
)
def test_canonical(one, url, want):
    assert one(urls.canonical, url) == want


def test_urls(one):
    assert one(urls.domain, "https://www.A.b/x") == "a.b"
    assert [one(urls.acceptable, u) for u in ("http://a.b", "ftp://a.b", "https://", "no", None)] == [True, False, False, False, False]
    assert one(urls.registrable, "https://br.variety.example/x") == "variety.example"
    want = hashlib.sha1(b"a.b/x|c.d/").hexdigest()
    assert one(urls.cluster_signature, ["https://c.d", "http://www.a.b/x/"]) == want
    assert one(urls.youtube_id, "https://youtu.be/abcdefghijk") == "abcdefghijk"
    assert one(urls.youtube_id, "https://x.com") is None
    assert [one(urls.large_enough, u) for u in ("https://a/i-300x200.jpg", "https://a/i.jpg?width=1200&height=800", "https://a/i.jpg", "https://a/i-2000x400.jpg")] == [False, True, True, False]


def test_sentences_keep_digits_that_equal_their_place(one):
    assert one(text.sentences, "0 a. 1 b1. 23.5 c2! ") == ["0 a.", "1 b1.", "23.5 c2!"]
    assert one(text.sentences, " a.  b ") == ["a.", "b"]


def test_text(one):
    assert one(text.title_key, ' "Olá", Mundo!  É ') == "olá mundo é"
    assert one(text.comparison_key, "«Estreia Confirmada.» ") == "estreia confirmada"
    assert one(text.paragraph_key, "Ação, e R$ 5!") == "acao e r 5"
    assert one(text.heading_key, "  Ação:  Já ") == "acao: ja"
    assert one(text.block_key, "Série_ TV") == "serie-tv"
    assert one(text.fold, "Straße") == "strasse"
    assert one(text.overlap, "a b c", "b c d") == 0.5
    assert one(text.overlap, "", "b") == 0.0
    assert one(text.sentences, "A b. C d! E?F") == ["A b.", "C d!", "E?F"]
    assert one(text.slug, "Olá, Mundo: 'tudo' bem?") == "ola-mundo-tudo-bem"
    assert [one(text.is_slug, s) for s in ("a-b1", "A", "-a", "")] == [True, False, False, False]
    assert one(text.tags, [" A ", "a", "", "b", "x" * 61]) == ["A", "b"]
    cut = one(lambda t: text.at_boundary(t, 10), "palavra um dois")
    assert (cut["text"], cut["truncated"]) == ("palavra…", True)
    assert one(lambda t: text.link_tokens(t, ["para"]), "Para o São Paulo são 12 ab") == ["sao", "paulo"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("em 5 de março de 2026", "2026-03-05"), ("2026-13-40", None), ("12/07/2026", "2026-07-12"), ("July 4, 2026", "2026-07-04"), ("julho de 2026", "2026-07"), ("2026-07", "2026-07"), ("em 2026", "2026"), ("nada", None), (None, None)],
)
def test_dates(one, raw, want):
    got = one(values.normal_date, raw)
    assert got == want or (raw == "2026-13-40" and got == "2026")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("R$ 2,5 milhões", "BRL 2500000"), ("35%", "35%"), ("1,5 milhão", "1500000"), ("90 minutos", "90 minutos"), ("US$ 1,234.5", "USD 1234.5"), ("1.234", "1234"), ("nada", None), ("$ 3 billion", "USD 3000000000"), ("0,5%", "0.5%")],
)
def test_numbers(one, raw, want):
    assert one(values.normal_number, raw) == want


def test_conflicts(one):
    assert one(values.dates_conflict, "2026-07", "2026-07-29") is False
    assert one(values.dates_conflict, "2026-07-29", "2026-08-05") is True
    assert one(values.numbers_conflict, "BRL 5", "USD 6") is False
    assert one(values.numbers_conflict, "5 horas", "6 horas") is True
    assert one(values.numbers_conflict, "5", "5") is False
    assert one(values.whole, "x") == -1 and one(values.whole, "") is None and one(values.whole, " 7 ") == 7
    assert one(values.flag, "Sim") is True and one(values.flag, "não") is False and one(values.flag, "?") is None


def test_instants(one):
    same = {one(values.instant, t) for t in ("2026-01-02T03:04:05Z", "2026-01-02T03:04:05+00:00", "2026-01-02T00:04:05-03:00", "2026-01-02T03:04:05")}
    assert same == {"2026-01-02T03:04:05Z"}
    assert one(values.instant, "soon") == "soon"


def test_canonical_hash(one):
    a = {"event_key": "k", "sources": [{"url": "b"}, {"url": "a"}], "first_seen": "2026-01-02T03:04:05Z", "cursor": "1", "metadata": {"n": [2, 1]}}
    b = {"metadata": {"n": [2, 1]}, "sources": [{"url": "a"}, {"url": "b"}], "first_seen": "2026-01-02T00:04:05-03:00", "cursor": "2", "payload_hash": "x", "event_key": "k"}
    hashes = [one(canonical.payload_hash, json.dumps(x)) for x in (a, b, {**a, "metadata": {"n": [1, 2]}})]
    assert hashes[0] == hashes[1] != hashes[2]
    want = '{"event_key":"k","first_seen":"2026-01-02T03:04:05Z","metadata":{"n":[2,1]},"sources":[{"url":"a"},{"url":"b"}]}'
    assert hashes[0] == hashlib.sha256(want.encode()).hexdigest()
    assert one(canonical.canonical_json, "{") is None


def test_ids(one):
    seed = "event:k|rev:2"
    assert one(lambda k: ids.draft_id(k, F.lit(None), F.lit(None), F.lit(2)), "k") == "draft-" + hashlib.sha256(seed.encode()).hexdigest()[:32]
    assert one(lambda k: ids.draft_id(k, F.lit(None), F.lit(None), F.lit(1)), None) is None
    assert one(lambda k: ids.idempotency_key(k, F.lit("h"), F.lit("")), "d") is None
    assert one(lambda a: ids.conflict_id(F.lit("T"), F.lit("s"), a, a), ["x", "y"]) == one(lambda a: ids.conflict_id(F.lit("T"), F.lit("s"), a, a), ["y", "x"])


def test_similarity_and_html(one):
    assert one(similarity.ratio, "abcd", "abcd") == 1.0 and one(similarity.ratio, "", "a") == 0.0
    assert one(html.visible_text, "<p>A &amp; <b>b</b></p><script>x</script>") == "A & b"
    assert one(html.unescape, "&eacute;&amp;") == "é&"
    clean = one(html.sanitise, '<p onclick="x()">Hi <a href="javascript:y">z</a><script>bad</script><iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe></p>')
    assert "onclick" not in clean and "javascript" not in clean and "bad" not in clean and "watch?v=abcdefghijk" in clean
    assert one(html.truncate_visible(8), "<p>um <b>dois tres</b></p><p>x</p>").startswith("<p>um <b>dois") and one(html.truncate_visible(8), "<p>a</p>") == "<p>a</p>"
    o = one(html.outline, '<h2>T</h2><img src="a"><img src="b"><p>x</p><a href="/l">l</a>')
    assert o["links"] == ["/l"] and o["headings"][0]["text"] == "T" and o["stacked_images"]


def test_cleaners(spark):
    from quillspark.functions import cleaners

    page = '<body><nav>m</nav><div class="article-body"><p>One <b>two</b></p><div class="widget"><p>no</p></div><aside>no</aside><script>no</script><p>Three &amp; four</p></div><p>out</p></body>'
    rows = spark.createDataFrame([("www.collider.com", page), ("x.lance.com.br", page.replace('div class="article-body"', "article")), ("other.com", page)], "h string, p string")
    got = [r.v for r in rows.select(cleaners.clean_page("h", "p").alias("v")).collect()]
    assert got[0].count("<p>") == 2 and "no" not in got[0] and "out" not in got[0] and "Three &amp; four" in got[0]
    assert "<div" not in got[1] and "One" in got[1] and got[2] is None

    inside = '<h1>Head</h1><p class="read-more">gone by ad- pattern</p><p>A first paragraph with words.</p><figure><img src="/a-logo.png"></figure><figure><img src="/a.jpg?w=300"></figure><figure><p>none</p></figure><figure><img src="/good.jpg"><figcaption>The end of the film</figcaption></figure>'
    inside += '<div class="related-content">r</div><div id="Sidebar">s</div><div data-is-tag-interaction="1">t</div><div data-stnl-x="1">u</div><div><p>kept outer</p><p>Please subscribe to us</p></div><blockquote class="twitter-tweet"><p>A post that is long enough</p></blockquote><ul><li>item</li></ul><svg></svg>'
    for host, want in {
        "comicbook.com": "Head A first paragraph with words. A post that is long enough item",
        "screenrant.com": "Head A first paragraph with words. A post that is long enough item",
        "static.gamerant.com": "Head A first paragraph with words. u A post that is long enough item",
        "collider.com": "Head A first paragraph with words. u A post that is long enough item",
        "variety.com": "Head A first paragraph with words. t u A post that is long enough item",
        "www.hollywoodreporter.com": "Head A first paragraph with words. t u A post that is long enough item",
        "movieweb.com": "A first paragraph with words. A post that is long enough item",
        "lance.com.br": "gone by ad- pattern A first paragraph with words. none The end of the film kept outer Please subscribe to us A post that is long enough",
    }.items():
        page = f'<body><article><section class="article-body">{inside}</section></article></body>'
        tree = cleaners.parse(cleaners.cleaned(page, host))
        text = tree.text()
        assert text == want, (host, text)
        images = [i.get("src") for i in tree.all("img")]
        assert images == (["/a-logo.png", "/a.jpg?w=300", "/good.jpg"] if host == "lance.com.br" else ["/good.jpg"]), host
    ge = cleaners.cleaned('<article class="post-content"><p>later</p></article><div class="x materia-conteudo"><div class="video-player">v</div><p>one</p><div id="gm-widget-mais-escalados-root">w</div><script>s</script></div>', "ge.globo.com")
    assert ge == '<div class="x materia-conteudo"><p>one</p></div>'
    assert cleaners.cleaned("<p>no container</p>", "movieweb.com") is None and cleaners.cleaned(None, "ge.globo.com") is None
    assert cleaners.cleaned('<div class="popup"><article><p>long enough for a paragraph</p></article></div>', "movieweb.com") is None
