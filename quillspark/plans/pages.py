"""Named queries on pages: articles, JSON-LD, images. Pages are taken as they are, or Spark builds other markup around their texts.

The SQL finds the same by patterns that hold for these pages, or says where Spark put what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import json_ld
from quillspark.operators import extraction
from quillspark.plans.catalogue import query, table

#: Of a page: its article's markup, the words of some markup, its title as written.
ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
WORDS = r"len(regexp_extract_all(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&(amp|quot|lt|gt|copy|middot);?', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'))"
TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _title() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query(rf"""select page_id, 'article' as body_tag, {WORDS.format(x=ARTICLE)}::int as words, len(regexp_extract_all({ARTICLE}, '<p>'))::int as paragraphs, contains({ARTICLE}, '<h1>') as headline, false as menu, false as foot from pages""")
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extraction.extract(table(spark, sf_dir, "pages"))
    has = lambda x: F.contains("content", F.lit(x))
    return got.select("page_id", "body_tag", "words", F.expr("cast(size(regexp_extract_all(content, '(<p>)', 1)) as int)").alias("paragraphs"), has("<h1>").alias("headline"), has("<nav>").alias("menu"), has("<footer>").alias("foot"))


@query(rf"""select page_id, case page_id % 5 when 0 then 'article' when 2 then 'div' when 4 then 'main' else 'div' end as body_tag, {WORDS.format(x=ARTICLE)}::int as words, contains({ARTICLE}, '<h1>') as headline, false as related from pages""")
def article_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same article under other markup: with lists of related articles, in a named container, in the densest one, without a body element."""
    k = F.col("page_id") % 5
    own = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    related = '<section><h2>Leia também</h2><ul><li><a href="/x">Outro título zzq</a></li></ul></section><h3>Relacionadas</h3><ul><li>zzq</li></ul><a class="veja-mais">zzq</a><div class="ad-slot">zzq</div>'
    side = '<div class="sidebar"><p>zzq</p></div><div id="menu">' + '<a href="/p">um título zzq</a>' * 40 + "</div>"
    body = (
        F.when(k == 0, F.concat(F.lit("<article>"), own, F.lit(related + "</article>")))
        .when(k == 1, F.concat(F.lit('<div class="post-body"><div>'), own, F.lit(f"</div>{related}</div>")))
        .when(k == 2, F.concat(F.lit('<div><div itemprop="articleBody">'), own, F.lit(f"</div></div>{related}")))
        .when(k == 3, F.concat(F.lit('<div class="wrap"><div>'), own, F.lit("</div></div>")))
        .otherwise(F.concat(F.lit("<main>"), own, F.lit("</main>")))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav>" + side), body, F.lit('<div class="comments">nada</div><footer>fim</footer></body></html>')).alias("html"))
    got = extraction.extract(pages)
    has = lambda x: F.contains("content", F.lit(x))
    return got.select("page_id", "body_tag", "words", has("<h1>").alias("headline"), (has("Leia também") | has("Relacionadas") | has("zzq")).alias("related"))


@query(rf"""select page_id, case when page_id % 7 in (0, 1, 2, 3, 4) then {TITLE} end as headline, case page_id % 7 when 0 then 'NewsArticle' when 1 then 'Article' when 2 then 'BlogPosting' when 3 then 'NewsArticle' when 4 then 'Article' end as type,
 case page_id % 7 when 0 then 'https://i.ex/' || page_id || '.jpg' when 1 then 'https://i.ex/' || page_id || '.jpg' when 2 then 'https://i.ex/' || page_id || '.jpg' when 3 then 'https://i.ex/a.jpg' end as image,
 case page_id % 7 when 2 then 2 when 5 then 0 when 6 then 1 else 1 end::int as found, case page_id % 7 when 0 then 'https://i.ex/' || page_id || '.jpg' when 2 then 'https://i.ex/' || page_id || '.jpg' when 3 then 'https://i.ex/a.jpg' end as lead_image from pages""")
def json_ld_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles described by objects, lists, graphs, behind other nodes, with commas too many, in broken scripts, and deep inside another node."""
    k, title, image = F.col("page_id") % 7, _title(), F.concat(F.lit("https://i.ex/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    node = lambda kind, **more: F.to_json(F.struct(F.lit(kind).alias("@type"), title.alias("headline"), *[v.alias(n) for n, v in more.items()]))
    one = node("NewsArticle", image=image)
    listed = F.concat(F.lit('[{"@type": "WebSite", "image": null}, '), node("Article", image=F.array(F.struct(F.array(F.struct(image.alias("src"))).alias("url")))), F.lit(", ]"))
    # The first object has no name under headline, so its name is taken; a second article stands inside a list of the graph's last node.
    named = F.to_json(F.struct(F.lit("BlogPosting").alias("@type"), F.lit("").alias("headline"), title.alias("name"), F.struct(image.alias("url")).alias("image")))
    graph = F.concat(F.lit('{"image": {"url": "'), image, F.lit('"}, "@graph": [{"@type": "Person", "name": "x"}, '), named, F.lit(', {"@type": "ItemList", "items": [[{"item": {"@type": "Article"}}]]}]}'))
    scripts = [
        F.array(one),
        F.array(listed),
        F.array(graph),
        F.array(F.lit('{"image": ["https://i.ex/a.jpg", "https://i.ex/b.jpg"], "@type": "WebPage"}'), node("NewsArticle", image=F.array(F.lit("  "), F.lit("https://i.ex/a.jpg")))),
        F.array(F.lit("{broken"), node("Article")),
        F.array(F.lit('[1, "x", null, {"@type": ["Article"]}]'), F.lit('"NewsArticle"'), F.lit("")),
        F.array(F.concat(F.lit('{"@type": "WebPage", "mainEntity": '), node("Article"), F.lit("}"))),
    ]
    chosen = F.get(F.array(*scripts), k.cast("int"))
    marked = F.array_join(F.transform(chosen, lambda s: F.concat(F.lit('<script type="application/ld+json">'), s, F.lit("</script>"))), "")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(marked, "html").alias("html"))
    read = pages.select("page_id", "url", extraction.read_page("html", "url").alias("read"))
    found = read.select("page_id", json_ld.article_fields(F.col("read.json_ld")).alias("a"), F.size(json_ld.find_all(F.col("read.json_ld"))).alias("found"), extraction.lead_image(F.col("read"), F.col("url")).alias("lead_image"))
    return found.select("page_id", "a.headline", "a.type", "a.image", "found", "lead_image")


@query(r"""with p as (select page_id, 'https://i.ex/' || page_id as u, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, regexp_extract(url, '^([a-z]+://[^/?#]*/[^?#]*/)', 1) as folder from pages)
select page_id, case page_id % 3 when 0 then 'https://i.ex/og.jpg' when 1 then root || '/big.jpg' else folder || 'wide.jpg' end as lead_image,
 list_sort([u || 'a.jpg', u || 'b.jpg', root || '/c.jpg', u || 'd-1200x630.jpg', u || 'e.jpg', u || 'f.jpg'] || case page_id % 3 when 0 then [root || '/big.jpg', folder || 'wide.jpg'] when 1 then [folder || 'wide.jpg'] else [root || '/big.jpg'] end) as images,
 'Legenda de ' || page_id as caption, ['abcdefghij' || page_id % 10] as videos from p""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in every place that a page may name them, ornaments among them, captions, a shared or a largest image, and a video twice."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    u = F.concat(F.lit("https://i.ex/"), i)
    img = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    big = F.when(k == 1, "900").otherwise("10")
    wide = F.when(k == 2, "900").otherwise("10")
    body = img(
        '<figure><img src="', u, 'a.jpg"><figcaption> Legenda de <b>', i, '</b> </figcaption></figure><p>x</p><img data-src="', u, 'b.jpg" aria-hidden="false"><img src="/c.jpg"><img src="data:image/png;base64,AA"><img src="', u, 'a.jpg/">',
        '<picture><source srcset="', u, "x-20x20.jpg 20w, ", u, 'd-1200x630.jpg 1200w"></picture><noscript><img src="', u, 'e.jpg"></noscript><div style="background-image:url(\'', u, "f.jpg')\"></div>",
        '<img src="https://s.gravatar.com/', i, '.jpg"><img src="/avatar/x.jpg"><img aria-hidden="true" src="/z.jpg"><img src="https://i.ytimg.com/vi/abcdefghijk/hqdefault.jpg">',
        '<img src="/big.jpg" width="', big, '" height="500"><img src="wide.jpg" width="', wide, '" height="500">',
        '<iframe src="https://www.youtube.com/embed/abcdefghij', (F.col("page_id") % 10).cast("string"), '"></iframe><iframe src="https://youtu.be/abcdefghij', (F.col("page_id") % 10).cast("string"), '"></iframe><iframe src="https://other.ex/"></iframe>',
    )
    head = F.when(k == 0, '<meta property="og:image" content="https://i.ex/og.jpg">').otherwise('<meta property="og:image">')
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("<html><head>"), head, F.lit('</head><body><img src="/outside.jpg"><article>'), body, F.lit("</article></body></html>")).alias("html"))
    got = extraction.extract(pages)
    return got.select("page_id", "lead_image", "images", F.element_at("captions", F.concat(i, F.lit("a.jpg"))).alias("caption"), "videos")


@query(rf"""with p as (select page_id, {ARTICLE} as own from pages)
select page_id, case page_id % 8 when 0 then 'lance.com.br' when 1 then 'ge.globo.com' when 2 then 'comicbook.com' when 3 then 'screenrant.com' when 4 then 'gamerant.com' when 5 then 'collider.com' when 6 then 'variety.com' else 'hollywoodreporter.com' end as site,
 {WORDS.format(x="regexp_replace(own, '<h1>.*?</h1>', '')")}::int as words, false as dropped from p""")
def site_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same article in the markup of eight known sites, among what their cleaners drop; by each only the article's paragraphs are left."""
    from quillspark.functions import cleaners

    hosts = ["www.lance.com.br", "ge.globo.com", "comicbook.com", "screenrant.com", "gamerant.com", "collider.com", "variety.com", "hollywoodreporter.com"]
    k = (F.col("page_id") % 8).cast("int")
    # Without the headline, which a list of wanted elements leaves out.
    own = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<h1>.*?</h1>", "")
    junk = '<div class="show-multicontent-playlist-container">zzq</div><script>zzq</script>'
    widgets = '<script>zzq</script><div class="ad-box related-content gallery-x">zzq</div><section id="newsletter-widget">zzq</section><div><p>zzq</p><span>Thank you for reading, please subscribe</span></div><figure><img src="/logo.png"><figcaption>zzq</figcaption></figure><aside>zzq</aside>'
    listed = "<article>zzq <ul><li>zzq</li></ul><figure><img src='/i.svg'>zzq</figure><blockquote>zzq</blockquote>"
    body = (
        F.when(k == 0, F.concat(F.lit(listed), own, F.lit("<div>zzq</div></article>")))
        .when(k == 1, F.concat(F.lit('<article class="post-content">zzq</article><div class="materia-conteudo">'), own, F.lit(junk + "</div>")))
        .when(k < 4, F.concat(F.lit('<div class="article-body">zzq</div><article>zzq<div class="article-body"><div>'), own, F.lit(f"</div>{widgets}</div></article>")))
        .when(k == 4, F.concat(F.lit('<article>zzq<div id="article-body"><div>'), own, F.lit(f"</div>{widgets}</div></article>")))
        .when(k == 5, F.concat(F.lit('<article>zzq</article><div itemprop="articleBody"><div>'), own, F.lit(f"</div>{widgets}</div>")))
        .otherwise(F.concat(F.lit('<article>zzq</article><div class="c-content">zzq</div><div data-testid="article-body"><div>'), own, F.lit(f"</div>{widgets}</div>")))
    )
    host = F.get(F.array(*map(F.lit, hosts)), k)
    pages = table(spark, sf_dir, "pages")
    cleaned = pages.select("page_id", F.regexp_replace(host, "^www\\.", "").alias("site"), cleaners.clean_page(host, F.concat(F.lit("<body><header>zzq</header>"), body, F.lit("<footer>zzq</footer></body>"))).alias("c"))
    plain = F.regexp_replace(F.regexp_replace("c", "<[^>]*>", " "), "&(amp|quot|lt|gt|#x27);", " ")
    return cleaned.select("page_id", "site", F.size(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("words"), F.contains("c", F.lit("zzq")).alias("dropped"))
