"""Named queries on finished bodies: links, images, videos, figures, credits, captions. The SQL writes the outcome as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import bodies
from quillspark.plans.catalogue import dealt, query, table
from quillspark.plans.rules import _pick


@query(r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[&<>]', ' ', 'g') as t from documents),
words as (select doc_id, lower(unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+'))) as w from d),
keys as (select item_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) as w from benchmark),
best as (select doc_id, arg_min(struct_pack(i := item_id, w := w), struct_pack(a := item_id % 3 > 0, b := item_id, c := -length(w), d := w)) as b from (select distinct doc_id, w from words) join (select distinct item_id, w from keys where length(w) >= 8) using (w) group by doc_id)
select doc_id, md5(case when b is null then '<p>' || t || '</p><p>Leia tambem: <a href="https://i.ex/0">Item 0</a></p>'
  else '<p>' || regexp_replace(t, '(?i)(^|[^\p{L}\p{N}_])' || b.w || '($|[^\p{L}\p{N}_])', '\1<a href="https://i.ex/' || b.i || '">' || b.w || '</a>\2') || '</p>' end) as digest, 'https://i.ex/' || coalesce(b.i, 0) as link
from d left join best using (doc_id)""")
def links_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a body of one paragraph, benchmark items as pages with their longer words as keywords, every third a pillar."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    name = F.col("item_id").cast("string")
    links = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("https://i.ex/"), name).alias("link"), F.concat(F.lit("Item "), name).alias("title"), F.array_sort(F.filter(words, lambda w: F.length(w) >= 8)).alias("keywords"),
        F.array().cast("array<int>").alias("categories"), (F.col("item_id") % 3 == 0).alias("pillar"), F.col("item_id").alias("position"),
    )
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[&<>]", " ")
    articles = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("html"))
    return bodies.link_bodies(articles, links).select("doc_id", F.md5(F.col("html").cast("binary")).alias("digest"), F.get("links", 0).alias("link"))


FIGURE = "'<figure><img src=\"' || u || '{n}\" alt=\"' || '{alt}' || '\"><figcaption>{cap}</figcaption></figure>'"


@query(rf"""with p as (select page_id, 'https://i.ex/' || page_id || '/' as u, '<p>um</p><img src="https://i.ex/' || page_id || '/A.jpg"><p>dois</p><p>tres</p><p>quatro</p>' as h from pages)
select page_id, replace(h, '<p>um</p>', '<p>um</p>' || {FIGURE.format(n="cena-do_filme.jpg", alt="cena do filme", cap="cena do filme")} || {FIGURE.format(n="b.png?x=1", alt="b", cap="Legenda")}) as after_first,
 replace(replace(h, '<p>um</p>', '<p>um</p>' || {FIGURE.format(n="cena-do_filme.jpg", alt="cena do filme", cap="cena do filme")}), '<p>tres</p>', '<p>tres</p>' || {FIGURE.format(n="b.png?x=1", alt="b", cap="Legenda")}) as spread,
 case page_id % 2 when 0 then '<p>um</p><p>https://www.youtube.com/watch?v=aaaaaaaaaa' || page_id % 10 || '</p><p><a>https://youtu.be/bbbbbbbbbbb</a></p>' else 'sem texto<p>https://www.youtube.com/watch?v=aaaaaaaaaa' || page_id % 10 || '</p><p>https://www.youtube.com/watch?v=bbbbbbbbbbb</p>' end as videos,
 page_id % 3 = 0 as stacked from p""")
def media_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of which one is there under other letters, twice, and without a name; videos of which one may be there."""
    u = F.concat(F.lit("https://i.ex/"), F.col("page_id").cast("string"), F.lit("/"))
    html = F.concat(F.lit('<p>um</p><img src="'), u, F.lit('A.jpg"><p>dois</p><p>tres</p><p>quatro</p>'))
    image = lambda name, alt, caption: F.struct(F.concat(u, F.lit(name)).alias("url"), F.lit(alt).alias("alt"), F.lit(caption).alias("caption"))
    images = F.array(image("a.JPG/", "", ""), image("cena-do_filme.jpg", None, ""), image("CENA-do_filme.jpg", "x", "y"), image("b.png?x=1", "b", "Legenda"), F.struct(F.lit(" ").alias("url"), F.lit("").alias("alt"), F.lit("").alias("caption")), image("c.jpg", "", ""))
    clip = F.concat(F.lit("https://www.youtube.com/embed/aaaaaaaaaa"), (F.col("page_id") % 10).cast("string"))
    clips = F.array(clip, F.lit("https://vimeo.com/1"), F.concat(clip, F.lit("?rel=0")), F.lit("https://youtube.com/shorts/bbbbbbbbbbb"))
    even = F.col("page_id") % 2 == 0
    plain = F.when(even, "<p>um</p><p><a>https://youtu.be/bbbbbbbbbbb</a></p>").otherwise("sem texto")
    row = F.when(F.col("page_id") % 3 == 0, '<p>x</p><figure><img src="a"></figure><p>curto <img src="b"></p>').otherwise('<img src="a"><p>um texto com mais de trinta letras seguidas</p><figure><img src="b"></figure>')
    return table(spark, sf_dir, "pages").select(
        "page_id",
        bodies.merge_images(most=2)(html, images).alias("after_first"),
        bodies.merge_images(most=2, spread=True)(html, images).alias("spread"),
        bodies.merge_videos()(plain, clips).alias("videos"),
        bodies.images_stacked(row).alias("stacked"),
    )


@query(r"""with p as (select p_partkey as id, p_name as n, 'https://i.ex/' || p_partkey || '.jpg' as u from part),
f as (select id, n, '<p>' || n || '</p><figure><img src="' || u || '" alt="Cena"><figcaption>Cena</figcaption></figure><figure><img src="https://i.ex/x.jpg" alt="Imagem"><figcaption>Imagem</figcaption></figure><figure><img src="' || u || '" alt="' || n || '"><figcaption>tem</figcaption></figure>' as h from p)
select id, h as fixed, h as again, '<div><p>' || n || '</p><p>https://www.youtube.com/watch?v=abcdefghijk</p> </div>' as credits, n || chr(10) || '<p class="mn-source-credit-line" style="margin:28px 0 0 0;padding-top:10px;border-top:1px solid rgba(127,127,127,0.18);font-size:12px;line-height:1.5;color:inherit;"><span style="font-weight:600;opacity:0.74;">Fontes:</span> '
 || '<a href="https://www.variety.com/a?b&amp;c=' || id || '" target="_blank" rel="noopener noreferrer nofollow" style="color:inherit;opacity:0.82;text-decoration:underline;text-decoration-color:rgba(127,127,127,0.45);text-underline-offset:2px;">Variety</a> '
 || '<a href="https://blog-x.ex/" target="_blank" rel="noopener noreferrer nofollow" style="color:inherit;opacity:0.82;text-decoration:underline;text-decoration-color:rgba(127,127,127,0.45);text-underline-offset:2px;">Blog X</a></p>' as credited,
 n || '<script>x</script>' as unmarked from f""")
def figures_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without figures, captions or descriptions, with addresses that are markup or none; credit lines; frames; JSON-LD of the source."""
    n, i = F.col("p_name"), F.col("p_partkey").cast("string")
    u = F.concat(F.lit("https://i.ex/"), i, F.lit(".jpg"))
    page = F.concat(
        F.lit("<p>"), n, F.lit('</p><img src="'), u, F.lit('" alt="Cena"><figure><img src="<figure><img src=https://i.ex/x.jpg>"></figure><figure><p>sem imagem</p></figure><figure><img src="/relativa.jpg"><figcaption>x</figcaption></figure>'),
        F.lit('<figure><img src="<b>nada</b>"></figure><figure><img src="'), u, F.lit('" alt="'), n, F.lit('"><figcaption>tem</figcaption></figure>'),
    )
    frames = F.concat(F.lit("<div><p>"), n, F.lit('</p><p> Crédito: alguém</p><figcaption>Fonte: x</figcaption><figure><iframe src="https://www.youtube.com/embed/abcdefghijk?x=1"></iframe></figure><iframe src="URL_DO_EMBED_AQUI"></iframe><figure> </figure><p> </p><iframe src="https://o.ex/"></iframe></div>'))
    once = bodies.fix_figures(page)
    fixed = dealt(spark, sf_dir, "part").select("p_partkey", "p_name", once.alias("fixed"), bodies.without_credits(frames).alias("credits"))
    sources = F.array(F.lit(" https://blog-x.ex/ "), F.lit(None).cast("string"), F.concat(F.lit("https://www.variety.com/a?b&c="), i), F.lit(""))
    return fixed.select(
        F.col("p_partkey").alias("id"),
        "fixed",
        bodies.fix_figures("fixed").alias("again"),
        "credits",
        bodies.with_credits(F.concat(n, F.lit(" \n ")), F.concat(F.lit("https://www.variety.com/a?b&c="), i), sources).alias("credited"),
        bodies.without_schemas(F.concat(n, F.lit("<script type='application/ld+json' id=x>{\n}</script><script>x</script>"))).alias("unmarked"),
    )


@query(r"""with p as (select p_partkey as id, p_name as n, p_partkey % 8 as k from part)
select id, '<p class="netflix">Na Netflix: ' || n || '</p><figure><img src="a"></figure>' || case k when 0 then '<figure><figcaption>Imagem de ' || n || ' aqui.</figcaption></figure>' when 1 then '<figure><figcaption>Cena do universo Star Wars.</figcaption></figure>' when 2 then '<figure><figcaption>Cena da série The Boys.</figcaption></figure>'
  when 3 then '<figure></figure>' when 4 then '<figure></figure>' when 5 then '<figure><figcaption>Foto da Marvel. Crédito: ' || n || '</figcaption></figure>' when 6 then '<figure><figcaption>O elenco da Netflix reunido.</figcaption></figure>' else '<figure><figcaption>Uma legenda: ' || n || '</figcaption></figure>' end || '<figure></figure>' as html from p""")
def bodies_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that stay, are replaced by what they or the title name, are raw, too short, carry a credit, or name someone in the wrong case; the last one repeats."""
    n, k = F.col("p_name"), (F.col("p_partkey") % 8).cast("int")
    captions = [F.concat(F.lit("Imagem de "), n, F.lit(" aqui.")), "Luke standing in a star  wars set", "Homem looking at o alvo", "raw words only", "Curta.", F.concat(F.lit("Foto da marvel. Crédito: "), n), "O elenco da NETFLIX reunido via RSSPRIME Superfeed.", F.concat(F.lit("Uma legenda: "), n)]
    caption = F.concat(F.lit("<figure><figcaption>"), _pick(k, captions), F.lit("</figcaption></figure>"))
    html = F.concat(F.lit('<p class="netflix">Na netflix: '), n, F.lit('</p><figure><img src="a"></figure>'), caption, caption)
    return dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), bodies.finish(html, F.when(k == 2, "Final de the boys").otherwise("Outro")).alias("html"))
