"""Named queries on images, repairs, titles and states of articles; the SQL states the outcome of every case plainly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import media, repair
from quillspark.operators import policy
from quillspark.plans.catalogue import query, table
from quillspark.plans.rules import _pick, _s


@query("""select p_partkey as id, case when p_partkey % 3 = 0 then null when p_size * 40 >= 300 then 'https://i.ex/b.jpg' else 'https://i.ex/a.jpg' end as url from part""")
def srcset_widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 3 == 0, " , ").otherwise(F.format_string("https://i.ex/a.jpg 300w,  https://i.ex/b.jpg %sw, https://i.ex/c.jpg, https://i.ex/d.jpg 2x", _s(F.col("p_size") * 40)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), media.widest(given).alias("url"))


@query("""select p_partkey as id, p_partkey % 10 in (0, 9) as usable, case when p_partkey % 10 in (0, 9) then p_partkey % 10 else 10 end as featured from part""")
def article_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [
        "https://i.ex/cena.jpg", "data:image/png;base64,AA", "https://s.gravatar.com/cena.jpg", "https://i.ex/avatar/cena.jpg", "https://i.ex/Banner-topo.jpg", "https://i.ex/cena.jpg?w=300", "https://i.ex/cena-150x150.jpg", "", "https://pixel.scorecardresearch.com/p",
        "https://i.ex/cena-1200x630.jpg",
    ]
    k = F.col("p_partkey") % 10
    url = _pick(k, forms)
    lead = media.featured(F.array(url, F.lit(forms[3]), F.lit("https://i.ex/ok.jpg")))
    place = F.when(lead == "https://i.ex/ok.jpg", 10).when(lead == url, k)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), media.usable(url).alias("usable"), place.cast("int").alias("featured"))


@query("""select p_partkey as id, '<h2 class="a">' || p_name || '</h2>' as headings, 'antes' || chr(10) || chr(10) || 'depois ' || p_name as lines, '<p>veja ' || p_name || ' aqui</p>' as tags, '<p>' || p_name || '</p>' as naked, (p_partkey % 3 > 0)::int + (p_partkey % 5 = 0)::int as padding from part""")
def body_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey")
    more = F.concat(F.when(k % 3 > 0, "Isso SUGERE algo. ").otherwise("Nada. "), F.when(k % 5 == 0, "Aqui o filme promete. O filme promete.").otherwise(""))
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        repair.second_heading(F.concat(F.lit('<H1 class="a">'), n, F.lit("</h1>"))).alias("headings"),
        repair.without_placeholders(F.concat(F.lit("antes\n[Imagem Destacada]\ndepois "), n)).alias("lines"),
        repair.without_tag_links(F.concat(F.lit('<p>veja <a class="x" href="https://www.portal.example/tag/a-b">'), n, F.lit("</a> aqui</p>")), "portal.example").alias("tags"),
        repair.without_naked_links(F.concat(F.lit("<p>"), n, F.lit("</p><p> https://portal.example/categoria/filmes/ </p>"))).alias("naked"),
        repair.padding(more).cast("int").alias("padding"),
    )


@query("""select p_partkey as id, case p_partkey % 6 when 0 then 'Um título bom: ' || p_name when 1 then 'Um título & bom: ' || p_name when 2 then 'Outro título: ' || p_name when 4 then repeat('palavra ', 10) || 'palavra' else '' end as title,
 case p_partkey % 6 when 0 then 'OK' when 1 then 'SANITIZED' when 2 then 'FALLBACK_USED' when 4 then 'SANITIZED' else 'INVALID' end as status from part""")
def final_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 6
    given = _pick(k, [F.concat(F.lit("Um título bom: "), n), F.concat(F.lit("<b>Um título</b>\n&amp; bom: "), n), "", "curto", F.lit("palavra " * 20), "Os filmes produzir algo novo"])
    other = F.when(k == 2, F.concat(F.lit("<i>Outro título:</i> "), n)).when(k == 3, "x")
    t = repair.final_title(given, other)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t["title"].alias("title"), t["status"].alias("status"))


@query("""select p_partkey as id, case p_partkey % 4 when 0 then repeat('uma frase nova ', 8) || p_name when 1 then repeat('o primeiro ', 10) || p_name when 2 then repeat('longo ', 35) || 'longo.' else '' end as subtitle,
 case p_partkey % 4 when 0 then 'OK' when 1 then 'REGENERATED' when 2 then 'REGENERATED' else 'MISSING' end as status from part""")
def final_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    new = F.concat(F.lit("uma frase nova " * 8), n)
    own = _pick(k, [new, "curta", new, "curta"])
    lead = _pick(k, [F.lit("x"), F.concat(F.lit("<p>" + "o primeiro " * 10), n, F.lit("</p>")), F.lit("longo " * 60), F.lit("curto")])
    meta = F.when(k == 2, F.concat(F.lit("Antes: "), new, F.lit(", e depois"))).otherwise("outra coisa")
    s = repair.final_subtitle(own, n, lead, meta)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), s["subtitle"].alias("subtitle"), s["status"].alias("status"))


@query("""select page_id as id, case page_id % 7 when 0 then 'Variety' when 1 then 'IGN' when 2 then 'G1' when 3 then 'Globo' when 4 then 'My Site X' when 5 then 'fonte original' else 'UOL' end as label from pages""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _pick(F.col("page_id") % 7, ["https://www.Variety.com/x", "https://br.ign.com/a", "https://g1.globo.com/", "https://esporte.globo.com/y", "https://my-site_x.org/p", "", "https://noticias.uol.com.br/z"])
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), repair.source_label(u).alias("label"))


@query("""select event_id as id, case when event_id % 10 < 6 then 'OK' when event_id % 10 < 8 then 'FORBIDDEN' else 'UNKNOWN' end as verdict from events""")
def state_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ["RECEIVED", " VALIDATED ", "INVALID", "DUPLICATE_DELIVERY", "REVISION_HASH_CONFLICT", "STALE_REVISION", "PUBLISHED", "LIVE", "received", ""]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), policy.state_verdict(_pick(F.col("event_id") % 10, given), policy.VALIDATION_STATES).alias("verdict"))
