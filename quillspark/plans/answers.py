"""Named queries on models' answers, editorial types and sources without a cursor; rows are built so that every kind of damage occurs, the SQL states what each comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import comparison_key
from quillspark.operators import policy, responses, revisions
from quillspark.plans.catalogue import dealt, query, table
from quillspark.plans.rules import _pick

_GIVEN = [
    '{"resultados": [{"t": "~"}]}', 'Aqui está:\n```json\n{"t": "~"}\n```\nfim', '[{"t": "~"},]', '{"resultados": [{"t": "<a href="/x">~</a>, "b"", "u": 1} {"t": "2"}]}', '{"t": "linha\n~\x01", "u": [1, 2,],}',
    '{"t": "c:\\dir ~"}', "sem objeto ~", '{"t": "~"} {"t": "', '{"resultados": 5}', '{"t": [{"u": "~"}, {"v',
]


@query("""select p_partkey as id, case when p_partkey % 11 in (6, 8, 10) then null when p_partkey % 11 = 3 then 2 else 1 end as n, case p_partkey % 11 when 0 then p_name when 1 then p_name when 2 then p_name when 3 then '<a href="/x">' || p_name || '</a>, "b"'
 when 4 then 'linha' || chr(10) || p_name when 5 then 'c:\\dir ' || p_name when 7 then p_name end as t, coalesce(p_partkey % 11 in (3, 4, 5, 6, 9), false) as mended from part""")
def response_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(_pick(F.col("p_partkey") % 11, _GIVEN), F.lit("~"), F.col("p_name"))
    rows = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), responses.results(text).alias("r"))
    listed = F.from_json("r.results", "array<struct<t:string>>")
    return rows.select("id", F.when(F.col("r.results").isNotNull(), F.size(listed)).alias("n"), F.get(listed["t"], F.lit(0)).alias("t"), "r.mended")


@query("""select p_partkey as id, case when p_partkey % 5 = 4 then null when p_partkey % 5 in (0, 3) then p_name end as title, case p_partkey % 5 when 0 then '' when 3 then 'sub' end as subtitle, p_partkey % 5 <> 4 as counted from part""")
def response_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = '{"titulo_final": "~", "conteudo_final": "<p>x</p>", "meta_description": null, "focus_keyphrase": "", "tags_sugeridas": ["a"], "yoast_meta": {"k": 1}'
    forms = [full + ', "subtitle": null}', full + ', "erro": "recusado"}', '{"titulo_final": "~"}', full + ', "subtitle": "sub"}', full + "}, 7"]
    listed = F.concat(F.lit("["), F.replace(_pick(F.col("p_partkey") % 5, forms), F.lit("~"), F.col("p_name")), F.lit("]"))
    b = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), responses.batch(listed, F.lit(1)).alias("b"))
    first = F.get("b", F.lit(0))
    return b.select("id", first["titulo_final"].alias("title"), first["subtitle"].alias("subtitle"), F.col("b").isNotNull().alias("counted"))


@query("""select p_partkey as id, case when p_partkey % 4 = 3 then null else p_name end as title, case p_partkey % 4 when 0 then 'a' when 1 then 'b' when 2 then '' end as body, case when p_partkey % 4 = 0 then 'x' end as other from part""")
def response_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ['{"titulo_final": "~", "title": "z", "content": "a", "other": "x"}', '{"titulo_final": "", "titulo": "~", "conteudo_final": [], "conteudo": "", "body": "b"}', '{"titulo_final": null, "headline": "~", "conteudo_final": ""}', '{"slug": "s"}']
    given = F.replace(_pick(F.col("p_partkey") % 4, forms), F.lit("~"), F.col("p_name"))
    m = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), responses.recovered(F.from_json(given, "map<string,string>")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("id", at("titulo_final").alias("title"), at("conteudo_final").alias("body"), at("other").alias("other"))


@query("""select p_partkey as id, case p_partkey % 4 when 2 then null when 3 then 0 else 1 end as n, case when p_partkey % 4 = 0 then '2024-03-05' end as value, case when p_partkey % 4 = 0 then 'DATE' when p_partkey % 4 = 1 then 'OTHER' end as claim_type,
 case p_partkey % 4 when 0 then '' when 1 then 'CLAIM_TYPE_UNKNOWN:COISA,CLAIM_CONFIDENCE_OUT_OF_RANGE,CLAIM_MISSING_FIELDS:1:claim_type,location' when 3 then 'CLAIM_NOT_FOUND_IN_DRAFT,CLAIM_ITEM_NOT_OBJECT:1,CLAIMS_TRUNCATED:3>2' end as warnings from part""")
def response_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = '{"display_text": "A obra ~ estreia", "claim_type": "date", "location": ["title", ""], "value": "05/03/2024", "confidence": 0.5}'
    forms = [
        '```json\n{"claims": [' + date + ", " + date + "]}\n```", '{"claims": [{"display_text": "a OBRA ~", "claim_type": "coisa", "location": "title", "confidence": 7}, {"display_text": "x"}]}', '{"claims": 3', '{"claims": [' + date.replace("obra", "outra") + ", 5, {}]}",
    ]
    raw = F.replace(_pick(F.col("p_partkey") % 4, forms), F.lit("~"), F.col("p_name"))
    draft = comparison_key(F.concat(F.lit("Hoje: a obra "), F.col("p_name"), F.lit(" estreia.")))
    a = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), responses.claim_answer(F.lit("d"), draft, raw, 2).alias("a"))
    first = F.get("a.claims", F.lit(0))
    return a.select("id", F.when(F.col("a").isNotNull(), F.size("a.claims")).alias("n"), first["value"].alias("value"), first["claim_type"].alias("claim_type"), F.array_join("a.warnings", ",").alias("warnings"))


@query("""select p_partkey as id, ['listicle', 'guide', 'news', 'news', 'listicle', 'review', 'opinion_like', 'analysis', 'news'][p_partkey % 9 + 1] as kind from part""")
def editorial_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 9, F.col("p_name")
    words = F.repeat(F.concat(n, F.lit(" ")), _pick(k, [0, 0, 40, 40, 40, 40, 40, 900, 0]))
    title = _pick(k, ["Os 5 melhores filmes", "Guia para assistir", "Os 5 melhores filmes", "Guia para assistir", "Sem sinal", "Resenha do filme", "Minha opini\u00e3o: uma resenha", "Sem sinal", None])
    body = F.when(k == 4, "<h2>1. a</h2><h2 class='x'><b>2)</b> b</h2><h2>c</h2><H2> 3: d</H2>").when(k == 3, "<h2>1. a</h2><h2>2. b</h2><h2>3. c</h2>").otherwise("")
    return dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), policy.editorial_type(title, words, body).alias("kind"))


@query("""select source_id, cursor, case when source_id % 3 = 0 then 'unavailable' else 'active' end as cursor_mode from (select s_suppkey as source_id, case when s_suppkey % 2 = 0 then s_name end as cursor from supplier) where source_id % 2 = 0 or source_id % 3 = 0""")
def cursor_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.lit("v1").alias("contract_version"), F.col("s_name").alias("cursor"), F.lit("active").alias("cursor_mode"))
    marked = s.where("source_id % 3 = 0")
    return revisions.without_cursor(s.where("source_id % 2 = 0"), marked.unionAll(marked)).drop("contract_version")
