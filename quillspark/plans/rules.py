"""Named queries on validation, normalisation, identity, gate, claim and delivery rules.

Their rows are built from the test tables so that each case of a rule occurs, many times and with other values; the SQL
states the outcome of every case plainly and shares nothing with the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import canonical, ids, text, urls, values
from quillspark.operators import contract, delivery, factual, gate, qa, state
from quillspark.plans.catalogue import dealt, query, table
from quillspark.session import spread

MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def _pick(k: Column, given: list) -> Column:
    """The k-th of some values, from 0."""
    return F.get(F.array(*[F.lit(x) if not isinstance(x, Column) else x for x in given]), k.cast("int"))


def _orders(spark: SparkSession, sf_dir: str, cases: int) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % cases).cast("int").alias("k"), F.col("o_orderdate").alias("d"))


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- dates, numbers, wire values --------------------------------------------


@query("select o_orderkey as id, case when o_orderkey % 5 = 4 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as value from orders")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, year, month = _s(F.dayofmonth("d")), _s(F.year("d")), F.element_at(F.array(*map(F.lit, MONTHS)), F.month("d"))
    forms = [F.concat(F.lit("em "), day, F.lit(" de "), month, F.lit(" de "), year), F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "MMMM d, yyyy"), F.date_format("d", "yyyy-MM-dd"), F.concat(month, F.lit(" de "), year)]
    return _orders(spark, sf_dir, 5).select("id", values.normal_date(_pick(F.col("k"), forms)).alias("value"))


@query("select o_orderkey as id, o_orderkey % 5 in (2, 4) as clash from orders")
def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c, f="yyyy-MM-dd": F.date_format(c, f)
    other = [d("d"), d("d", "yyyy-MM"), d(F.date_add("d", 40)), d("d", "yyyy"), _s(F.year("d") + 1)]
    return _orders(spark, sf_dir, 5).select("id", values.dates_conflict(d("d"), _pick(F.col("k"), other)).alias("clash"))


@query("""select p_partkey as id, case p_partkey % 6 when 0 then 'BRL ' || (p_size::bigint * 1000000) when 1 then p_size || '%' when 2 then p_size || ' minutos' when 3 then 'USD ' || p_size || '500.25'
 when 4 then 'USD ' || (p_size::bigint * 1000000000) end as value from part""")
def normalize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _s("p_size")
    forms = [F.concat(F.lit("cerca de R$ "), n, F.lit(" milhões")), F.concat(n, F.lit("%")), F.concat(n, F.lit(" minutos")), F.concat(F.lit("US$ "), n, F.lit(",500.25")), F.concat(F.lit("$ "), n, F.lit(" billion")), "nada"]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), values.normal_number(_pick(F.col("p_partkey") % 6, forms)).alias("value"))


@query("select p_partkey as id, p_partkey % 5 in (1, 3) as clash from part")
def number_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, more = F.col("p_partkey") % 5, _s("p_size"), _s(F.col("p_size") + 1)
    brl = lambda x: F.concat(F.lit("BRL "), x)
    hours = lambda x: F.concat(x, F.lit(" horas"))
    left = _pick(k, [brl(n), brl(n), brl(n), hours(n), n])
    right = _pick(k, [brl(n), brl(more), F.concat(F.lit("USD "), more), hours(more), n])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), values.numbers_conflict(left, right).alias("clash"))


@query("""select event_id, case event_id % 8 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then true when 6 then false when 7 then true end as flag,
 case event_id % 8 when 0 then 7 when 1 then -1 when 3 then 12 when 4 then -3 when 5 then -1 when 6 then 0 when 7 then 99 end as whole,
 case event_id % 3 when 0 then 1.5::double when 1 then -20::double end as real from events""")
def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 8
    flag = values.flag(_pick(k, ["Sim", "não", "TRUE", "0", "yes", "?", "", " y "]))
    whole = values.whole(_pick(k, [" 7 ", "x", "", "12", "-3", "1.5", "0", "99"]))
    return table(spark, sf_dir, "events").select("event_id", flag.alias("flag"), whole.alias("whole"), values.real(_pick(F.col("event_id") % 3, ["1.5", " -2e1", ""])).alias("real"))


@query("select o_orderkey as id, strftime(o_orderdate + to_seconds(o_orderkey % 86400) + (case when o_orderkey % 4 = 2 then interval 3 hour else interval 0 hour end), '%Y-%m-%dT%H:%M:%SZ') as value from orders")
def utc_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format(F.expr("d + make_dt_interval(0, 0, 0, id % 86400)"), "yyyy-MM-dd'T'HH:mm:ss")
    return _orders(spark, sf_dir, 4).select("id", values.instant(F.concat(at, _pick(F.col("k"), ["Z", "+00:00", "-03:00", ""]))).alias("value"))


# --- identities and keys ------------------------------------------------------


@query("""select p_partkey as id, 'claim-' || left(sha256('draft:d' || p_partkey || '|type:NUMBER|subject:' || p_brand || '|predicate:|value:' || p_size || '|text:' || p_name), 32) as claim_id,
 'ev-' || left(sha256('url:https://e.x/' || p_partkey || '|excerpt:' || p_name), 32) as evidence_id, 'link-' || left(sha256('claim:a' || p_partkey || '|evidence:' || p_brand || '|relation:SUPPORTS'), 32) as link_id,
 'conflict-' || left(sha256('type:DATE_CONFLICT|subject:' || p_brand || '|values:1,2|claims:a,b'), 32) as conflict_id, 'fa-' || left(sha256('draft:d' || p_partkey || '|version:v1|hash:' || p_brand), 32) as assessment_id,
 sha256('a|b|' || lower(p_brand)) as strings_hash, p_partkey % 3 = 0 as is_hash from part""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, brand, name = _s("p_partkey"), F.col("p_brand"), F.col("p_name")
    d = F.concat(F.lit("d"), key)
    values_ = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("2"), F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        ids.claim_id(d, F.lit("NUMBER"), brand, F.lit(""), _s("p_size"), name).alias("claim_id"),
        ids.evidence_id(F.concat(F.lit("https://e.x/"), key), name).alias("evidence_id"),
        ids.link_id(F.concat(F.lit("a"), key), brand, F.lit("SUPPORTS")).alias("link_id"),
        ids.conflict_id(F.lit("DATE_CONFLICT"), brand, values_, F.array(F.lit("b"), F.lit("a"))).alias("conflict_id"),
        ids.assessment_id(d, F.lit("v1"), brand).alias("assessment_id"),
        ids.hash_of(F.array(F.lit(" b"), F.lower(brand), F.lit("a "))).alias("strings_hash"),
        ids.is_sha256(F.when(F.col("p_partkey") % 3 == 0, F.sha2(name, 256)).when(F.col("p_partkey") % 3 == 1, F.md5(name)).otherwise(F.upper(F.concat(F.md5(name), F.md5(name))))).alias("is_hash"),
    )


@query("""select o_orderkey as id, sha256('{"event_key":"k' || o_orderkey || '","first_seen":"' || strftime(o_orderdate + interval 3 hour, '%Y-%m-%dT%H:%M:%SZ') || '","metadata":{"n":[2,1]},"sources":[{"url":"a"},{"url":"b"}]}') as digest from orders""")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatile fields, the order of keys and of sources, and the offset of a time say nothing."""
    seen = F.concat(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00"))
    payload = F.format_string('{"sources":[{"url":"b"},{"url":"a"}],"cursor":"%s","metadata":{"n":[2,1]},"payload_hash":"x","first_seen":"%s","event_key":"k%s"}', _s("k"), seen, _s("id"))
    return _orders(spark, sf_dir, 7).select("id", canonical.payload_hash(payload).alias("digest"))


@query("""with p as (select p_partkey as id, 100 + p_size * 40 as w, 300 + p_partkey % 400 as h from part)
select id, w as width, h as height, w >= 600 and h >= 315 and w / h between 0.6 and 2.2 as large, case when id % 2 = 0 then 'abcdefghi' || lpad((id % 100)::varchar, 2, '0') end as video from p""")
def image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _s(100 + F.col("p_size") * 40).alias("w"), _s(300 + F.col("p_partkey") % 400).alias("h"))
    suffix, asked = F.format_string("https://i.ex/a-%sx%s.jpg", "w", "h"), F.format_string("https://i.ex/a.jpg?w=%s&height=%s", "w", "h")
    url = F.when(F.col("id") % 2 == 0, suffix).otherwise(asked)
    video = F.concat(_pick(F.col("id") % 4, ["https://youtu.be/", "https://vimeo.com/", "https://www.youtube.com/watch?t=1&v=", "https://youtube.com/user/"]), F.lit("abcdefghi"), F.lpad(_s(F.col("id") % 100), 2, "0"))
    size = urls.dimensions(url)
    return p.select("id", size["width"].alias("width"), size["height"].alias("height"), urls.large_enough(url).alias("large"), urls.youtube_id(video).alias("video"))


@query("""with p as (select p_partkey as id, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) as n from part)
select id, 'ola-' || replace(n, ' ', '-') || '-cia' as slug, id % 2 = 0 as valid, 'acao: ' || n as heading, 'serie-' || replace(n, ' ', '-') as block, n as comparison from p""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    made = text.slug(F.concat(F.lit("Olá, "), n, F.lit(" & Cia!")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        made.alias("slug"),
        text.is_slug(F.when(F.col("p_partkey") % 2 == 0, made).otherwise(F.concat(made, F.lit("-")))).alias("valid"),
        text.heading_key(F.concat(F.lit("  AÇÃO:  "), n)).alias("heading"),
        text.block_key(F.concat(F.lit("Série_ "), n)).alias("block"),
        text.comparison_key(F.concat(F.lit("«"), F.initcap(n), F.lit(".» "))).alias("comparison"),
    )


# --- contract -------------------------------------------------------------------


@query("""select o_orderkey as id, case o_orderkey % 9 when 0 then '' when 1 then 'INVALID_SOURCE_COUNT' when 2 then 'INVALID_EVENT_KEY,INVALID_REVISION' when 3 then 'INVALID_EVENT_DATES'
 when 4 then 'MISSING_CLUSTER_CONFIDENCE,MISSING_CURSOR' when 5 then 'INVALID_MULTI_SOURCE_FLAG' when 6 then 'INVALID_TITLE,INVALID_TOPIC,UNKNOWN_CONTRACT_VERSION'
 when 7 then 'DUPLICATE_SOURCE_URL,MULTIPLE_PRIMARY_SOURCES,SOURCE_AUTHOR_UNKNOWN,SOURCE_DATE_UNKNOWN' when 8 then 'INVALID_CLUSTER_CONFIDENCE,NO_PRIMARY_SOURCE' end as codes, o_orderkey % 9 in (0, 4) as valid from orders""")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, nil = F.col("k"), F.lit(None).cast("string")

    def source(site: str, author: Column, primary: Column) -> Column:
        url = F.format_string(f"https://www.{site}/%s", _s("id"))
        return F.struct(nil.alias("source_id"), nil.alias("name"), F.lit(site).alias("domain"), url.alias("url"), nil.alias("title"), author.alias("author"), author.alias("published_at"), nil.alias("source_type"), primary.alias("is_primary"))

    sources = F.when(k == 7, F.array(*[source("a.com", nil, F.lit(True))] * 2)).otherwise(F.array(source("a.com", F.lit("x"), k != 8), source("b.com", F.lit("x"), F.lit(False))))
    first = F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    events = _orders(spark, sf_dir, 9).select(
        "id",
        F.when(k == 6, "v9").otherwise("rss-prime-event-v1").alias("contract_version"),
        F.when(k == 2, " ").otherwise(F.concat(F.lit("k"), _s("id"))).alias("event_key"),
        F.when(k == 2, 0).otherwise(1).alias("revision"),
        F.when(k == 6, "").otherwise("movies").alias("topic"),
        F.when(k != 6, F.lit("T")).alias("title"),
        first.alias("first_seen"),
        F.date_format(F.date_add("d", 1), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_later"),
        (k != 5).alias("is_multi_source"),
        F.when(k == 1, 3).otherwise(2).alias("source_count"),
        F.when(k == 4, F.lit(None)).when(k == 8, 1.5).otherwise(0.5).cast("double").alias("cluster_confidence"),
        F.when(k != 4, F.lit("c")).alias("cursor"),
        sources.alias("sources"),
        nil.alias("metadata"),
        nil.alias("payload_hash"),
        F.when(k == 3, F.lit("1980-01-01T00:00:00Z")).alias("_early"),
    )
    checked = contract.validate(events.withColumn("last_seen", F.coalesce("_early", "_later")))
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("issues", lambda i: i["code"]))), ",")
    return checked.select("id", codes.alias("codes"), "valid")


@query("""select event_id, case event_id % 7 when 0 then 'V1' when 1 then 'UNKNOWN_CONTRACT_VERSION' when 2 then 'LEGACY' else 'MALFORMED_PAYLOAD' end as route,
 case event_id % 7 when 0 then 'rss-prime-event-v1' when 1 then 'v9' end as version, event_id % 7 = 2 as legacy from events""")
def payload_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pick(F.col("event_id") % 7, ['{"contract_version":"rss-prime-event-v1"}', '{"contractVersion":" v9 "}', '{"event_key":"k"}', '{"has_superfeed_meta":false}', "{", '{"x":1}', '{"all_sources":""}'])
    return table(spark, sf_dir, "events").select("event_id", contract.route(p).alias("route"), contract.version(p).alias("version"), contract.is_legacy(p).alias("legacy"))


@query("""select page_id as id, 1 as revision, 'legacy-feed-input-v0' as contract_version, 3 as source_count, true as is_multi_source, url || ' https://b.com/2 https://c.com/3' as urls, 'A  ' as names, 1 as primaries from pages""")
def legacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    nil = F.lit(None).cast("string")
    given = table(spark, sf_dir, "pages").select(F.lit("T").alias("title"), F.lit("m").alias("topic"), _s("page_id").alias("event_key"), "url", F.concat(F.lit("https://b.com/2|, "), F.col("url"), F.lit(",https://c.com/3")).alias("urls"), F.lit("A").alias("all_sources"), nil.alias("first_seen"), nil.alias("last_seen"))
    joined = lambda f: F.array_join(F.transform("sources", lambda s: F.coalesce(s[f], F.lit(""))), " ")
    return contract.adapt_legacy(given).select(F.col("event_key").cast("long").alias("id"), "revision", "contract_version", "source_count", "is_multi_source", joined("url").alias("urls"), joined("name").alias("names"), F.size(F.filter("sources", lambda s: s["is_primary"])).alias("primaries"))


# --- gate -------------------------------------------------------------------------


@query("""with d as (select doc_id as i, doc_id % 31 <> 0 as cited, doc_id % 29 <> 0 as filled from documents),
r as (select i, list_filter([case when i % 2 = 0 then 'GATE_MISSING_TITLE' end, case when not filled then 'GATE_MISSING_BODY' end, case when not cited then 'GATE_MISSING_SOURCES' end, case when filled and i % 3 = 0 then 'GATE_UNSAFE_HTML' end,
 case when i % 23 = 0 then 'GATE_BLOCKING_ERRORS_PRESENT' end, case when i % 37 = 0 then 'GATE_MISSING_PROVENANCE' end, case when i % 41 = 0 then 'GATE_INVALID_REVISION_CONTEXT' end, case when i % 43 = 0 then 'GATE_UNSUPPORTED_TOPIC' end,
 case when cited and i % 47 = 0 then 'GATE_NO_SUCCESSFUL_EXTRACTION' end, case when i % 53 = 0 then 'GATE_MATERIAL_CLAIM_UNSUPPORTED' end, case when i % 59 = 0 then 'GATE_CRITICAL_FACT_CONFLICT' end], lambda x: x is not null) as b,
 list_filter([case when not filled then 'GATE_CONTENT_TOO_THIN' end, case when i % 5 = 0 then 'GATE_SUBTITLE_ISSUE' end, case when i % 7 = 0 then 'GATE_MISSING_META_DESCRIPTION' end, case when cited and i % 11 = 0 then 'GATE_SOURCE_DIVERSITY_LOW' end,
 case when cited and i % 4 = 0 and i % 47 <> 0 then 'GATE_EXTRACTION_WARNINGS' end, case when i % 13 = 0 then 'GATE_REVISION_GAP' end, case when i % 17 = 0 then 'GATE_MISSING_PROMPT_VERSION' end, case when i % 19 = 0 then 'GATE_LEGACY_INPUT_CONTRACT' end,
 case when i % 6 = 0 then 'GATE_UNVERIFIED_MEDIA' end, case when i % 61 = 0 then 'GATE_FACTUAL_COVERAGE_LOW' end, case when i % 67 = 0 then 'GATE_PARTIAL_SUPPORT_PRESENT' end, case when i % 71 = 0 then 'GATE_UNVERIFIED_CLAIMS_PRESENT' end,
 case when i % 73 = 0 then 'GATE_EVIDENCE_MISSING' end, case when i % 79 = 0 then 'GATE_EVIDENCE_CONFLICT' end, case when cited and i % 83 = 0 then 'GATE_SOURCE_ORIGIN_DIVERSITY_LOW' end], lambda x: x is not null) as w,
 list_filter([case when cited and i % 11 <> 0 then 'GATE_MULTI_SOURCE' end, case when i % 19 <> 0 then 'GATE_V1_INPUT_CONTRACT' end, 'GATE_LOCAL_OUTPUT_ONLY'], lambda x: x is not null) as n from d)
select i::varchar as draft_id, case when len(b) > 0 then 'BLOCKED' when len(w) > 0 then 'REVIEW_REQUIRED' else 'CLEAR' end as outcome, array_to_string(list_sort(b), ',') as blocking, array_to_string(list_sort(w), ',') as warnings, array_to_string(list_sort(n), ',') as info from r""")
def gate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, nil = F.col("doc_id"), F.lit(None).cast("string")
    hit = lambda n: i % n == 0
    body = F.when(hit(29), "").otherwise(F.concat(F.lit("<p>" + "palavra " * 400 + "</p>"), F.when(hit(3), "<script>1</script>").otherwise("")))
    strings = "array<string>"
    content = F.struct(
        F.when(~hit(2), F.lit("T")).alias("title"), body.alias("body_html"), F.when(~hit(5), F.lit("S")).alias("subtitle"), nil.alias("summary"), F.when(~hit(7), F.lit("M")).alias("meta_description"), nil.alias("slug_suggestion"),
        F.when(hit(43), F.array(F.lit("Politica"))).otherwise(F.array().cast(strings)).alias("category_suggestions"), F.array().cast(strings).alias("tag_suggestions"),
    )

    def source(url: Column, domain: Column, status: Column) -> Column:
        return F.struct(url.alias("url"), nil.alias("source_id"), nil.alias("name"), domain.alias("domain"), nil.alias("title"), status.alias("extraction_status"), F.lit(False).alias("is_primary"))

    none = "array<struct<url:string,source_id:string,name:string,domain:string,title:string,extraction_status:string,is_primary:boolean>>"
    two = F.array(
        source(F.lit("https://a.com/1"), F.lit("a.com"), F.when(hit(47), "FETCH_ERROR").when(hit(4), "PARTIAL").otherwise("OK")),
        source(F.when(hit(11), "https://a.com/2").otherwise("https://b.com/2"), F.when(hit(11), "a.com").otherwise("b.com"), F.when(hit(47), "FETCH_ERROR").otherwise("OK")),
    )
    one = lambda n, x: F.when(hit(n), F.array(F.lit(x))).otherwise(F.array().cast(strings))
    media = F.array(F.struct(F.when(hit(6), "unverified").otherwise("verified").alias("status")))
    provenance = F.struct(
        F.when(~hit(37), F.lit("a")).alias("input_hash"), F.lit("b").alias("output_hash"), F.lit("1").alias("pipeline_version"), F.lit("c").alias("commit_sha"), F.when(hit(19), "legacy-feed-input-v0").otherwise("rss-prime-event-v1").alias("input_contract_version"),
        F.lit("k").alias("input_event_key"), F.lit("h").alias("input_payload_hash"), F.when(hit(41), 2).otherwise(1).alias("input_revision"), F.when(~hit(17), F.lit("p")).alias("prompt_version"),
    )
    number = lambda n, yes, no=0: F.when(hit(n), F.lit(yes)).otherwise(F.lit(no))
    drafts = dealt(spark, sf_dir, "documents").select(
        _s("doc_id").alias("draft_id"), F.lit("k").alias("event_key"), F.lit(1).alias("revision"), content.alias("content"), F.when(hit(31), F.array().cast(none)).otherwise(two).alias("sources"), F.array().cast("array<struct<status:string>>").alias("evidence"),
        media.alias("media_candidates"), one(13, "REVISION_GAP: 2").alias("warnings"), one(23, "x").alias("blocking_errors"), provenance.alias("provenance"),
        F.lit(4).alias("material"), number(73, 0, 2).alias("supporting_links"), number(79, 1).alias("conflicting"), F.lit(0).alias("conflicts"), number(67, 1).alias("partially_supported"), number(71, 1).alias("unverified"),
        number(61, 0.5, 0.9).alias("coverage_ratio"), number(83, 1, 3).alias("origins"), number(53, 1).alias("critical_unsupported"), number(59, 1).alias("critical_conflicts"),
    )
    joined = lambda c: F.array_join(c, ",").alias(c)
    return gate.evaluate(drafts).select("draft_id", "outcome", joined("blocking"), joined("warnings"), joined("info"))


# --- claims -------------------------------------------------------------------------


@query("""select o_orderkey as id, case o_orderkey % 5 when 0 then 'UNSUPPORTED' when 1 then 'SUPPORTED' when 2 then 'PARTIALLY_SUPPORTED' when 3 then 'CONFLICTING' else 'UNVERIFIED' end as status,
 case o_orderkey % 5 when 1 then 2 when 2 then 1 when 3 then 1 else 0 end as origins from orders""")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = _orders(spark, sf_dir, 5).select("id", "k", F.lit("d").alias("draft_id"), _s("id").alias("claim_id"))
    relations = _pick(F.col("k"), [F.lit(""), F.lit("SUPPORTS a,PARTIALLY_SUPPORTS b,MENTIONS c"), F.lit("PARTIALLY_SUPPORTS a,PARTIALLY_SUPPORTS a"), F.lit("SUPPORTS a,CONTRADICTS b"), F.lit("MENTIONS a")])
    rows = claim.where("k > 0").select("draft_id", "claim_id", F.explode(F.split(relations, ",")).alias("r"))
    link = rows.select("draft_id", "claim_id", F.split("r", " ")[0].alias("relation"), F.split("r", " ")[1].alias("origin"))
    return factual.statuses(claim, link).select("id", "status", "origins")


@query("""select o_orderkey as id, case o_orderkey % 4 when 0 then 'SUPPORTS' when 1 then 'CONTRADICTS' when 2 then 'MENTIONS' end as relation from orders where o_orderkey % 4 < 3""")
def evidence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on a cost against an excerpt with the same, another or no number; the fourth excerpt is about something else and gives no link."""
    o = spread(_orders(spark, sf_dir, 4), "id").withColumn("n", 2 + F.col("id") % 90)
    cost = lambda n: F.format_string("Aurora custou R$ %s milhões ao estúdio", _s(n))
    claim = o.select(_s("id").alias("draft_id"), _s("id").alias("claim_id"), cost(F.col("n")).alias("display_text"), F.lit("aurora").alias("normalized_subject"), F.lit("NUMBER").alias("claim_type"), F.format_string("BRL %s000000", _s("n")).alias("value"))
    said = _pick(F.col("k"), [cost(F.col("n")), cost(F.col("n") + 1), F.lit("Aurora teve custo alto segundo o estúdio"), F.lit("Outra obra estreia em breve")])
    excerpt = o.select(_s("id").alias("draft_id"), F.concat(F.lit("e"), _s("id")).alias("evidence_id"), said.alias("excerpt"), text.comparison_key(said).alias("normalized_excerpt"), F.lit("PRIMARY").alias("strength"), F.lit("a.com").alias("origin"))
    link = factual.links(claim, excerpt)
    return link.join(factual.orphans(link, claim, excerpt).select("link_id"), "link_id", "left_anti").select(F.col("claim_id").cast("long").alias("id"), "relation")


@query("""with o as (select o_custkey as c, o_orderkey as k, (o_orderkey % 3)::varchar as v from orders), p as (select x.c, x.k as a, y.k as b from o x join o y on x.c = y.c and x.k < y.k and x.v <> y.v)
select c::varchar as draft_id, count(*) as conflicts from p group by 1""")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a draft, its orders are claims on one thing: every two with other values are a conflict."""
    o = table(spark, sf_dir, "orders")
    claim = o.select(_s("o_custkey").alias("draft_id"), F.lit("STATUS").alias("claim_type"), F.lit("s").alias("normalized_subject"), F.lit("is").alias("predicate"), _s("o_orderkey").alias("claim_id"), _s(F.col("o_orderkey") % 3).alias("value"), F.lit("t").alias("display_text"), F.lit(True).alias("is_material"))
    link = claim.limit(0).select("draft_id", "claim_id", F.lit("e").alias("evidence_id"), F.lit("MENTIONS").alias("relation"))
    excerpt = claim.limit(0).select("draft_id", F.lit("e").alias("evidence_id"), F.lit("").alias("excerpt"), F.lit("").alias("normalized_excerpt"))
    return factual.conflicts(claim, link, excerpt).groupBy("draft_id").agg(F.count("*").alias("conflicts"))


@query("""with t as (select distinct p_type from part) select left(p_type, length(p_type) - 1) || 'X' as name, p_type as canonical, 1 as distance, 'FIX' as action from t union all select p_type, p_type, 0, 'SAME' from t""")
def entity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select("p_type", F.lit("x").alias("scope")).distinct()
    wrong = types.select("scope", F.expr("concat(left(p_type, length(p_type) - 1), 'X')").alias("name"))
    known = types.select("scope", F.col("p_type").alias("canonical"))
    return qa.nearest_entity(wrong.union(known), known, ["scope"]).drop("scope")


# --- delivery and work states -----------------------------------------------------------


@query("""with e as (select event_id, 100 + event_id % 500 as s, 1 + event_id % 3 as a from events),
c as (select *, case when s in (401, 403) then 'AUTHENTICATION' when s = 404 then 'NOT_FOUND' when s = 409 then 'CONFLICT' when s in (400, 413, 415, 422) then 'VALIDATION' when s = 429 then 'RATE_LIMITED' when s = 408 then 'TIMEOUT' when s >= 500 then 'SERVER' when s between 200 and 299 then null else 'UNEXPECTED' end as error from e)
select event_id, error, case when error is null then 'DELIVERED' when error = 'CONFLICT' then 'DELIVERY_NEEDS_RECONCILIATION' when error in ('AUTHENTICATION', 'NOT_FOUND', 'VALIDATION', 'UNEXPECTED') then 'DELIVERY_FAILED_PERMANENT' when a < 3 then 'DELIVERY_FAILED_RETRYABLE'
 when error = 'TIMEOUT' then 'DELIVERY_NEEDS_RECONCILIATION' else 'DELIVERY_FAILED_PERMANENT' end as state, case event_id % 4 when 0 then 30.0::double when 1 then 1.5::double end as asked from c""")
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("error", delivery.error_class(100 + F.col("event_id") % 500))
    asked = delivery.retry_after(_pick(F.col("event_id") % 4, ["30", " 1.5", "-1", "soon"]))
    return e.select("event_id", "error", delivery.after_attempt(F.col("error"), 1 + F.col("event_id") % 3).alias("state"), asked.alias("asked"))


@query("""with m(a, b) as (values ('READY_FOR_DELIVERY', 'DELIVERY_IN_PROGRESS'), ('READY_FOR_DELIVERY', 'DELIVERY_BLOCKED'), ('READY_FOR_DELIVERY', 'DELIVERY_REQUIRES_MANUAL_REVIEW'), ('DELIVERY_IN_PROGRESS', 'DELIVERED'), ('DELIVERY_IN_PROGRESS', 'DELIVERY_FAILED_RETRYABLE'),
 ('DELIVERY_IN_PROGRESS', 'DELIVERY_FAILED_PERMANENT'), ('DELIVERY_IN_PROGRESS', 'DELIVERY_NEEDS_RECONCILIATION'), ('DELIVERY_IN_PROGRESS', 'DELIVERY_BLOCKED'), ('DELIVERY_FAILED_RETRYABLE', 'DELIVERY_IN_PROGRESS'), ('DELIVERY_FAILED_RETRYABLE', 'DELIVERY_FAILED_PERMANENT'),
 ('DELIVERY_FAILED_RETRYABLE', 'DELIVERY_BLOCKED'), ('DELIVERY_NEEDS_RECONCILIATION', 'DELIVERED'), ('DELIVERY_NEEDS_RECONCILIATION', 'DELIVERY_IN_PROGRESS'), ('DELIVERY_NEEDS_RECONCILIATION', 'DELIVERY_FAILED_PERMANENT'), ('DELIVERY_NEEDS_RECONCILIATION', 'DELIVERY_REQUIRES_MANUAL_REVIEW'))
select a as current, b as target from m""")
def delivery_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All moves between two states that the table allows: what is left after the violations."""
    states = ["READY_FOR_DELIVERY", "DELIVERY_IN_PROGRESS", "DELIVERED", "DELIVERY_FAILED_RETRYABLE", "DELIVERY_FAILED_PERMANENT", "DELIVERY_NEEDS_RECONCILIATION", "DELIVERY_BLOCKED", "DELIVERY_REQUIRES_MANUAL_REVIEW"]
    every = spark.createDataFrame([(a, b) for a in states for b in states], "current string, target string")
    return every.join(delivery.violations(every), ["current", "target"], "left_anti")


@query("""select p_partkey as id, array_to_string(list_filter([case when p_partkey % 2 = 0 then 'title_missing' end, case when p_partkey % 3 = 0 then 'content_missing' end, case when p_partkey % 5 = 0 then 'slug_invalid' end, case when p_partkey % 7 = 0 then 'excerpt_too_long' end,
 case when p_partkey % 11 = 0 then 'status_not_draft' end, case when p_partkey % 13 = 0 then 'idempotency_key_invalid' end], lambda x: x is not null), ',') as errors from part""")
def delivery_payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lambda n, yes, no: F.when(F.col("p_partkey") % n == 0, F.lit(no)).otherwise(F.lit(yes))
    errors = delivery.payload_errors(good(2, "T", "  "), good(5, "a-b", "A b"), good(7, "x" * 300, "x" * 301), good(3, "<p>x</p>", None), good(11, "draft", "published"), good(13, "a1" * 32, "a1"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(errors, ",").alias("errors"))


@query("""select o_orderkey as id, case when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 then (case when o_orderkey % 5 = 0 then 'DRAFT_GENERATED' when o_orderkey % 4 >= 2 then 'FAILED_PERMANENT' else 'QUEUED' end) when o_orderkey % 2 = 0 then 'PROCESSING' else 'PUBLISHED' end as status,
 o_orderkey % 4 + (case when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 then 1 else 0 end) as recoveries, case when not (o_orderkey % 2 = 0 and o_orderkey % 3 <> 0) then 'w' end as claimed_by from orders""")
def stale_claims_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    at = F.when(F.col("id") % 3 == 0, F.lit("2026-01-01 23:59:00")).otherwise(F.lit("2026-01-01 20:00:00")).cast("timestamp")
    status = F.when(F.col("id") % 2 == 0, "PROCESSING").otherwise("PUBLISHED")
    claims = _orders(spark, sf_dir, 4).select("id", status.alias("status"), at.alias("claimed_at"), F.col("id").alias("n"), F.lit("w").alias("claimed_by"), (F.col("id") % 5 == 0).alias("has_draft"), (F.col("id") % 4).alias("recoveries"))
    return state.recovered(claims, now, 600, 2).select("id", "status", "recoveries", "claimed_by")


@query("""select o_orderkey as id, case when o_orderkey % 3 < 2 and o_orderkey % 2 = 0 then 'DONE' else 'PROCESSING' end as status, case when o_orderkey % 3 < 2 and o_orderkey % 2 = 0 and o_orderkey % 5 = 0 then 1 else 0 end as fail_count from orders""")
def status_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update whose expected owner is another one changes nothing."""
    rows = _orders(spark, sf_dir, 2).select("id", F.lit("PROCESSING").alias("status"), F.lit("w1").alias("claimed_by"), F.lit(0).alias("fail_count"))
    owner = F.when(F.col("id") % 3 == 0, F.lit("w1")).when(F.col("id") % 3 == 2, F.lit("w2"))
    updates = rows.where("id % 2 = 0").select("id", F.lit("DONE").alias("status"), owner.alias("expected_claimed_by"), (F.col("id") % 5 == 0).alias("increment"))
    return state.transition(rows, updates, "id").select("id", "status", "fail_count")
