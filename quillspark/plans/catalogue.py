"""Named queries over the test tables, each with the SQL that must give the same rows.

A query is a function of (spark, folder). Column names and values equal those of its SQL in `SQL`; a query without SQL
has no entry there and is held by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import ids, text, urls, values
from quillspark.operators import coverage, policy, revisions, state
from quillspark.session import bound_batches, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What tells the rows of a table apart.
KEYS = {"part": ["p_partkey"], "orders": ["o_orderkey"], "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "events": ["event_id"]}


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dealt out over all cores, for steps that cost much for each row."""
    return spread(table(spark, sf_dir, name), *KEYS[name])


#: DuckDB forms of the expressions, used inside the queries' SQL.
HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
DOMAIN = "regexp_replace(" + HOST + ", '^www\\.', '')"
PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def d_canonical(u: str) -> str:
    path = PATH.format(u=u)
    single = f"regexp_replace(url_decode(replace(case when {path}='' then '/' else {path} end, '+', '%2B')), '/{{2,}}', '/', 'g')"
    return f"lower({DOMAIN.format(u=u)} || case when {single}='/' then '/' else rtrim({single}, '/') end)"


FOLD = "replace(translate(lower({x}), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss')"
SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
TITLE_KEY = "trim(regexp_replace(regexp_replace(trim(lower({x})), '[\"''`´“”‘’]', '', 'g'), '[^a-z0-9à-ÿ]+', ' ', 'g'))"


def d_fold(x: str) -> str:
    return FOLD.format(x=x)


def d_paragraph(x: str) -> str:
    return f"trim(regexp_replace({d_fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def d_any(x: str, needles) -> str:
    return "(" + " or ".join(f"contains({x}, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


# --- URLs and identities ---------------------------------------------------


@query(f"select page_id, {d_canonical('url')} as canonical_url from pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@query(f"select {DOMAIN.format(u='url')} as domain, count(*) as n, count(*) filter (where regexp_matches(url, '^https?://[^/?#]+')) as acceptable from pages group by 1")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").groupBy(urls.domain(u).alias("domain")).agg(F.count("*").alias("n"), F.count_if(urls.acceptable(u)).alias("acceptable"))


@query(f"select count(distinct array_to_string(list_slice(string_split({DOMAIN.format(u='url')}, '.'), -2, -1), '.')) as origins, count(*) as n from pages")
def editorial_origin_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").agg(F.count_distinct(urls.origin_key(F.col("url"))).alias("origins"), F.count("*").alias("n"))


@query("""
select page_id, url from (select page_id, url, row_number() over (partition by case when url <> '' then url else cast(page_id as varchar) end order by page_id) rn from pages) where rn = 1
""")
def feed_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select(F.lit(None).cast("string").alias("event_key"), "url", F.col("page_id").cast("string").alias("id"), "page_id")
    return coverage.first_by_key(items, [F.col("page_id")]).select("page_id", "url")


@query(f"select domain, sha1(string_agg(c, '|' order by c)) as signature, count(*) as urls from (select {DOMAIN.format(u='url')} as domain, {d_canonical('url')} as c from pages) group by 1")
def cluster_signature_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    grouped = pages.groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.collect_list("url").alias("u"))
    return grouped.select("domain", urls.cluster_signature(F.col("u")).alias("signature"), F.size("u").cast("long").alias("urls"))


@query("select page_id, case when url <> '' then sha256(trim(url)) else sha256('|') end as item_id from pages")
def stable_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", urls.item_id(none, F.col("url"), none, none).alias("item_id"))


@query("""
select o_orderkey,
 'draft-' || left(sha256('event:' || o_custkey || '|rev:' || (o_orderkey % 4 + 1)), 32) as draft_id,
 'dlv-' || left(sha256('draft:d' || o_orderkey || '|content:' || o_orderstatus || '|dest:cms'), 32) as delivery_id,
 'gate-' || left(sha256('draft:d' || o_orderkey || '|policy:v1|hash:' || o_orderstatus), 32) as gate_id
from orders
""")
def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    draft = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    return o.select(
        "o_orderkey",
        ids.draft_id(F.col("o_custkey"), none, none, F.col("o_orderkey") % 4 + 1).alias("draft_id"),
        ids.delivery_id(ids.idempotency_key(draft, F.col("o_orderstatus"), F.lit("cms"))).alias("delivery_id"),
        ids.gate_id(draft, F.lit("v1"), F.col("o_orderstatus")).alias("gate_id"),
    )


# --- text ------------------------------------------------------------------


@query(f"select p_partkey, {TITLE_KEY.format(x='p_name')} as title_key from part")
def title_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.title_key(F.col("p_name")).alias("title_key"))


@query(f"""
select key_hash, count(*) as copies, min(doc_id) as first_doc from (
 select doc_id, md5({d_paragraph('p')}) as key_hash from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) where length({d_paragraph('p')}) >= 40)
group by 1 having count(*) > 1
""")
def paragraph_fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(F.split("text", "\n"), text.paragraph_key)).alias("k"))
    return lines.where(F.length("k") >= 40).groupBy(F.md5("k").alias("key_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""
select doc_id, count(*) as sentences, max(length(s)) as longest from (
 select doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) as s from documents) where s <> '' group by 1
""")
def sentence_explode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"))


@query(f"""
with b as (select item_id, list_distinct(list_filter(string_split({d_paragraph('text')}, ' '), lambda x: x <> '')) as t from benchmark)
select x.item_id as a, y.item_id as b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) as overlap
from b x join b y on x.item_id < y.item_id where len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.2
""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against each other: pairs meet on shared words, so no pair without one is made."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(text.paragraph_key(F.col("text"))).alias("t"))
    words = b.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    x, y = words.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "w"), words.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "w")
    shared = x.join(y, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"))
    ratio = F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))
    return shared.where(ratio >= 0.2).select("a", "b", F.round(ratio, 6).alias("overlap"))


@query(f"""
with b as (select item_id, list_distinct(list_filter(string_split({d_paragraph('text')}, ' '), lambda x: x <> '')) as u from benchmark),
d as (select doc_id, list_distinct(list_filter(string_split({d_paragraph('text')}, ' '), lambda x: x <> '')) as t from documents),
p as (select doc_id, item_id, len(t) as n, len(u) as k, len(list_intersect(t, u)) as m from d cross join b where len(t) > 0 and len(u) > 0)
select doc_id, item_id, round(m / (n + k - m), 6) as overlap, round(m / k, 6) as held from p where 5 * m >= n + k - m or 5 * m >= 4 * k
""")
def token_overlap_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against benchmark items: all pairs with an overlap of 0.2, or with 0.8 of the item's words in the document.

    Words in common are counted by products of tables of ones, so no row is made for a pair that does not count.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.tokens(text.paragraph_key(F.col("text"))).alias("t"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), text.tokens(text.paragraph_key(F.col("text"))).alias("u"))
    either = F.col("n") + F.col("k") - F.col("m")
    return coverage.shared_words(d, b).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round(F.col("m") / either, 6).alias("overlap"), F.round(F.col("m") / F.col("k"), 6).alias("held"))


@query("""
select item_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i and length(x) <= 60), 1, 12), ',') as tags from (
 select item_id, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: lower(trim(x))), lambda x: x <> '') as l from benchmark)
""")
def tags_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", F.transform(F.split("text", r"\s+"), lambda x: F.lower(F.trim(x))).alias("l"))
    return d.select("item_id", F.array_join(text.tags(F.col("l")), ",").alias("tags"))


# --- policies --------------------------------------------------------------


WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


@query(f"""
select doc_id, w as source_words, least(case when w<=350 then greatest(250, cast(floor(w*0.75) as int)) when w<=600 then cast(floor(w*0.75) as int) when w<=900 then cast(floor(w*cast(0.8 as double)) as int) else cast(floor(w*0.75) as int) end, 550) as min_words,
 least(case when w<=600 then cast(floor(w*cast(1.25 as double)) as int) when w<=900 then cast(floor(w*cast(1.2 as double)) as int) else cast(floor(w*cast(1.1 as double)) as int) end, 1000) as max_words, w > 600 as allow_expansion
from (select doc_id, {WORDS} as w from documents)
""")
def word_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).cast("long").alias("source_words"))
    p = d.withColumn("p", policy.word_policy(F.col("source_words"), F.lit("news")))
    return p.select("doc_id", "source_words", F.col("p.min_acceptable_words").alias("min_words"), F.col("p.max_recommended_words").alias("max_words"), F.col("p.allow_expansion").alias("allow_expansion"))


@query(f"""
with d as (select doc_id, {WORDS} as w, {d_fold("left(text, 1500)")} as t from documents), k as (select doc_id, w, case
 when regexp_matches(t, '\\b(\\d{{1,2}}\\s*(melhores?|piores?|filmes?|series?|personagens?|motivos?|razo?es?|momentos?|coisas?|fatos?|cenas?|episodios?|jogos?|quotes?|frases?|citacoe?s?)|melhores?\\s+\\w+|piores?\\s+\\w+|ranking|lista\\s+d[eo]|top\\s+\\d+|selecion[ao]|subestimad|esquecid|explicad|vale\\s+assistir|val[ae]\\s+a\\s+pena|quotes?|frases?)\\b') then 'list'
 when regexp_matches(t, '\\b(como\\s+\\w+|guia\\b|entenda\\s+|explicacao|cronologia|tutorial)\\b') and w >= 600 then 'guide'
 when regexp_matches(t, '\\b(analise|review|resenha|avaliacao|opiniao|coluna)\\b') then 'analysis'
 when w < 700 then 'news' when w >= 1500 and not regexp_matches(t, '\\b(trailer|rumor|confirmado|confirma|revela|estreia|cancelado|renovado)\\b') then 'guide' else 'news' end as t from d)
select doc_id, case when w <= 600 and t in ('guide','list') then 'news' else t end as article_type from k
""")
def article_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", policy.article_type(F.lit(""), text.words(F.col("text")), F.col("text")).alias("article_type"))


NAV = " + ".join(f"cast(contains(t, '{n}') as int)" for n in ("publicidade", "mais lidas", "últimas:", "ultimas:", "assine", "entrar", "newsletter", "cookies"))


def _status_sql() -> str:
    from quillspark.functions import lexicons as L

    plain = SQUEEZE.format(x="regexp_replace(text, '<[^>]+>', ' ', 'g')")
    return f"""select status, count(*) as n from (select case when text is null then 'FETCH_ERROR' when t = '' then 'ARTICLE_BODY_NOT_FOUND' when {d_any('t', L.PAYWALL_SIGNALS)} then 'PAYWALLED'
 when {NAV} >= 3 then 'NAVIGATION_NOISE' when length(t) < 500 then 'TOO_SHORT' else 'ARTICLE_BODY_OK' end as status from (select text, lower({plain}) as t from documents)) group by 1"""


@query(_status_sql())
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(policy.extraction_status(F.col("text")).alias("status")).agg(F.count("*").alias("n"))


def _entry_sql() -> str:
    from quillspark.functions import lexicons as L

    return f"""select page_id, case when {d_any('lower(url)', L.LIVE_SIGNALS)} then 'LIVEBLOG_BLOCKED' when {d_any('lower(url)', L.OPINION_SIGNALS)} then 'OPINION_BLOCKED'
 when page_id % 3 = 0 and not {d_any(DOMAIN.format(u='url'), L.TRUSTED_SINGLE_SOURCES)} then 'SINGLE_SOURCE_NOT_RELIABLE' else 'OK' end as status from pages"""


@query(_entry_sql())
def entry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, none = F.col("url"), F.lit(None).cast("string")
    single = F.col("page_id") % 3 == 0
    return table(spark, sf_dir, "pages").select("page_id", policy.entry_status(u, none, none, F.when(single, 1).otherwise(2), ~single, F.array(urls.domain(u))).alias("status"))


def _score_sql() -> str:
    from quillspark.functions import lexicons as L

    t = "lower(left(text, 500))"
    e = d_any(t, L.ENTITIES)
    return f"select doc_id, case when {e} then 30 else 0 end + case when {e} and {d_any(t, L.DEPTH_WORDS)} then 15 else 0 end + 10 as score from documents"


@query(_score_sql())
def event_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", policy.event_score(F.lit(""), F.col("text"), F.array().cast("array<string>"), F.lit(2))["score"].alias("score"))


# --- revisions and state ---------------------------------------------------


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries: a user is an event key, the property k gives the revision, type and value give the content."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("event_key"),
        (F.get_json_object("props", "$.k").cast("int") % 7 + 1).alias("revision"),
        F.sha2(F.concat_ws("|", "event_type", F.floor("value").cast("string")), 256).alias("payload_hash"),
        F.col("event_type").alias("source_id"),
        F.lit("v1").alias("contract_version"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("cursor"),
    )


DELIVERIES = """
d as (select event_id as seq, user_id as event_key, cast(cast(json_extract_string(props, '$.k') as int) % 7 + 1 as int) as revision, sha256(event_type || '|' || cast(cast(floor(value) as bigint) as varchar)) as h,
 event_type as source_id, case when event_id % 5 <> 0 then 'c' || event_id end as cursor from events),
w as (select *, row_number() over (partition by event_key, revision order by seq) as nth, first_value(h) over (partition by event_key, revision order by seq) as h1,
 max(revision) over (partition by event_key order by seq rows between unbounded preceding and 1 preceding) as pm from d),
x as (select *, case when pm is null then 'ACCEPT_NEW_EVENT' when nth > 1 and h = h1 then 'DUPLICATE' when nth > 1 then 'REVISION_HASH_CONFLICT' when revision < pm then 'STALE_REVISION' else 'ACCEPT_NEW_REVISION' end as decision from w)
"""


@query(f"with {DELIVERIES} select seq, event_key, revision, decision from x")
def revision_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.decide(_deliveries(spark, sf_dir)).select("seq", "event_key", "revision", "decision")


@query(f"with {DELIVERIES} select event_key, seq, m as missing from (select event_key, seq, unnest(range(pm + 1, revision)) as m from x where decision = 'ACCEPT_NEW_REVISION' and revision > pm + 1)")
def revision_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = revisions.decide(_deliveries(spark, sf_dir)).where("missing_from is not null")
    return d.select("event_key", "seq", F.explode(F.sequence(F.col("missing_from").cast("long"), F.col("missing_to").cast("long"))).alias("missing"))


@query(f"with {DELIVERIES} select source_id, max_by(cursor, seq) as cursor, max_by(event_key, seq) as event_key, max_by(revision, seq) as revision from x where decision in ('ACCEPT_NEW_EVENT','ACCEPT_NEW_REVISION','DUPLICATE') and cursor is not null group by 1")
def cursor_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.cursors(revisions.decide(_deliveries(spark, sf_dir))).select("source_id", "cursor", "event_key", "revision")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return state.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1 and o_orderstatus = 'F'")
def latest_then_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return state.latest_then(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("""
with l as (select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) rn from orders) where rn = 1)
select o_custkey, l_orderkey, l_linenumber from lineitem join l on l_orderkey = o_orderkey where l_returnflag = 'R'
""")
def latest_children_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_orderkey", "l_linenumber")
    last = state.latest(o, ["o_custkey"], [F.desc("o_orderkey")])
    return li.join(last, "o_orderkey").select("o_custkey", "l_orderkey", "l_linenumber")


@query("""
select o_orderkey, o_orderpriority from orders where o_orderstatus in ('O','P') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')
order by case when o_orderpriority like '1%' then 0 else 1 end, o_orderdate desc, o_orderkey desc limit 100
""")
def pending_anti_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    queued = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    order = [F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1), F.desc("o_orderdate"), F.desc("o_orderkey")]
    return state.pending(o, queued, "o_orderkey", F.col("o_orderstatus").isin("O", "P"), order, 100).select("o_orderkey", "o_orderpriority")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def claim_exists_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    items = p.select(F.col("page_id").alias("id"), F.pmod(F.crc32(urls.domain(u)), F.lit(3)).cast("string").alias("topic"), (F.col("page_id") % 40).cast("string").alias("k"), urls.canonical(u).alias("canonical_url"), text.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_key"))
    items = items.withColumn("topic", F.lit("t")).withColumn("event_key", F.when(F.col("k") < "2", F.col("k"))).drop("k")
    return items.where("id % 2 = 0"), items.where("id % 2 = 1")


CASCADE = f"""
i as (select page_id as id, case when cast(page_id % 40 as varchar) < '2' then cast(page_id % 40 as varchar) end as event_key, {d_canonical('url')} as canonical_url, {TITLE_KEY.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)")} as title_key from pages),
a as (select * from i where id % 2 = 0), b as (select * from i where id % 2 = 1),
m as (select a.id, 0 as rank, max(b.id) as c from a join b using (event_key) where event_key <> '' group by 1
 union all select a.id, 1, max(b.id) from a join b using (canonical_url) where canonical_url <> '' group by 1
 union all select a.id, 2, min(b.id) from a join b using (title_key) where title_key <> '' group by 1),
f as (select id, min(rank) as rank, arg_min(c, rank) as covered_by from m group by 1)
"""


@query(f"with {CASCADE} select id, case rank when 0 then 'event_key' when 1 then 'canonical_url' else 'exact_title' end as reason, covered_by from f")
def coverage_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, covering = _cascade(spark, sf_dir)
    return coverage.covered(items, covering, fuzzy=False)


@query(f"with {CASCADE} select count(*) filter (where id in (select id from f)) as superseded, count(*) filter (where id not in (select id from f)) as kept from a")
def superseded_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, covering = _cascade(spark, sf_dir)
    gone, kept = coverage.superseded(items, coverage.covered(items, covering, fuzzy=False))
    return gone.agg(F.count("*").alias("superseded")).crossJoin(kept.agg(F.count("*").alias("kept")))


@query()
def coverage_cascade_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, covering = _cascade(spark, sf_dir)
    return coverage.covered(items, covering)


# --- aggregates ------------------------------------------------------------


@query("select o_orderstatus, count(*) as n from orders group by 1")
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select cast(date_trunc('day', ts) as date) as day, count(*) as n, count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 50) as large from events group by 1")
def day_counts_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"))


@query("select l_returnflag, l_linestatus, count(*) as calls, cast(sum(l_quantity) as bigint) as tokens, count(*) filter (where l_discount > 0.05) as failed from lineitem group by rollup(l_returnflag, l_linestatus)")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("calls"), F.sum("l_quantity").cast("long").alias("tokens"), F.count_if(F.col("l_discount") > 0.05).alias("failed"))


@query("""
select event_id, user_id, cast(sum(t) over (partition by user_id order by event_id) as bigint) as used, 16000 - sum(t) over (partition by user_id order by event_id) >= 500 as has_budget
from (select event_id, user_id, cast(floor(value) as bigint) as t from events)
""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("t"))
    used = F.sum("t").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select("event_id", "user_id", used.alias("used"), (16000 - used >= 500).alias("has_budget"))


@query("""
with s as (select event_id, user_id, case when event_type = 'error' then 1 else 0 end as bad from events),
g as (select *, sum(1 - bad) over (partition by user_id order by event_id) as island from s),
r as (select *, sum(bad) over (partition by user_id, island order by event_id) as streak from g)
select event_id, user_id, cast(streak as bigint) as streak, bad = 1 and streak % 3 = 0 as opens from r where bad = 1
""")
def circuit_breaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").cast("long").alias("bad"))
    user = Window.partitionBy("user_id").orderBy("event_id")
    g = s.withColumn("island", F.sum(1 - F.col("bad")).over(user))
    r = g.withColumn("streak", F.sum("bad").over(Window.partitionBy("user_id", "island").orderBy("event_id"))).where("bad = 1")
    return r.select("event_id", "user_id", "streak", (F.col("streak") % 3 == 0).alias("opens"))


@query("""
select o_orderkey, n as attempt, case when n = 1 then 0.0 else round(least(least(2.0 * pow(2, n - 2), 60) + least(2.0 * pow(2, n - 2), 60) * 0.25 * cast(('0x' || left(sha256('k' || o_orderkey || '|' || n), 8)) as bigint) / 4294967295.0, 60), 6) end as delay
from (select o_orderkey, unnest([1, 2, 3, 4, 5, 6, 7]) as n from orders)
""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import delivery

    o = table(spark, sf_dir, "orders")
    seed = F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))
    tries = o.select("o_orderkey", seed.alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("attempt"))
    return tries.select("o_orderkey", "attempt", delivery.delay(F.col("attempt"), F.col("seed")).alias("delay"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 200")
def retention_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 200)


# --- facts, verdicts and findings ------------------------------------------


@query("""
select lang as draft_id, count(*) as material, count(*) filter (where s = 'SUPPORTED') as supported, count(*) filter (where s = 'PARTIALLY_SUPPORTED') as partially_supported, count(*) filter (where s = 'UNSUPPORTED') as unsupported,
 round_even((count(*) filter (where s = 'SUPPORTED') + 0.5 * count(*) filter (where s = 'PARTIALLY_SUPPORTED')) / count(*), 6)::double as coverage_ratio
from (select lang, case when toxic = 1 then 'PARTIALLY_SUPPORTED' when quality = 1 then 'SUPPORTED' else 'UNSUPPORTED' end as s from documents join labels using (doc_id)) group by 1
""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import factual

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("draft_id")).join(table(spark, sf_dir, "labels"), "doc_id")
    status = F.when(F.col("toxic") == 1, "PARTIALLY_SUPPORTED").when(F.col("quality") == 1, "SUPPORTED").otherwise("UNSUPPORTED")
    c = factual.coverage(d.select("draft_id", status.alias("status"), F.lit(True).alias("is_material")))
    return c.select("draft_id", "material", "supported", "partially_supported", "unsupported", "coverage_ratio")


@query("""
select outcome, count(*) as n from (select case when quality = 0 and toxic = 1 then 'BLOCKED' when quality = 0 or toxic = 1 then 'REVIEW_REQUIRED' else 'CLEAR' end as outcome from labels) group by 1
""")
def gate_outcome_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import gate

    q, t = F.col("quality") == 0, F.col("toxic") == 1
    fired = F.array_compact(F.array(F.when(q & t, gate.BLOCKING), F.when(q | t, gate.WARNING), F.lit(gate.INFO)))
    return table(spark, sf_dir, "labels").groupBy(gate.outcome(fired).alias("outcome")).agg(F.count("*").alias("n"))


@query("""
select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by case when p_size = 1 then 0 else 1 end, p_partkey desc) rn from part where p_size in (1, 2)) where rn <= 5
""")
def related_with_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return state.backfilled(p, F.col("p_size") == 1, F.col("p_size") == 2, "p_partkey", [F.desc("p_partkey")], 5, ["p_brand"]).select("p_brand", "p_partkey")


def _cta_sql() -> str:
    from quillspark.operators import qa

    rules = [f"when contains(k, '{a}') and contains(k, '{b}') then '{a} + {b}'" for a, b in qa.CTA_SEQUENCES] + [f"when contains(k, '{p}') then '{p}'" for p in qa.CTA_PHRASES]
    return f"select cta, count(*) as n from (select case {' '.join(rules)} end as cta from (select {d_paragraph('text')} as k from (select text from documents union all select text from conversations))) group by 1"


@query(_cta_sql())
def cta_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import qa

    every = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    keyed = every.select(qa.cta_key(F.col("text")).alias("k"))
    return keyed.groupBy(qa.cta(F.col("k")).alias("cta")).agg(F.count("*").alias("n"))


@query("""
with w as (select p_partkey, p_name, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) >= 3))) as word from part),
l as (select distinct p_type, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: length(x) >= 3))) as word from part),
s as (select p_partkey as id, p_type as url, count(*) as score from w join l using (word) group by 1, 2)
select id, url, score from (select *, row_number() over (partition by id order by score desc, url) rn from s) where rn <= 6
""")
def link_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import qa

    p = table(spark, sf_dir, "part")
    types = p.select(F.col("p_type").alias("url"), F.col("p_type").alias("title"), F.lit("").alias("keywords")).distinct()
    return qa.internal_links(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), types, []).select("id", "url", "score")


def _documents_as_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    d = dealt(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("draft_id"), F.struct(none.alias("title"), F.col("text").alias("body_html"), none.alias("subtitle"), none.alias("summary"), none.alias("meta_description")).alias("content"))


@query()
def claim_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import factual

    return factual.claims(_documents_as_drafts(spark, sf_dir)).groupBy("claim_type").agg(F.count("*").alias("n"))


@query()
def prompt_injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import gate

    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.sum(gate.injection_signals(F.col("text"))).alias("signals"), F.count("*").alias("n"))


@query()
def title_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import qa

    t = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", qa.title_score(t).alias("score"), qa.title_findings(t)["status"].alias("status"), qa.keyword(t).alias("keyword"))


@query()
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.functions import html

    o = table(spark, sf_dir, "pages").select("page_id", html.outline(F.col("html")).alias("o"), html.visible_text(F.col("html")).alias("t"))
    return o.select("page_id", F.size("o.links").alias("links"), F.size("o.headings").alias("headings"), F.size("o.images").alias("images"), text.words(F.col("t")).alias("words"))


@query(f"select page_id, regexp_matches(html, '(?i)<\\s*script\\b') as script, regexp_matches(html, '(?i)<\\s*form\\b') as form from pages")
def unsafe_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators import gate

    found = gate.unsafe_signals(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_contains(found, "tag <script>").alias("script"), F.array_contains(found, "tag <form>").alias("form"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against the richer half of the pages: why each is covered, how usable its text is, and what the entry policy says, counted."""
    items, covering = _cascade(spark, sf_dir)
    found = coverage.covered(items, covering, fuzzy=False).select(F.col("id").alias("page_id"), "reason")
    pages = table(spark, sf_dir, "pages")
    u, none = F.col("url"), F.lit(None).cast("string")
    judged = pages.select("page_id", policy.extraction_status(F.col("html")).alias("extraction"), policy.entry_status(u, none, none, F.lit(2), F.lit(True), F.array(urls.domain(u))).alias("entry"))
    return judged.join(found, "page_id", "left").groupBy("extraction", "entry", "reason").agg(F.count("*").alias("n"))


from quillspark.plans import answers, articles, bodies, history, names, pages, rules  # noqa: E402, F401  they register their queries here
