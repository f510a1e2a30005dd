"""Named queries on clusters of sources, looking back, token accounting and routing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.canonical import payload_hash
from quillspark.operators import accounting, clusters, history
from quillspark.plans.catalogue import query, table
from quillspark.plans.rules import _pick, _s
from quillspark.session import spread
from quillspark.streaming import routing


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex}"


#: Line numbers repeat within an order, so a place is a line's number, part, supplier and quantity.
PLACE = "(cast(l_linenumber as bigint) * 1000000000000000 + l_partkey * 100000000 + l_suppkey * 100 + cast(l_quantity as bigint))"


# --- clusters ----------------------------------------------------------------

VISIBLE = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


@query(rf"""with s as (select doc_id // 5 as c, doc_id % 5 as p, source, {VISIBLE.format(x="regexp_replace(text, '[<>&]', ' ', 'g')")} as t, doc_id from documents where doc_id % 5 <= 2),
u as (select *, case when p = 2 and c % 4 = 0 then 'DUPLICATE' when t = '' then 'ARTICLE_BODY_NOT_FOUND' when length(t) < 500 then 'TOO_SHORT' else 'ARTICLE_BODY_OK' end as status,
  case when length(t) <= 8000 then length(t) when 8000 - position(' ' in reverse(left(t, 8000))) >= 6400 then length(rtrim(left(t, 8000 - position(' ' in reverse(left(t, 8000)))))) else length(rtrim(left(t, 8000))) end as n from s)
select c as cluster_id, case when count(*) filter (status = 'ARTICLE_BODY_OK') >= 2 then 'multi_source' else 'single_source_trusted' end as basis, string_agg(status, ' ' order by p) as statuses,
 sum(n) filter (status = 'ARTICLE_BODY_OK')::bigint as visible, 'T' || min(doc_id) filter (status = 'ARTICLE_BODY_OK') as title
from u group by c having count(*) filter (status = 'ARTICLE_BODY_OK') >= 2 or (count(*) filter (status = 'ARTICLE_BODY_OK') = 1 and bool_or(status = 'ARTICLE_BODY_OK' and p = 0))""")
def cluster_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents each as the sources of an event: the first three count, in every fourth cluster the third repeats the first's address; the first one's site is trusted."""
    d = F.col("doc_id")
    site = F.when(d % 5 == 0, "https://www.variety.com/").when((d % 5 == 2) & (F.floor(d / 5) % 4 == 0), "http://variety.com/").otherwise("https://www.x.example/")
    page = F.when((d % 5 == 2) & (F.floor(d / 5) % 4 == 0), F.concat(_s(d - 2), F.lit("/?x=1"))).otherwise(_s(d))
    sources = table(spark, sf_dir, "documents").select(
        F.floor(d / 5).alias("cluster_id"), (d % 5).alias("position"), F.concat(site, page).alias("url"), F.col("source").alias("name"), F.concat(F.lit("T"), _s(d)).alias("title"),
        F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p>")).alias("content"), F.lit(None).cast("string").alias("published_at"),
    )
    got = clusters.payloads(sources)
    every = F.array_sort(F.transform(F.concat("used", "skipped"), lambda s: F.struct(s["position"].alias("p"), s["status"].alias("s"))))
    size = F.aggregate(F.transform("documents", lambda x: F.length(F.trim(F.regexp_replace(x["content"], "</?p>", "")))), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return got.select("cluster_id", "basis", F.array_join(F.transform(every, lambda x: x["s"]), " ").alias("statuses"), size.alias("visible"), "title")


@query(f"""with s as (select l_orderkey as o, {PLACE} as p, (l_quantity * 100)::int as size, row_number() over (partition by l_orderkey order by l_quantity, {PLACE}) - 1 as k, count(*) over (partition by l_orderkey) as n from lineitem),
t as (select *, sum(size) over (partition by o order by p rows between unbounded preceding and 1 preceding) as before, sum(size) over (partition by o order by k rows between unbounded preceding and 1 preceding) as smaller, sum(size) over (partition by o) as total from s),
l as (select *, max((9000 - coalesce(smaller, 0)) // (n - k)) over (partition by o) as level from t)
select o as order_key, p as position, greatest(0, least(size, 9000 - coalesce(before, 0)))::int as in_order, (case when total <= 9000 then size else least(size, level) end)::int as fair from l""")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sources of an order that share 9,000 characters, in order and fairly."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.expr(PLACE).alias("position"), (F.col("l_quantity") * 100).cast("int").alias("size"))
    ordered = clusters.allowances(rows, "size", 9000, "order_key", "position").withColumnRenamed("allowance", "in_order")
    return clusters.allowances(ordered, "size", 9000, "order_key", "position", fair=True).select("order_key", "position", "in_order", F.col("allowance").alias("fair"))


@query(f"""with i as (select l_orderkey as o, {PLACE} as p, unnest([{{'w': 0, 'u': 'https://i.ex/' || l_partkey % 7 || '.jpg'}}, {{'w': 1, 'u': 'https://i.ex/s' || l_suppkey % 3 || '.jpg'}}, {{'w': 2, 'u': case when l_linenumber % 2 = 1 then 'https://lead.ex/' || l_orderkey % 5 || '.png' end}}]) as x from lineitem),
f as (select o, x.u as u, min((p, x.w)) as w from i where x.u is not null group by o, x.u)
select * from (select o as order_key, (row_number() over (partition by o order by w))::int as n, u as url from f) where n <= 4""")
def cluster_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of an order's items: several forms of one, previews of videos and empty ones among them, and a lead image of every other item."""
    part, supp = _s(F.col("l_partkey") % 7), _s(F.col("l_suppkey") % 3)
    image = lambda url: F.struct(url.alias("url"), F.lit("").alias("alt"), F.lit("").alias("caption"))
    images = F.array(image(F.concat(F.lit("https://i.ex/"), part, F.lit(".jpg"))), image(F.lit(" ")), image(F.lit("https://i.ytimg.com/vi/abcdefghijk/hqdefault.jpg")), image(F.concat(F.lit("https://i.ex/S"), supp, F.lit("-300x200.jpg?w=300&q=8"))), image(F.lit("data:x")))
    lead = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("https://lead.ex/"), _s(F.col("l_orderkey") % 5), F.lit(".png")))
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.expr(PLACE).alias("position"), images.alias("images"), lead.alias("lead"))
    got = clusters.media(docs, most=4, variants=True)
    return got.select(F.col("cluster_id").alias("order_key"), "n", F.regexp_replace(F.lower("url"), r"-300x200\.jpg.*", ".jpg").alias("url"))


# --- looking back -------------------------------------------------------------


@query("""with l as (select event_id, user_id, ts from events where event_type in (select max(event_type) from events)), r as (select user_id, ts, max(event_id) as id, max(value) as v from events where event_type in (select min(event_type) from events) group by user_id, ts)
select event_id, r.id as last_id, r.v as last_value from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""")
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event of the last kind by name, the user's last event of the first kind at that time."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.max("event_type").alias("last"), F.min("event_type").alias("first")).first()
    left = events.where(F.col("event_type") == ends["last"]).select("event_id", "user_id", "ts")
    right = events.where(F.col("event_type") == ends["first"]).groupBy("user_id", F.col("ts").alias("since")).agg(F.max("event_id").alias("last_id"), F.max("value").alias("last_value"))
    return history.asof(left, right, "user_id", "ts", "since", ["last_id", "last_value"]).select("event_id", "last_id", "last_value")


@query("""with o as (select o_custkey as key, o_orderkey as revision from orders) select key as event_key, revision, row_number() over w as ordinal, count(*) over (partition by key) as revisions, coalesce(revision - lag(revision) over w - 1, 0) as gap from o window w as (partition by key order by revision)""")
def event_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_key"), F.col("o_orderkey").alias("revision"))
    return history.revisions(rows)


@query(f"""with e as (select l_orderkey as d, 'https://s' || l_suppkey % 3 || '.ex/' as url, {PLACE} as i, case when l_linenumber % 4 = 0 then ' ' else l_linestatus || ' ' || l_partkey end as x, l_returnflag as f from lineitem)
select d as draft_id, url, arg_min('N' || i, i) as source_name, arg_min(f = 'R', i) as is_primary, coalesce(string_agg(trim(x), ' ' order by i) filter (trim(x) <> ''), '') as content from e group by d, url""")
def stored_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the stored evidence of an order's draft, from three sources."""
    line = F.col("l_linenumber")
    evidence = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"), F.concat(F.lit("https://s"), _s(F.col("l_suppkey") % 3), F.lit(".ex/")).alias("source_url"), F.expr(PLACE).alias("ordinal"),
        F.when(line % 4 == 0, " ").otherwise(F.concat("l_linestatus", F.lit(" "), _s("l_partkey"))).alias("excerpt"), F.when(F.col("l_returnflag") == "R", "PRIMARY").otherwise("SECONDARY").alias("strength"),
        F.concat(F.lit("N"), _s(F.expr(PLACE))).alias("source_name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("published_at"),
    )
    return history.source_material(evidence).select("draft_id", "url", "source_name", "is_primary", "content")


@query("""with e as (select o_custkey as k, o_orderkey as r, row_number() over (partition by o_custkey order by o_orderkey desc) = 1 as last, o_orderkey % 5 as c from orders),
a as (select k, r, c from e where last union all select c_custkey, null, null from customer where c_custkey not in (select o_custkey from orders))
select 'k' || k as event_key, r::int as revision, status, n from a, lateral (select unnest(case when r is null then [{'s': 'NOT_FOUND', 'n': 2}] when c = 0 then [{'s': 'NO_PAYLOAD', 'n': 2}] when c = 1 then [{'s': 'REPLAY_FAILED', 'n': 1}, {'s': 'REPLAY_COMPLETED', 'n': 1}] else [{'s': 'REPLAY_COMPLETED', 'n': 1}] end) as x), lateral (select x.s as status, x.n::bigint as n)""")
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of every customer processed again, twice: one in five fails at first, one has no payload, and some customers have none."""
    k = F.col("o_orderkey")
    events = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), _s("o_custkey")).alias("event_key"), k.cast("int").alias("revision"), F.when(k % 5 > 0, _s(k)).alias("payload"))
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), _s("c_custkey")).alias("event_key"), F.lit(None).cast("int").alias("revision"))
    ledger = scratch(spark, "replay")

    def process(fails: bool):
        error = F.when(F.lit(fails) & (F.col("revision") % 5 == 1), "no model")
        return lambda df: df.select("event_key", "revision", F.concat(F.lit("d"), "payload").alias("draft_id"), F.md5("payload").alias("output_hash"), error.alias("error"))

    history.replay(events, asked, process(True), ledger, "run")
    attempts = history.replay(events, asked, process(False), ledger, "run")
    return attempts.groupBy("event_key", "revision", "status").agg(F.count("*").alias("n"))


# --- accounting and routing ---------------------------------------------------


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls of a model; some token numbers are negative or none."""
    q, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("api_type"), F.col("l_linestatus").alias("model"),
        F.when((line == 7) & (F.col("l_orderkey") % 2 == 0), "-1").when(line == 6, "many").otherwise(_s(q)).alias("prompt_tokens"), _s(line).alias("completion_tokens"), (F.col("l_discount") > 0.02).alias("success"), (F.col("l_orderkey") % 4).alias("part"),
    )


CALLS = "calls as (select l_shipdate as t, l_returnflag as api_type, l_linestatus as model, l_quantity::int as p, l_linenumber as c, l_discount > 0.02 as ok, l_orderkey % 4 as part from lineitem where l_linenumber <> 6 and not (l_linenumber = 7 and l_orderkey % 2 = 0))"


@query(f"""with {CALLS} select api_type, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(p + c)::bigint as total_tokens, count(*) as requests, count(*) filter (ok) as successful, count(*) filter (not ok) as failed, max(t) as last_call, true as median_near from calls group by api_type""")
def usage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of a log as states of their own, one of them added twice, merged; the sketch's median lies within two hundredths of the calls."""
    calls = _calls(spark, sf_dir)
    part = lambda *k: accounting.partial(calls.where(F.col("part").isin(*k)), F.col("part"))
    merged = accounting.merge(part(0, 1), part(2), part(1, 3), part(0))
    got = accounting.summary(merged, ["api_type"])
    ranks = accounting.valid(calls).select("api_type", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("n")).join(got.select("api_type", "median_size"), "api_type")
    near = ranks.groupBy("api_type").agg((F.avg((F.col("n") <= F.col("median_size")).cast("double")) >= 0.48).alias("a"), (F.avg((F.col("n") < F.col("median_size")).cast("double")) <= 0.52).alias("b"))
    return got.join(near, "api_type").select("api_type", *accounting.SUMS, "last_call", (F.col("a") & F.col("b")).alias("median_near"))


@query(f"""with {CALLS} select part as batch, t::date as day, api_type, model, case part when 3 then 'MISSING' when 2 then case when count(*) filter (api_type = 'R') > 0 then 'STALE' else 'OK' end else 'OK' end as status from calls group by part, t::date, api_type, model""")
def usage_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States held against the log: one part was never counted, one was counted with wrong numbers."""
    calls = _calls(spark, sf_dir)
    state = accounting.partial(calls, F.col("part")).where(F.col("batch") < 3)
    wrong = (F.col("batch") == 2) & (F.col("api_type") == "R")
    kept = state.withColumn("requests", F.col("requests") + F.when(wrong, 1).otherwise(0))
    return accounting.integrity(calls, kept, F.col("part"))


@query("""with o as (select o_orderkey as i, o_orderkey % 6 as k from orders)
select i::bigint as seq, case k when 0 then 'accepted' when 1 then 'rejected' when 2 then 'dead_letter' when 3 then 'passed' when 4 then 'dead_letter' else 'accepted' end as target, case k when 0 then 'ACCEPT_NEW_EVENT' when 1 then 'INVALID INVALID_SOURCE_COUNT' when 2 then 'MALFORMED_JSON' when 4 then 'UNKNOWN_CONTRACT_VERSION' when 5 then 'ACCEPT_NEW_EVENT' end as reason, 0::bigint as batch from o
union all select 1000000000 + i, 'rejected', case k when 0 then 'DUPLICATE' else 'REVISION_HASH_CONFLICT' end, 1 from o where k in (0, 5)""")
def routed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches through one pass, each started twice: new events, wrong ones, no JSON, items of no event, unknown contracts; then the new ones again, half of them with other content."""
    k, i = (F.col("o_orderkey") % 6).cast("int"), _s("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    source = lambda site, primary: F.struct(F.lit(site).alias("domain"), F.concat(F.lit(f"https://www.{site}/"), i).alias("url"), F.lit("x").alias("author"), day.alias("published_at"), F.lit(primary).alias("is_primary"))

    def event(title: str):
        return F.to_json(F.struct(
            F.lit("rss-prime-event-v1").alias("contract_version"), F.concat(F.lit("k"), i).alias("event_key"), F.lit(1).alias("revision"), F.lit("movies").alias("topic"), F.lit(title).alias("title"), day.alias("first_seen"), day.alias("last_seen"),
            F.lit(True).alias("is_multi_source"), F.when(k == 1, 3).otherwise(2).alias("source_count"), F.lit(0.5).alias("cluster_confidence"), F.lit("c").alias("cursor"), F.array(source("a.com", True), source("b.com", False)).alias("sources"),
        ))

    # Dealt out by key, as a file of few row groups is few tasks; the files that follow from it are as many.
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    first = _pick(k, [event("T"), event("T"), F.concat(F.lit("{no json "), i), F.concat(F.lit('{"id": '), i, F.lit("}")), F.concat(F.lit('{"contract_version": "v9", "event_key": "k'), i, F.lit('"}')), event("T")])
    batches = [
        orders.select(F.col("o_orderkey").cast("bigint").alias("seq"), first.alias("payload")),
        orders.where(k.isin(0, 5)).select((F.lit(1_000_000_000) + F.col("o_orderkey")).cast("bigint").alias("seq"), F.when(k == 0, event("T")).otherwise(event("Other")).alias("payload")),
    ]
    path = scratch(spark, "routing")

    def landed(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    write = routing.fan_out(path, routing.judge_after(path))
    for n, rows in enumerate(batches):
        plain = landed(rows, f"plain/{n}")
        under = F.contains("payload", F.lit('"rss-prime-event-v1"'))
        own = F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit(', "payload_hash": "'), payload_hash(F.when(under, F.col("payload"))), F.lit('"}'))
        rows = landed(plain.select("seq", F.when(under, own).otherwise(F.col("payload")).alias("payload")), f"landed/{n}")
        write(rows, n)
        write(rows.limit(3), n)  # a committed batch that comes again changes nothing
    every = [routing.table(spark, path, t, routing.ROUTED).withColumn("target", F.lit(t)) for t in routing.TARGETS]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).select("seq", "target", "reason", F.when(F.col("seq") < 1_000_000_000, 0).otherwise(1).cast("long").alias("batch"))
