"""The event contract: routing, normalising and total validation. Every rule adds its issues; none stops the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids, urls, values
from quillspark.functions.text import let

V1, LEGACY = "rss-prime-event-v1", "legacy-feed-input-v0"
BLOCKED_TOPICS = ("politica", "esportes")
MAX_BYTES = 1_048_576
#: Errors of structure, after which a hash says nothing.
STRUCTURAL = ("INVALID_EVENT_KEY", "INVALID_REVISION", "INVALID_SOURCE_URL", "INVALID_SOURCE_COUNT", "INVALID_EVENT_DATES")


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


#: Keys whose values tell an item of the legacy contract.
MARKERS = ("event_key", "has_superfeed_meta", "sf_event_key", "primary_source", "all_sources")
#: Keys of a payload that are read, in either spelling.
FIELDS = (
    "contract_version", "contractVersion", "event_key", "eventKey", "revision", "topic", "title", "first_seen", "firstSeen", "last_seen", "lastSeen", "is_multi_source", "isMultiSource", "multiSource",
    "source_count", "sourceCount", "cluster_confidence", "clusterConfidence", "cursor", "sources", "payload_hash", "payloadHash", *MARKERS[1:],
)


def opened(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the payload's fields (see field) and whether it is JSON, _readable: a payload is read once for all of them, not once for each."""
    return raw.select("*", F.try_parse_json(payload).isNotNull().alias("_readable"), F.json_tuple(F.col(payload), *FIELDS).alias(*[f"_json_{n}" for n in FIELDS]))


def field(name: str) -> Column:
    """A field of an opened payload as text; NULL if there is none."""
    return F.col(f"_json_{name}")


def _version(get: Callable[[str], Column]) -> Column:
    v = F.trim(F.coalesce(get("contract_version"), get("contractVersion")))
    return F.when(v != "", v)


def version(payload: Column) -> Column:
    """Declared contract version of a JSON payload, in either spelling; blank is NULL."""
    return _version(lambda name: F.get_json_object(payload, f"$.{name}"))


def _is_legacy(get: Callable[[str], Column]) -> Column:
    held = F.lit(False)
    for m in MARKERS:
        held = held | ~F.coalesce(get(m), F.lit("")).isin("", "false", "0", "[]", "{}")
    return _version(get).isNull() & held


def is_legacy(payload: Column) -> Column:
    return _is_legacy(lambda name: F.get_json_object(payload, f"$.{name}"))


def route(payload: Column, accept_legacy: bool = True) -> Column:
    """Which way a payload goes."""
    return _route(payload, F.try_parse_json(payload).isNotNull(), lambda name: F.get_json_object(payload, f"$.{name}"), accept_legacy)


def _route(payload: Column, readable: Column, get: Callable[[str], Column], accept_legacy: bool = True) -> Column:
    v = _version(get)
    return (
        F.when(F.octet_length(payload) > MAX_BYTES, "PAYLOAD_TOO_LARGE")
        .when(~readable, "MALFORMED_PAYLOAD")
        .when(v == V1, "V1")
        .when(v.isNotNull(), "UNKNOWN_CONTRACT_VERSION")
        .when(~_is_legacy(get), "MALFORMED_PAYLOAD")
        .otherwise("LEGACY" if accept_legacy else "LEGACY_CONTRACT_DISABLED")
    )


def _issue(when: Column, code: str, field: str, severity: str = "ERROR") -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def _facts(sources: Column) -> Column:
    """Of each source what its issues ask for, its address taken apart once."""

    def one(s: Column) -> Column:
        return let(urls.host(s["url"]), lambda h: F.struct(urls.acceptable(s["url"], h).alias("ok"), urls.domain(s["url"], h).alias("own"), *[s[n].alias(n) for n in ("url", "domain", "author", "published_at", "is_primary")]))

    return F.transform(sources, one)


def _source_issues(facts: Column) -> Column:
    """Issues of each source, in order; a source with an unusable URL has only that one."""

    def one(s: Column, i: Column) -> Column:
        bad = ~s["ok"]
        earlier = F.filter(F.slice(facts, F.lit(1), i), lambda o: o["ok"] & (o["url"] == s["url"]))
        return F.array_compact(
            F.array(
                _issue(bad, "INVALID_SOURCE_URL", "sources.url"),
                _issue(~bad & (~filled(s["domain"]) | (F.lower(s["domain"]) != s["own"])), "INVALID_SOURCE_DOMAIN", "sources.domain"),
                _issue(~bad & (F.size(earlier) > 0), "DUPLICATE_SOURCE_URL", "sources.url"),
                _issue(~bad & ~filled(s["author"]), "SOURCE_AUTHOR_UNKNOWN", "sources.author", "WARNING"),
                _issue(~bad & ~filled(s["published_at"]), "SOURCE_DATE_UNKNOWN", "sources.published_at", "WARNING"),
            )
        )

    return F.flatten(F.transform(facts, one))


def validate(events: DataFrame, computed_hash: Column | None = None, blocked: tuple[str, ...] = BLOCKED_TOPICS) -> DataFrame:
    """Adds issues (array of code, severity, field) and valid. computed_hash: the hash to hold the declared one against."""
    c = F.col
    sources = F.coalesce(c("sources"), F.array().cast(dict(events.dtypes)["sources"]))
    # Columns of their own: each is used several times, and would be worked out as often.
    events = events.withColumns({"_facts": _facts(sources), "_first": F.try_to_timestamp(values.instant(c("first_seen"))), "_last": F.try_to_timestamp(values.instant(c("last_seen")))})
    events = events.withColumns({"_usable": F.size(F.filter("_facts", lambda s: s["ok"])), "_primary": F.size(F.filter("_facts", lambda s: F.coalesce(s["is_primary"], F.lit(False))))})
    usable, primary, first, last = c("_usable"), c("_primary"), c("_first"), c("_last")
    some = F.size("_facts") > 0
    conf = c("cluster_confidence")
    fixed = F.array_compact(
        F.array(
            _issue(~c("contract_version").eqNullSafe(V1) & ~c("contract_version").eqNullSafe(LEGACY), "UNKNOWN_CONTRACT_VERSION", "contract_version"),
            _issue(~filled(c("event_key")), "INVALID_EVENT_KEY", "event_key"),
            _issue(F.coalesce(c("revision"), F.lit(0)) < 1, "INVALID_REVISION", "revision"),
            _issue(~filled(c("title")), "INVALID_TITLE", "title"),
            _issue(~filled(c("topic")), "INVALID_TOPIC", "topic"),
            _issue(F.lower(F.trim("topic")).isin(*blocked), "BLOCKED_TOPIC", "topic"),
            _issue(first.isNull(), "INVALID_EVENT_DATES", "first_seen"),
            _issue(last.isNull(), "INVALID_EVENT_DATES", "last_seen"),
            _issue(last < first, "INVALID_EVENT_DATES", "last_seen"),
            _issue(~some, "INVALID_SOURCE_COUNT", "sources"),
            _issue(some & (primary == 0), "NO_PRIMARY_SOURCE", "sources"),
            _issue(primary > 1, "MULTIPLE_PRIMARY_SOURCES", "sources"),
            _issue((F.coalesce(c("source_count"), F.lit(0)) < 1) | (c("source_count") != usable), "INVALID_SOURCE_COUNT", "source_count"),
            _issue(F.coalesce(c("is_multi_source"), F.lit(False)) != (usable >= 2), "INVALID_MULTI_SOURCE_FLAG", "is_multi_source"),
            _issue(conf.isNull(), "MISSING_CLUSTER_CONFIDENCE", "cluster_confidence", "WARNING"),
            _issue(F.isnan(conf) | ~conf.between(0.0, 1.0), "INVALID_CLUSTER_CONFIDENCE", "cluster_confidence"),
            _issue(~filled(c("cursor")), "MISSING_CURSOR", "cursor", "WARNING"),
        )
    )
    checked = events.withColumn("issues", F.concat(fixed, _source_issues(c("_facts")))).drop("_facts", "_usable", "_primary", "_first", "_last")
    if computed_hash is not None:
        declared = F.lower(F.trim(F.coalesce("payload_hash", F.lit(""))))
        sound = ~F.exists("issues", lambda i: i["code"].isin(*STRUCTURAL))
        bad = F.array_compact(F.array(_issue(sound & ~ids.is_sha256(declared), "INVALID_PAYLOAD_HASH", "payload_hash"), _issue(sound & ids.is_sha256(declared) & (declared != computed_hash), "PAYLOAD_HASH_MISMATCH", "payload_hash")))
        checked = checked.withColumn("issues", F.concat("issues", bad))
    return checked.withColumn("valid", ~F.exists("issues", lambda i: i["severity"] == "ERROR"))


def split_multi(text: Column) -> Column:
    """Parts between bars or commas, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[|,]"), lambda p: F.trim(p)), lambda p: p != "")


def adapt_legacy(items: DataFrame) -> DataFrame:
    """Legacy items (url, urls, all_sources, title, topic, event_key, first_seen, last_seen) as events: ordered distinct URLs, names by place, the first one primary, revision 1."""
    first = F.when(filled(F.col("url")), F.array("url")).otherwise(F.array().cast("array<string>"))
    links = F.array_distinct(F.concat(first, split_multi(F.col("urls"))))
    names = split_multi(F.col("all_sources"))
    none = F.lit(None).cast("string")
    source = lambda u, i: F.struct(
        urls.domain(u).alias("source_id"), F.get(names, i).alias("name"), urls.domain(u).alias("domain"), u.alias("url"), none.alias("title"), none.alias("author"), none.alias("published_at"), none.alias("source_type"), (i == 0).alias("is_primary")
    )
    usable = lambda s: F.size(F.filter(s, lambda x: urls.acceptable(x["url"])))
    out = items.withColumn("sources", F.transform(links, source))
    return out.select(
        F.lit(LEGACY).alias("contract_version"), "event_key", F.lit(1).alias("revision"), "topic", "title", "first_seen", "last_seen",
        (usable(F.col("sources")) >= 2).alias("is_multi_source"), usable(F.col("sources")).alias("source_count"), F.lit(None).cast("double").alias("cluster_confidence"), none.alias("cursor"), "sources", none.alias("payload_hash"),
    )


def parse(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON payloads in either spelling of names as typed events, with the route that each takes."""
    return typed(opened(raw, payload), payload).drop("_readable", *[f"_json_{n}" for n in FIELDS])


def typed(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """parse() of payloads that are opened, whose fields stay."""
    j = lambda *names: F.coalesce(*[field(n) for n in names])
    wire = "array<struct<source_id:string,sourceId:string,name:string,domain:string,url:string,title:string,author:string,published_at:string,publishedAt:string,source_type:string,sourceType:string,is_primary:string,isPrimary:string>>"
    given = F.from_json(F.coalesce(j("sources"), F.lit("[]")), wire)

    def source(s: Column) -> Column:
        domain = F.coalesce(F.when(filled(s["domain"]), F.lower(F.trim(s["domain"]))), urls.domain(s["url"]))
        return F.struct(
            F.coalesce(s["source_id"], s["sourceId"], domain).alias("source_id"), s["name"].alias("name"), domain.alias("domain"), F.trim(s["url"]).alias("url"), s["title"].alias("title"), s["author"].alias("author"),
            F.coalesce(s["published_at"], s["publishedAt"]).alias("published_at"), F.coalesce(s["source_type"], s["sourceType"]).alias("source_type"), F.coalesce(values.flag(F.coalesce(s["is_primary"], s["isPrimary"])), F.lit(False)).alias("is_primary"),
        )

    return rows.select(
        "*",
        _route(F.col(payload), F.col("_readable"), field).alias("route"), _version(field).alias("contract_version"), F.trim(j("event_key", "eventKey")).alias("event_key"), values.whole(j("revision")).alias("revision"),
        j("topic").alias("topic"), j("title").alias("title"), j("first_seen", "firstSeen").alias("first_seen"), j("last_seen", "lastSeen").alias("last_seen"),
        values.flag(j("is_multi_source", "isMultiSource", "multiSource")).alias("is_multi_source"), values.whole(j("source_count", "sourceCount")).alias("source_count"),
        values.real(j("cluster_confidence", "clusterConfidence")).alias("cluster_confidence"), j("cursor").alias("cursor"), F.transform(given, source).alias("sources"), j("payload_hash", "payloadHash").alias("payload_hash"),
    )


def ingest(raw: DataFrame, ledger: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads (seq, payload) after a ledger (seq, event_key, revision, payload_hash): parsed, validated and decided.

    Invalid events with a key still take their revision; oversized and malformed ones never do.
    """
    from quillspark.functions.canonical import payload_hash
    from quillspark.operators import revisions

    checked = validate(parse(raw, payload).where(F.col("route").isin("V1", "LEGACY")).withColumn("_hash", payload_hash(F.col(payload))), F.col("_hash"))
    keyed = checked.where(filled(F.col("event_key"))).withColumn("payload_hash", F.coalesce("payload_hash", "_hash"))
    decided = revisions.with_ledger(ledger, keyed)
    return decided.withColumn("decision", F.when(~F.col("valid"), "INVALID").otherwise(F.col("decision")))
