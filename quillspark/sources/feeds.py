"""Feeds as Spark readers: landed RSS, sitemaps and JSON envelopes. Fetching is the lander's work; Spark reads what has landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators.contract import split_multi
from quillspark.operators.coverage import first_by_key

#: Patterns of dates in feeds, in the order in which they are tried.
FORMATS = ("EEE, d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def published(value: Column) -> Column:
    """A feed's date in any of its spellings; NULL if it has none."""
    named = F.regexp_replace(value, "^[A-Z][a-z]{2}, ", "")
    plain = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in FORMATS[1:]])
    return F.coalesce(plain, F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss Z")))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files, one row each."""
    schema = "guid string, link string, title string, pubDate string, author string, description string, `sf:event_key` string, `sf:urls` string, `sf:topic` string, `sf:multi_source` string, `sf:source_count` string, `sf:primary_source` string, `sf:all_sources` string, `sf:first_seen` string, `sf:last_seen` string"
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(schema).load(path)


def sitemap(spark: SparkSession, path: str, limit: int = 50, allow: str | None = None, deny: str | None = None) -> DataFrame:
    """Entries of landed sitemaps (gzip as well), newest first, at most `limit`."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    kept = rows.where(F.col("loc").isNotNull())
    kept = kept.where(F.col("loc").rlike(allow)) if allow else kept
    kept = kept.where(~F.col("loc").rlike(deny)) if deny else kept
    return kept.orderBy(F.desc_nulls_last(published(F.col("lastmod"))), "loc").limit(limit)


def envelopes(items: DataFrame, *columns: str) -> DataFrame:
    """The embedded contract document of an item: the first of the columns that holds JSON; items without one pass as they are."""
    found = F.coalesce(*[F.when(F.try_parse_json(F.col(c)).isNotNull() & F.startswith(F.trim(F.col(c)), F.lit("{")), F.col(c)) for c in columns])
    return items.withColumn("payload", found)


def normalise(items: DataFrame) -> DataFrame:
    """RSS items with an id, a date, parsed cluster fields and their signature."""
    c = F.col
    sf = lambda n: F.coalesce(c(f"`sf:{n}`"), F.lit(""))
    links = F.filter(F.transform(F.split(sf("urls"), F.when(F.contains(sf("urls"), F.lit("|")), F.lit("\\|")).otherwise(F.lit(","))), lambda u: F.trim(u)), lambda u: u != "")
    multi = F.lower(F.trim(sf("multi_source"))).isin("1", "true", "yes", "sim")
    count = F.coalesce(sf("source_count").try_cast("int"), F.lit(0))
    cluster = (sf("event_key") != "") & multi & (count >= 2)
    return items.select(
        urls.item_id(c("guid"), c("link"), c("title"), c("pubDate")).alias("id"),
        c("link").alias("url"),
        F.trim("title").alias("title"),
        published(c("pubDate")).alias("published"),
        c("author"),
        c("description").alias("summary"),
        sf("event_key").alias("event_key"),
        multi.alias("multi_source"),
        F.when(count > 0, count).otherwise(F.size(links)).alias("source_count"),
        cluster.alias("is_cluster"),
        links.alias("urls"),
        split_multi(sf("all_sources")).alias("all_sources"),
        sf("primary_source").alias("primary_source"),
        sf("topic").alias("topic"),
        sf("first_seen").alias("first_seen"),
        sf("last_seen").alias("last_seen"),
        F.when(cluster & (F.size(links) >= 2), urls.cluster_signature(links)).alias("cluster_signature"),
        ((sf("event_key") != "") | (sf("urls") != "") | (sf("topic") != "") | (sf("source_count") != "") | (sf("multi_source") != "")).alias("has_meta"),
    )


def enrich(items: DataFrame, config: DataFrame) -> DataFrame:
    """Items (with source_id) against the feed configuration (source_id, origin, topic, source_name, priority)."""
    cfg = config.select("source_id", F.col("origin").alias("_origin"), F.col("topic").alias("_topic"), F.col("source_name").alias("_name"), F.col("priority").alias("_priority"))
    filled = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    c = F.col
    joined = items.join(cfg, "source_id", "left")
    origin = F.coalesce(filled(c("_origin")), F.when(c("has_meta"), "superfeed").otherwise("fallback"))
    name = F.coalesce(filled(c("_name")), c("source_id"))
    names = F.when(F.size("all_sources") > 0, c("all_sources")).otherwise(F.array(F.coalesce(filled(c("primary_source")), name)))
    links = F.array_distinct(F.concat(F.when(filled(c("url")).isNotNull() & ~F.array_contains("urls", c("url")), F.array("url")).otherwise(F.array().cast("array<string>")), c("urls")))
    out = joined.withColumns({"origin": origin, "all_sources": names, "urls": links})
    return out.withColumns({
        "topic": F.coalesce(filled(c("topic")), c("_topic")),
        "priority": F.coalesce(c("_priority"), F.when(c("origin") == "fallback", 10).otherwise(100)),
        "multi_source": c("multi_source") | c("is_cluster"),
        "primary_source": F.coalesce(filled(c("primary_source")), F.get("all_sources", F.lit(0))),
        "additional_urls": F.filter("urls", lambda u: u != c("url")),
        "cluster_signature": F.coalesce(c("cluster_signature"), F.when((c("origin") == "superfeed") & c("is_cluster") & (F.size("urls") >= 2), urls.cluster_signature(c("urls")))),
        "canonical_url": urls.canonical(c("url")),
        "normalized_title": text.title_key(c("title")),
    }).drop("_origin", "_topic", "_name", "_priority")


def read(items: DataFrame, config: DataFrame, deny_title: str | None = None, only_clusters: bool = False) -> DataFrame:
    """A feed as the pipeline takes it: filtered, enriched, the first of each key, clusters and several sources first, newest first."""
    kept = items.where(~F.coalesce(F.col("title").rlike(deny_title), F.lit(False))) if deny_title else items
    rich = enrich(kept, config)
    rich = rich.where("is_cluster") if only_clusters else rich
    once = first_by_key(rich, [F.col("source_id"), F.col("id")])
    return once.orderBy(F.desc(F.col("origin") == "superfeed"), F.desc("multi_source"), F.desc_nulls_last("published"), "id")


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """Draft artifacts with the declared schema; unknown keys are dropped."""
    from quillspark import schemas

    return spark.read.schema(schemas.DRAFT).option("multiLine", "true").json(path)


def policy(spark: SparkSession, path: str) -> dict:
    """A gate policy, read through Spark and checked; there is no fallback for a policy that is not there or says nothing."""
    import json

    text_of = spark.read.text(path, wholetext=True).first()[0]
    out = json.loads(text_of)
    if not out.get("policyVersion") or not out.get("enabledRules"):
        raise ValueError(f"{path}: a policy needs policyVersion and enabledRules")
    return out
