"""Several sources of one event: which are used, under what budget, and which media they bring.

A cluster is given as one row for each source, in order. Windows rank a cluster's sources and are cut by rank before they are
gathered, so that a row never holds more sources than `secondary` allows, whatever a cluster has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import body, urls
from quillspark.functions.repair import source_label
from quillspark.operators import policy

OK, DUPLICATE = "ARTICLE_BODY_OK", "DUPLICATE"
#: Sources besides the first, visible characters of a source, and least characters of a usable one.
SECONDARY, MAX_CHARS, MIN_CHARS = 2, 8000, 500


@F.pandas_udf(StringType())
def cut(markup: pd.Series, most: pd.Series) -> pd.Series:
    """body.cut() with a limit of each row's own."""
    return pd.Series([body.cut(m, int(n) if n == n and n is not None else 0) for m, n in zip(markup, most, strict=True)], dtype="object")


def _identity(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), "com$", "")


def source_name(names: Column, url: Column) -> Column:
    """The declared name that agrees with the URL's domain, else the domain's label."""
    own = _identity(F.substring_index(F.coalesce(urls.domain(url), F.lit("")), ".", 1))
    return F.coalesce(F.get(F.filter(names, lambda n: (F.coalesce(n, F.lit("")) != "") & (_identity(n) == own)), 0), source_label(url))


def qualified(sources: DataFrame, cluster: str = "cluster_id", position: str = "position", secondary: int = SECONDARY, min_chars: int = MIN_CHARS) -> DataFrame:
    """sources (cluster, position, url, title, content, ...) that count, with status and chars: the first and so many others.

    Sources without a URL are none. A URL that an earlier source has, in its canonical form, is a DUPLICATE and is not looked at.
    """
    order = Window.partitionBy(cluster).orderBy(position)
    first = sources.where("url <> ''").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= secondary + 1)
    again = F.row_number().over(Window.partitionBy(cluster, urls.canonical(F.col("url"))).orderBy("_rank")) > 1
    told = first.withColumn("_again", again)
    status = F.when(F.col("_again"), DUPLICATE).otherwise(policy.extraction_status(F.col("content"), min_chars))
    chars = F.when(F.col("_again"), 0).otherwise(F.length(policy.plain(F.col("content"))))
    return told.withColumn("status", status).withColumn("chars", chars.cast("int")).drop("_rank", "_again")


def allowances(sources: DataFrame, size: str, budget: int, cluster: str, position: str, fair: bool = False) -> DataFrame:
    """sources with `allowance`, characters of a budget for the whole cluster.

    In order: each source takes what it needs until the budget is used up; the one that crosses it is cut there. Fair: no source gets
    less than an equal share unless it needs less, and what one leaves is shared by the larger ones.
    """
    if not fair:
        before = F.coalesce(F.sum(size).over(Window.partitionBy(cluster).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sources.withColumn("allowance", F.greatest(F.lit(0), F.least(F.col(size), F.lit(budget) - before)).cast("int"))
    ascending = Window.partitionBy(cluster).orderBy(size, position)
    smaller = F.coalesce(F.sum(size).over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy(cluster)) - F.row_number().over(ascending) + 1
    shared = sources.withColumn("_share", F.greatest(F.lit(0), F.floor((F.lit(budget) - smaller) / left)))
    # The first source that needs more than an equal share of the rest sets the level for itself and all larger ones.
    short = F.first(F.when(F.col(size) > F.col("_share"), F.col("_share")), ignorenulls=True).over(ascending.rowsBetween(Window.unboundedPreceding, 0))
    return shared.withColumn("allowance", F.least(F.col(size), F.coalesce(short, F.col(size))).cast("int")).drop("_share")


def payloads(sources: DataFrame, cluster: str = "cluster_id", position: str = "position", secondary: int = SECONDARY, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, budget: int | None = None) -> DataFrame:
    """(cluster, title, content, basis, documents, used, skipped) of every cluster with two usable sources, or one that is trusted alone.

    sources: (cluster, position, url, name, title, content, published_at). Contents are cut to max_chars visible characters each, and
    fairly to a budget for all of a cluster where one is given. used and skipped say of each source (name, domain, url, title,
    published_at, status, chars). A cluster without enough usable sources has no row.
    """
    told = qualified(sources, cluster, position, secondary, min_chars)
    told = told.withColumn("domain", F.coalesce(urls.domain(F.col("url")), F.lit(""))).withColumn("source_name", source_name(F.array("name"), F.col("url")))
    used = told.where(F.col("status") == OK).withColumn("_need", F.least("chars", F.lit(max_chars)))
    used = allowances(used, "_need", budget, cluster, position, fair=True) if budget else used.withColumn("allowance", F.lit(max_chars))
    used = used.withColumn("content", cut("content", "allowance"))
    audit = F.struct(position, "source_name", "domain", "url", F.when(F.col("status") == DUPLICATE, "").otherwise(F.col("title")).alias("title"), "published_at", "status", "chars")
    document = F.struct(position, "source_name", "url", "title", "content")
    left = told.where(F.col("status") != OK).groupBy(cluster).agg(F.sort_array(F.collect_list(audit)).alias("skipped"))
    kept = used.groupBy(cluster).agg(
        F.sort_array(F.collect_list(document)).alias("documents"), F.sort_array(F.collect_list(audit)).alias("used"), F.min(policy.reliable_alone(F.col("status"), F.col("domain"))).alias("_trusted")
    )
    kept = kept.where((F.size("documents") >= 2) | F.col("_trusted"))

    def labelled(d: Column, i: Column) -> Column:
        label = F.when(i == 0, "FONTE PRINCIPAL").otherwise(F.concat(F.lit("FONTE SECUNDÁRIA "), i.cast("string")))
        text = lambda c: F.coalesce(c, F.lit(""))
        return F.concat(F.lit("=== "), label, F.lit(": "), text(d["source_name"]), F.lit(" ===\nTítulo: "), text(d["title"]), F.lit("\nURL: "), d["url"], F.lit("\n\n"), text(d["content"]))

    return kept.join(left, cluster, "left").select(
        cluster,
        F.get("documents", 0)["title"].alias("title"),
        F.array_join(F.transform("documents", labelled), "\n\n").alias("content"),
        F.when(F.size("documents") == 1, "single_source_trusted").otherwise("multi_source").alias("basis"),
        "documents",
        "used",
        F.coalesce("skipped", F.array().cast(left.schema["skipped"].dataType)).alias("skipped"),
    )


# --- Media -----------------------------------------------------------------


def variant_key(url: Column) -> Column:
    """By which forms of one image agree: case, a size in the name, and sizes asked for do not count."""
    plain = F.regexp_replace(F.lower(F.trim(url)), r"-\d{2,5}x\d{2,5}(?=\.[a-z]{3,4}(?:\?|$))", "")
    asked = F.regexp_replace(F.regexp_replace(plain, r"(?<=[?&])(?:w|h|width|height|q|quality)=[^&#]*&?", ""), r"[?&]+(?=#|$)", "")
    return F.regexp_replace(asked, "/+$", "")


def media(docs: DataFrame, cluster: str = "cluster_id", position: str = "position", most: int | None = 3, variants: bool = False) -> DataFrame:
    """(cluster, n, url, alt, caption) of the images of a cluster's sources, each once where it was seen first, up to `most` (None: all).

    docs: (cluster, position, images array of structs (url, alt, caption), lead string). A source's lead image comes after its others.
    Images are alike if their URLs are, or with variants=True if they are forms of one image. Previews of videos, data and empty URLs are none.
    """
    lead = F.when(F.coalesce("lead", F.lit("")) != "", F.array(F.struct(F.col("lead").alias("url"), F.lit("").alias("alt"), F.lit("").alias("caption")))).otherwise(F.array().cast("array<struct<url:string,alt:string,caption:string>>"))
    every = docs.select(cluster, position, F.posexplode(F.concat(F.coalesce("images", F.array().cast("array<struct<url:string,alt:string,caption:string>>")), lead)).alias("at", "image"))
    url = F.col("image.url")
    real = every.where((F.trim(url) != "") & ~F.startswith(F.trim(url), F.lit("data:")) & urls.youtube_thumbnail_id(url).isNull())
    key = variant_key(url) if variants else F.lower(F.trim(url))
    first = real.groupBy(cluster, key.alias("_key")).agg(F.min(F.struct(position, "at", "image")).alias("_first"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(cluster).orderBy(f"_first.{position}", "_first.at")))
    ranked = ranked if most is None else ranked.where(F.col("n") <= most)
    return ranked.select(cluster, "n", "_first.image.url", "_first.image.alt", "_first.image.caption")


def videos(docs: DataFrame, cluster: str = "cluster_id", position: str = "position") -> DataFrame:
    """(cluster, n, video) of the video ids of a cluster's sources (videos array), each once in order of first sight."""
    every = docs.select(cluster, position, F.posexplode("videos").alias("at", "video")).where("video <> ''")
    first = every.groupBy(cluster, "video").agg(F.min(F.struct(position, "at")).alias("_first"))
    return first.select(cluster, F.row_number().over(Window.partitionBy(cluster).orderBy("_first")).cast("int").alias("n"), "video")
