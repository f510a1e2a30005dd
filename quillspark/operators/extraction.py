"""Pages to articles: one Arrow function reads the element tree once, what follows are DataFrame expressions.

The reader gives what stands in the page (metadata, body, images and captions as they come). Which images are usable
and in which order, what JSON-LD says and which image leads is decided on columns. A page of a known site
is read by the site's cleaner, unless that leaves few words and the generic reader finds more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from quillspark.functions import article, json_ld, media, urls
from quillspark.session import bound_batches

#: Hosts whose images come first.
FIRST_HOSTS = (
    "static1.srcdn.com", "static1.colliderimages.com", "static1.cbrimages.com", "static1.moviewebimages.com", "static0.gamerantimages.com", "static1.gamerantimages.com",
    "static2.gamerantimages.com", "static3.gamerantimages.com", "static1.thegamerimages.com",
)

_TEXTS, _NUMBERS = ("title", "excerpt", "shared_image", "largest_image", "site", "body_tag", "content"), ("raw_words", "words")
READ = StructType(
    [StructField(c, StringType()) for c in _TEXTS]
    + [StructField(c, IntegerType()) for c in _NUMBERS]
    + [StructField(c, ArrayType(StringType())) for c in ("json_ld", "videos", "images")]
    + [StructField("captions", MapType(StringType(), StringType()))]
)


@F.pandas_udf(READ)
def read_page(page: pd.Series, url: pd.Series) -> pd.DataFrame:
    """What the generic reader finds; a NULL page reads as an empty one."""
    return pd.DataFrame([article.read(p, u) for p, u in zip(page, url, strict=True)], columns=READ.names)


def ordered_images(found: Column) -> Column:
    """Usable images, those of known hosts first, then by URL; previews of videos are none."""
    real = F.filter(found, lambda u: media.usable(u) & urls.youtube_thumbnail_id(u).isNull())
    rated = F.transform(real, lambda u: F.struct((~F.coalesce(urls.host(u), F.lit("")).isin(*FIRST_HOSTS)).alias("later"), u.alias("url")))
    return F.transform(F.array_sort(rated), lambda r: r["url"])


def lead_image(read: Column, url: Column) -> Column:
    """The image that the page shares, else JSON-LD's, else the largest of the article, as an absolute URL; NULL if none."""
    some = lambda c: F.when(c != "", c)
    return urls.resolve(F.coalesce(some(read["shared_image"]), some(json_ld.lead_image(read["json_ld"])), some(read["largest_image"])), url)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, site, title, excerpt, content, words, body_tag, lead_image, images, captions, videos, schema) of every page."""
    bound_batches(pages.sparkSession)
    read = pages.select(F.col(id_col), F.col(url_col).alias("url"), read_page(F.col(html_col), F.col(url_col)).alias("read"))
    led = read.withColumn("lead_image", lead_image(F.col("read"), F.col("url"))).withColumn("schema", json_ld.article_fields(F.col("read.json_ld")))
    found = F.when(F.col("read.site").isNull(), ordered_images(F.col("read.images"))).otherwise(F.col("read.images"))
    images = F.filter(found, lambda u: F.coalesce(u != F.col("lead_image"), F.lit(True)))
    return led.select(
        id_col, "url", "read.site", "read.title", "read.excerpt", "read.content", "read.words", "read.body_tag", "lead_image",
        images.alias("images"), "read.captions", "read.videos", "schema",
    )
