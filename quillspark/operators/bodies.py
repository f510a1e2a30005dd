"""Bodies of articles as columns: internal links, images and videos, figures, credits, last cleaning. NULL bodies stay NULL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from quillspark.functions import body
from quillspark.functions.repair import source_label
from quillspark.functions.text import squeeze
from quillspark.operators.entities import BLOCK_BYTES, occurrences
from quillspark.session import bound_batches

#: Dictionaries of links that a worker keeps.
LINKERS = 16
LINKED = StructType([StructField("html", StringType()), StructField("links", ArrayType(StringType()))])


def _each(f: Callable, kind=StringType()):
    """A function of one text as a function of columns."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, kind)


def _listed(values) -> list:
    return [] if values is None else [v for v in values if v is not None]


#: Every image in a figure with description and caption; the same without captions.
fix_figures = _each(body.fix_figures)
fix_figures_only = _each(lambda x: body.fix_figures(x, with_captions=False))
without_credits = _each(body.without_credits)
images_stacked = _each(body.images_stacked, BooleanType())
clean_caption = _each(body.clean_caption)


@F.pandas_udf(StringType())
def finish(html: pd.Series, title: pd.Series) -> pd.Series:
    """Names spelled and captions cleaned, with the article's title to tell what an image shows."""
    return pd.Series([body.finish(h, t) for h, t in zip(html, title, strict=True)], dtype="object")


def merge_images(most: int = 6, spread: bool = False):
    """A function of a body and an array of structs (url, alt, caption)."""

    @F.pandas_udf(StringType())
    def run(html: pd.Series, images: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else body.merge_images(h, _listed(i), most, spread) for h, i in zip(html, images, strict=True)], dtype="object")

    return run


def merge_videos(most: int = 2, spread: bool = False):
    """A function of a body and an array of addresses."""

    @F.pandas_udf(StringType())
    def run(html: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else body.merge_videos(h, _listed(u), most, spread) for h, u in zip(html, urls, strict=True)], dtype="object")

    return run


def without_schemas(html: Column) -> Column:
    """Without JSON-LD scripts of the source; other scripts stay."""
    return F.regexp_replace(html, r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>.*?</script>""", "")


#: Markup of the credit line.
_CREDIT = '<p class="mn-source-credit-line" style="margin:28px 0 0 0;padding-top:10px;border-top:1px solid rgba(127,127,127,0.18);font-size:12px;line-height:1.5;color:inherit;"><span style="font-weight:600;opacity:0.74;">'
_CREDIT_LINK = 'target="_blank" rel="noopener noreferrer nofollow" style="color:inherit;opacity:0.82;text-decoration:underline;text-decoration-color:rgba(127,127,127,0.45);text-underline-offset:2px;">'


def with_credits(html: Column, primary: Column, others: Column) -> Column:
    """The body with a line of links to its sources, each once in order; unchanged without any."""
    urls = F.filter(F.transform(F.concat(F.array(primary), F.coalesce(others, F.array().cast("array<string>"))), lambda u: F.trim(u)), lambda u: F.coalesce(u, F.lit("")) != "")
    urls = F.array_distinct(urls)
    quoted = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    links = F.array_join(F.transform(urls, lambda u: F.concat(F.lit('<a href="'), quoted(u), F.lit(f'" {_CREDIT_LINK}'), quoted(source_label(u)), F.lit("</a>"))), " ")
    line = F.concat(F.lit(_CREDIT), F.when(F.size(urls) == 1, "Fonte").otherwise("Fontes"), F.lit(":</span> "), links, F.lit("</p>"))
    return F.when((F.size(urls) > 0) & (html != ""), F.concat(F.regexp_replace(html, r"\s+$", ""), F.lit("\n"), line)).otherwise(html)


# --- Internal links --------------------------------------------------------


def _link(r) -> body.Link:
    get = r.get if isinstance(r, dict) else lambda k: r[k]
    return body.Link(get("link"), (get("title") or "").strip(), tuple(_listed(get("keywords"))), frozenset(_listed(get("categories"))), bool(get("pillar")), int(get("position")))


def link_bodies(articles: DataFrame, links: DataFrame, html_col: str = "html", categories_col: str | None = None, most: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """articles with links to other pages put into their bodies, and a column `links` of the pages linked.

    links: (link, title, keywords, categories, pillar, position). The table's size is measured: up to `block_bytes` it is sent to the
    tasks whole. A larger one is searched for by its keywords in blocks first, so that each body gets only pages that it
    names, and those that it would fall back to; the outcome is the same. Pages without link or keywords are none.
    """
    spark = articles.sparkSession
    bound_batches(spark)
    columns = ["link", "title", "keywords", "categories", "pillar", "position"]
    usable = links.select(*columns).where("link <> '' and size(filter(keywords, k -> trim(k) <> '')) > 0")
    size = usable.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*columns)))), F.lit(0)).alias("n")).first()["n"]
    own = F.col(categories_col) if categories_col else F.array().cast("array<int>")
    kept = [F.col(f"`{c}`") for c in articles.columns if c not in (html_col, "links")]

    def given(some: DataFrame) -> list[body.Link]:
        return [_link(r) for r in some.collect()]

    if size <= block_bytes:
        sent = spark.sparkContext.broadcast(given(usable))
        linkers: dict[frozenset[int], body.Linker] = {}

        @F.pandas_udf(LINKED)
        def run(html: pd.Series, categories: pd.Series) -> pd.DataFrame:
            wanted = [frozenset(_listed(c)) for c in categories]
            # One dictionary for each set of categories, kept from batch to batch unless there are many.
            if len(linkers) > LINKERS:
                linkers.clear()
            linkers.update({c: body.Linker(sent.value, c) for c in set(wanted) if c not in linkers})
            return pd.DataFrame([body.add_links(h, linkers[c], c, most) for h, c in zip(html, wanted, strict=True)], columns=LINKED.names)

        linked = articles.withColumn("_linked", run(F.col(html_col), own))
    else:
        # What a body falls back to: the first page of each category, the first pillar, the first of all. As many as there are categories.
        every = F.struct(*columns)
        first = usable.select(F.explode("categories").alias("c"), every.alias("l")).groupBy("c").agg(F.min_by("l", "l.position").alias("l")).select("l.*")
        some = usable.groupBy("pillar").agg(F.min_by(every, "position").alias("l")).select("l.*")
        sent = spark.sparkContext.broadcast(given(first.unionByName(some)))
        key = lambda c: F.lower(squeeze(c))
        keyed = usable.select(every.alias("l"), F.explode("keywords").alias("k")).select("l", key(F.col("k")).alias("name"))
        mark = F.sha2(F.col(html_col), 256)
        texts = articles.select(mark.alias("_mark"), F.col(html_col).alias("text")).where("text is not null").dropDuplicates(["_mark"])
        named = occurrences(texts, keyed.select("name"), "_mark", overlaps=True, block_bytes=block_bytes).select("_mark", "name").distinct()
        pages = named.join(keyed, "name").groupBy("_mark").agg(F.collect_set(F.to_json("l")).alias("_pages"))

        @F.pandas_udf(LINKED)
        def run_named(html: pd.Series, categories: pd.Series, pages: pd.Series) -> pd.DataFrame:
            import json

            out = [body.add_links(h, [_link({c: None for c in columns} | json.loads(p)) for p in _listed(ps)] + sent.value, frozenset(_listed(c)), most) for h, c, ps in zip(html, categories, pages, strict=True)]
            return pd.DataFrame(out, columns=LINKED.names)

        linked = articles.withColumn("_mark", mark).join(pages, "_mark", "left").withColumn("_linked", run_named(F.col(html_col), own, F.col("_pages")))
    return linked.select(*kept, F.col("_linked.html").alias(html_col), F.col("_linked.links").alias("links"))
