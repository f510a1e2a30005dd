"""Search in JSON-LD, that is JSON of unknown depth, on Spark's variant type and without Python.

A walk is a number of rounds that each replace the values of an array by what is in them, where they stand: the order of
arrays stays that of the text (a variant's keys are in alphabetical order). Every round reads each value once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let

#: Types of nodes that describe an article, and keys under which an image's URL may stand.
ARTICLE_TYPES = ("NewsArticle", "Article", "BlogPosting")
URL_KEYS = ("url", "src", "href", "content")


def parse(text: Column) -> Column:
    """A variant, or NULL for what is no JSON; a comma before a closing bracket is forgiven."""
    return F.try_parse_json(F.regexp_replace(text, r",\s*([}\]])", "$1"))


def items(v: Column) -> Column:
    """Values of an array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def fields(v: Column) -> Column:
    """Keys and values of an object, else NULL."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def string(v: Column, path: str = "$") -> Column:
    """The string at a path; NULL for anything else."""
    return let(F.try_variant_get(v, path, "variant"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _none() -> Column:
    return F.array().cast("array<variant>")


def documents(scripts: Column) -> Column:
    """Objects of the scripts in order: a script is one object or a list of them; broken ones give none."""
    each = F.transform(scripts, lambda s: let(parse(s), lambda v: F.when(v.isNull(), _none()).otherwise(F.coalesce(items(v), F.array(v)))))
    return F.filter(F.coalesce(F.flatten(each), _none()), lambda v: fields(v).isNotNull())


def find_article(scripts: Column, types: tuple[str, ...] = ARTICLE_TYPES) -> Column:
    """The first object of one of the types: of a script itself, or in its @graph where it has one."""

    def graph(v: Column) -> Column:
        own = F.try_variant_get(v, '$["@graph"]', "variant")
        return F.when(F.map_contains_key(fields(v), "@graph"), F.coalesce(items(own), _none())).otherwise(F.array(v))

    nodes = F.flatten(F.transform(documents(scripts), graph))
    return F.get(F.filter(nodes, lambda v: string(v, '$["@type"]').isin(*types)), 0)


def find_all(scripts: Column, types: tuple[str, ...] = ARTICLE_TYPES, depth: int = 6) -> Column:
    """All objects of the types down to a depth, each before those in it."""
    nodes = F.transform(documents(scripts), lambda v: F.struct(v.alias("v"), F.lit(False).alias("open")))
    for _ in range(depth):

        def opened(n: Column) -> Column:
            below = F.coalesce(items(n["v"]), F.map_values(fields(n["v"])), _none())
            below = F.transform(below, lambda c: F.struct(c.alias("v"), F.lit(False).alias("open")))
            return F.when(n["open"], F.array(n)).otherwise(F.concat(F.array(F.struct(n["v"].alias("v"), F.lit(True).alias("open"))), below))

        nodes = F.flatten(F.transform(nodes, opened))
    typed = F.filter(nodes, lambda n: string(n["v"], '$["@type"]').isin(*types))
    return F.transform(typed, lambda n: n["v"])


def url_of(image: Column, depth: int = 4) -> Column:
    """The first URL of an image given as a string, a list or an object, nested to a depth; NULL if there is none."""
    found = F.array(image)
    for _ in range(depth):

        def below(v: Column) -> Column:
            # Of an object the named keys come first, if they hold a string or a list.
            keyed = [F.try_variant_get(v, f"$.{k}", "variant") for k in URL_KEYS]
            first = F.array_compact(F.array(*[F.when(F.schema_of_variant(x).rlike("^(STRING|ARRAY)"), x) for x in keyed]))
            return F.coalesce(items(v), F.concat(first, F.map_values(fields(v))), F.array(v))

        found = F.flatten(F.transform(found, below))
    texts = F.transform(found, lambda v: F.trim(string(v)))
    return F.get(F.filter(texts, lambda t: t != ""), 0)


def article_fields(scripts: Column) -> Column:
    """struct(headline, description, image, type) of the first article, or NULL."""
    return let(
        find_article(scripts),
        lambda v: F.when(
            v.isNotNull(),
            F.struct(
                F.coalesce(F.nullif(string(v, "$.headline"), F.lit("")), string(v, "$.name")).alias("headline"),
                string(v, "$.description").alias("description"),
                url_of(F.try_variant_get(v, "$.image", "variant")).alias("image"),
                string(v, '$["@type"]').alias("type"),
            ),
        ),
    )


def lead_image(scripts: Column) -> Column:
    """The image that the first script names: of its object, or the first object of its list; the first of several."""
    first = let(parse(F.get(scripts, 0)), lambda v: F.coalesce(F.get(items(v), 0), v))
    image = let(F.try_variant_get(first, "$.image", "variant"), lambda v: F.coalesce(F.get(items(v), 0), v))
    return let(image, lambda v: F.coalesce(string(v), string(v, "$.url")))
