"""Which images of an article are usable, and which one leads it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import urls
from quillspark.functions.text import any_of, let

#: Words in a URL, ends of hosts and parts of file names that no content image has, and widths of thumbnails.
BAD_WORDS = ("author", "autor", "avatar", "byline", "perfil", "profile", "placeholder", "logo", "logomarca", "brand", "marca", "icon", "favicon", "sprite", "comment", "user", "usuario", "usuário")
BAD_HOSTS = ("gravatar.com", "twimg.com", "facebook.com", "fbcdn.net", "gstatic.com", "googleusercontent.com", "schema.org", "scorecardresearch.com", "doubleclick.net", "quantserve.com", "chartbeat.com", "google-analytics.com")
JUNK_NAMES = ("placeholder", "sprite", "icon", "emoji", ".svg", "cta", "read-more", "share", "logo", "banner", "lazyload", "fallback", "blank.gif", "spacer.gif", "1x1")
THUMBNAILS = ("?w=300", "?w=400", "&w=300", "&w=400")


def widest(srcset: Column) -> Column:
    """The URL of a srcset with the largest declared width; of equal ones the last, NULL of an empty set."""
    parts = F.filter(F.transform(F.split(F.coalesce(srcset, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def rated(p: Column, i: Column) -> Column:
        words = F.split(p, r"\s+")
        width = F.regexp_extract(F.coalesce(F.get(words, 1), F.lit("")), r"^(\d+)w$", 1).try_cast("int")
        return F.struct(F.coalesce(width, F.lit(0)).alias("width"), i.alias("place"), F.get(words, 0).alias("url"))

    return F.array_max(F.transform(parts, rated))["url"]


def bad_host(url: Column) -> Column:
    return let(F.coalesce(urls.host(url), F.lit("")), lambda h: F.greatest(*[h.endswith(d) for d in BAD_HOSTS]))


def junk_name(url: Column) -> Column:
    """Whether the file name shows an ornament."""
    name = F.lower(F.substring_index(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""), "/", -1))
    return let(name, lambda n: any_of(n, JUNK_NAMES))


def usable(url: Column) -> Column:
    """Whether an image may stand in an article."""
    some = (F.coalesce(url, F.lit("")) != "") & ~F.coalesce(url.startswith("data:"), F.lit(False))
    lower = let(F.lower(url), lambda u: any_of(u, BAD_WORDS) | any_of(u, THUMBNAILS))
    return F.when(some, ~bad_host(url) & ~lower & ~junk_name(url) & urls.large_enough(url)).otherwise(F.lit(False))


def featured(candidates: Column) -> Column:
    """The first usable image."""
    return F.get(F.filter(candidates, usable), F.lit(0))
