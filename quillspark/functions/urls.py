"""URL expressions, all built-in: they stay in generated code and push no rows through Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Authority and path of a URL. The built-in parser gives NULL for URLs with malformed escapes, which feeds do hold.
_HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host, or NULL where there is none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(F.length(found) > 0, found)


def domain(url: Column, own_host: Column | None = None) -> Column:
    """Host without a leading www. own_host: the URL's host, where it is known."""
    return F.regexp_replace(host(url) if own_host is None else own_host, r"^www\.", "")


def resolve(url: Column, base: Column) -> Column:
    """A URL on the address of a page, without steps up and down: absolute ones stay, others take its scheme, host or folder."""
    at = F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*/)?", 0)
    root = F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.-]*:)", 1), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.isNotNull(), F.concat(F.when(at.endswith("/"), at).otherwise(F.concat(at, F.lit("/"))), url))
    )


def acceptable(url: Column, own_host: Column | None = None) -> Column:
    """An http or https URL with a host. own_host: the URL's host, where it is known."""
    return F.coalesce(url.rlike(r"(?i)^\s*https?://") & (host(url) if own_host is None else own_host).isNotNull(), F.lit(False))


def canonical(url: Column) -> Column:
    """Host without www and the decoded path without repeated or trailing slashes, in lower case; query and fragment go.

    Escapes that are no escapes stay as they are, and a plus sign is not a space.
    """
    path = F.regexp_extract(F.trim(url), _PATH, 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    single = F.regexp_replace(decoded, "/{2,}", "/")
    bare = F.when(single != "/", F.rtrim(single, F.lit("/"))).otherwise(single)
    joined = F.lower(F.concat(F.coalesce(domain(url), F.lit("")), bare))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(joined)


def registrable(url: Column) -> Column:
    """The last two labels of the host; the empty string where there is no host."""
    return F.coalesce(F.substring_index(domain(url), ".", -2), F.lit(""))


def origin_key(url: Column, source_domain: Column | None = None, name: Column | None = None, canonical_url: Column | None = None, republished_from: Column | None = None) -> Column:
    """Who first published: a declared republication, the canonical URL, the declared domain, the URL, the name; the first that says anything."""
    from quillspark.functions.text import comparison_key

    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    site = lambda c: F.when(registrable(c) != "", registrable(c))
    none = F.lit(None).cast("string")
    again, canon, declared = (none if c is None else filled(c) for c in (republished_from, canonical_url, source_domain))
    return F.coalesce(
        F.coalesce(site(again), comparison_key(again)) if republished_from is not None else none,
        site(canon),
        F.substring_index(F.lower(declared), ".", -2),
        site(url),
        comparison_key(F.coalesce(none if name is None else filled(name), url)),
    )


def cluster_signature(urls: Column) -> Column:
    """SHA-1 of the sorted canonical URLs; repeated ones count each."""
    canon = F.transform(F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != ""), canonical)
    return F.sha1(F.array_join(F.array_sort(canon), "|"))


def stable_id(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def item_id(guid: Column, link: Column, title: Column, published: Column) -> Column:
    """An item's own id, else a hash of its link, else of its title and date."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    last = F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(published, F.lit("")))
    return F.coalesce(F.trim(filled(guid)), stable_id(filled(link)), stable_id(last))


def dimensions(url: Column) -> Column:
    """struct(width, height) that an image URL declares: query parameters, else a -WxH suffix, else NULLs."""
    query = lambda *names: F.coalesce(*[F.try_to_number(F.regexp_extract(url, rf"[?&]{n}=(\d{{1,6}})", 1), F.lit("999999")).cast("int") for n in names])
    suffix = lambda g: F.regexp_extract(url, r"-(\d{2,5})x(\d{2,5})(?:\.|$)", g).try_cast("int")
    return F.struct(F.coalesce(query("width", "w"), suffix(1)).alias("width"), F.coalesce(query("height", "h"), suffix(2)).alias("height"))


def large_enough(url: Column) -> Column:
    """At least 600 by 315 with an aspect of 0.6 to 2.2; an image that does not declare both passes."""
    size = dimensions(url)
    w, h = size["width"], size["height"]
    fits = (w >= 600) & (h >= 315) & (w / F.when(h > 0, h)).between(0.6, 2.2)
    return F.coalesce(F.when(w.isNull() | h.isNull(), F.lit(True)).otherwise(fits), F.lit(False))


def youtube_id(url: Column) -> Column:
    """The video of a watch, short, embed or share URL; NULL for others."""
    found = F.regexp_extract(url, r"(?i)(?:youtube(?:-nocookie)?\.com/(?:embed/|shorts/|v/|watch\?(?:[^#]*&)?v=)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)


def youtube_thumbnail_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)(?:ytimg\.com|youtube\.com)/vi(?:_webp)?/([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)
