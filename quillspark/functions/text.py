"""String expressions: match keys, normal forms, identifiers. Three ways of folding differ on purpose; each says how."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and the letters they fold to.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Typographic signs and what they stand for.
TYPOGRAPHIC, STRAIGHT = "“”„«»‘’‚–—−   ", "\"\"\"\"\"'''---   "
_EDGE = r"[\s.,;:!?\-–—\"'“”‘’()\[\]]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once. Without it, an expression that names a value several times holds as many copies of it, and copies of copies."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_letters(text: Column) -> Column:
    """Lower case, and a to z for the four other letters that (?iU) takes for them: what a pattern's letters are looked for in before the pattern."""
    # Four searches for bytes: much less than a translation letter by letter.
    for other, letter in zip("ſıİ\u212a", "siik", strict=True):
        text = F.replace(text, F.lit(other), F.lit(letter))
    return F.lower(text)


def fold(text: Column) -> Column:
    """Lower case without accents; ß as ss."""
    bare = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.replace(F.regexp_replace(bare, "[̀-ͯ]", ""), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal(text: Column) -> Column:
    """One space for white space, straight signs for typographic ones; case stays. NULL gives the empty string."""
    straight = F.replace(F.translate(F.coalesce(text, F.lit("")), TYPOGRAPHIC, STRAIGHT), F.lit("…"), F.lit("..."))
    return squeeze(straight)


def comparison_key(text: Column) -> Column:
    """normal() without punctuation at the ends, accents and case: only for comparing."""
    inner = F.regexp_replace(F.regexp_replace(normal(text), f"^{_EDGE}", ""), f"{_EDGE}$", "")
    return squeeze(fold(inner))


def title_key(title: Column) -> Column:
    """Key for near matches of titles, which keeps accents: no quotes, other signs as one space."""
    lower = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    bare = F.regexp_replace(lower, "[\"'`´“”‘’]", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9à-ÿ]+", " "))


def paragraph_key(text: Column) -> Column:
    """Fingerprint of a paragraph: folded letters and digits, all else one space."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def heading_key(text: Column) -> Column:
    """Fingerprint of a heading, which keeps punctuation."""
    return squeeze(fold(F.coalesce(text, F.lit(""))))


def block_key(text: Column) -> Column:
    """Key of a blocked topic or category: folded, one hyphen for runs of space, underscore and hyphen."""
    return F.regexp_replace(fold(F.trim(F.coalesce(text, F.lit("")))), r"[\s_-]+", "-")


def tokens(key: Column) -> Column:
    """Distinct words of a key; none of the empty key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def overlap(left: Column, right: Column) -> Column:
    """Jaccard overlap of the words of two comparison keys; 0 if either has none."""

    def share(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        either = F.size(p["a"]) + F.size(p["b"]) - both
        return F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), both / F.nullif(either, F.lit(0))).otherwise(F.lit(0.0))

    return let(F.struct(tokens(left).alias("a"), tokens(right).alias("b")), share)


def sentences(text: Column) -> Column:
    # F.trim itself would get a sentence's place as the characters to be trimmed.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def without_sentences(text: Column, needles: list[str]) -> Column:
    """The text without the sentences that hold any of the needles."""
    held = lambda s: ~F.exists(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.contains(F.lower(s), n))
    return F.array_join(F.filter(sentences(text), held), " ")


def words(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def at_boundary(text: Column, limit: int) -> Column:
    """struct(text, truncated): cut at the last space if that keeps over 60 % of the limit, with an ellipsis."""
    whole = normal(text)
    window = F.substring(whole, 1, limit)
    last = F.lit(limit) - F.instr(F.reverse(window), " ")
    cut = F.when((F.instr(window, " ") > 0) & (last > limit * 0.6), F.left(window, last)).otherwise(window)
    short = (F.length(whole) <= limit) | F.lit(limit <= 0)
    return F.struct(F.when(short, whole).otherwise(F.concat(F.rtrim(cut), F.lit("…"))).alias("text"), (~short).alias("truncated"))


def within(text: Column, limit: int, share: float = 0.8) -> Column:
    """Plain cut at the last space if that keeps the share of the limit."""
    window = F.substring(text, 1, limit)
    last = F.lit(limit) - F.instr(F.reverse(window), " ")
    cut = F.when((F.instr(window, " ") > 0) & (last >= limit * share), F.left(window, last)).otherwise(window)
    return F.when(F.length(text) <= limit, text).otherwise(F.rtrim(cut))


def slug(text: Column, limit: int = 200) -> Column:
    """Folded words joined by hyphens, at most limit characters."""
    joined = F.regexp_replace(fold(F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", "-")), "[^a-z0-9]+", "-")
    return F.trim(F.left(F.trim(joined, F.lit("-")), F.lit(limit)), F.lit("-"))


def is_slug(text: Column, limit: int = 200) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(text) <= limit), F.lit(False))


def tags(values: Column, longest: int = 60, most: int = 12) -> Column:
    """Trimmed, not too long, the first of each spelling without regard to case, at most so many."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (F.coalesce(v, F.lit("")) != "") & (F.length(v) <= longest))
    fresh = F.filter(clean, lambda v, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda w: F.lower(w) == F.lower(v)))
    return F.slice(fresh, 1, most)


def evidence_lines(values: Column) -> Column:
    """At most 10 lines of at most 200 characters, white space squeezed."""
    return F.slice(F.filter(F.transform(values, lambda v: F.left(squeeze(v), F.lit(200))), lambda v: F.coalesce(v, F.lit("")) != ""), 1, 10)


def link_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct folded words of at least three letters or digits that are no stop words."""
    found = F.filter(F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in stopwords]))


def any_of(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether the text holds one of a few fixed strings."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return F.coalesce(out, F.lit(False))


def hits(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """How many of a few fixed strings the text holds."""
    return sum((F.coalesce(F.contains(text, F.lit(n)).cast("int"), F.lit(0)) for n in needles), F.lit(0))
