"""What models answer, without the model: damaged JSON mended, batches checked, aliases of fields, claims held against the draft.

Mending reads a text once, sign by sign, and is an Arrow function; everything after it is built from DataFrame functions.
Edge cases: NULL, empty and hopeless answers give NULL results; of repeated keys the last counts.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quillspark.functions import ids, values
from quillspark.functions.text import comparison_key, let, normal
from quillspark.operators import factual

#: The list of a batch, what each result must have, and other names of fields.
RESULTS = "resultados"
REQUIRED = ("titulo_final", "conteudo_final", "meta_description", "focus_keyphrase", "tags_sugeridas", "yoast_meta")
ALIASES = {
    "titulo_final": ("title", "titulo", "headline"), "conteudo_final": ("content_html", "conteudo", "content", "body"), "meta_description": ("meta", "description", "seo_description"),
    "slug": ("url_slug", "post_slug"), "tags_sugeridas": ("tags", "keywords", "tag_list"), "categorias": ("categories", "category"),
}
#: Kinds of claims, and what each claim of an answer must have.
CLAIM_TYPES = ("DATE", "NUMBER", "QUOTE", "ATTRIBUTION", "STATUS", "RELEASE", "AVAILABILITY", "IDENTITY", "RELATIONSHIP", "EVENT", "DESCRIPTION", "OTHER")
CLAIM_FIELDS = ("display_text", "claim_type", "location")

_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
_QUOTE = re.compile(r'\\.|"', re.S)
#: What stands behind the quote that ends a key, a value of an object, a value of an array.
_ENDS = {
    "key": re.compile(r"\s*:"),
    "{": re.compile(r'\s*(?:,\s*(?:"[^"\n]{0,200}"\s*:|\})|\}|$)'),
    "[": re.compile(r'\s*(?:,\s*(?:["{\[\]\-\d]|true\b|false\b|null\b)|\]|$)'),
}
_INNER = re.compile(r'\\(?:u[0-9a-fA-F]{4}|["\\/bfnrt])|[\\"\x00-\x1f\x7f-\x9f]')
_INSTEAD = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_BARE = re.compile(r'[^\s"{}\[\],:\x00-\x1f\x7f-\x9f]+')


def block(text: Column) -> Column:
    """The part of an answer that may be JSON: inside a fence, from the first { to the last }, else from [ to ]."""
    inside = F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(text)
    return let(inside, lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")], t))


def tokens_of(s: str) -> str | None:
    """The text as strict JSON: strings end where what follows fits their place, other quotes in them are content; commas too many go, commas between objects come."""
    out: list[str] = []
    stack: list[str] = []
    key, i = False, 0
    while i < len(s):
        c = s[i]
        if c == '"':
            end = _ENDS["key" if key else stack[-1] if stack else "["]
            last = next((m for m in _QUOTE.finditer(s, i + 1) if m[0] == '"' and end.match(s, m.end())), None)
            if last is None:
                return None
            out.append('"' + _INNER.sub(lambda m: m[0] if len(m[0]) > 1 else _INSTEAD.get(m[0], ""), s[i + 1 : last.start()]) + '"')
            i = last.end()
            continue
        if c in "{[":
            if c == "{" and out and out[-1] == "}":
                out.append(",")
            stack.append(c)
        elif c in "]}":
            if out and out[-1] == ",":
                out.pop()
            if stack:
                stack.pop()
        elif c not in ",:":
            bare = _BARE.match(s, i)
            if bare:
                out.append(bare[0])
            i = bare.end() if bare else i + 1
            continue
        out.append(c)
        key = c in "{," and bool(stack) and stack[-1] == "{"
        i += 1
    return " ".join(out)


def _loaded(s: str | None):
    try:
        return None if s is None else json.loads(s)
    except (ValueError, RecursionError):
        return None


def _first_object(s: str):
    """The first object in a text that is whole; objects inside a broken one count."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", s):
        try:
            return decoder.raw_decode(s, m.start())[0]
        except (ValueError, RecursionError):
            continue
    return None


def _results(part: str | None, whole: str | None) -> tuple[str | None, bool]:
    if not part:
        return None, False
    data, mended = _loaded(part), False
    if data is None:
        data, mended = _loaded(tokens_of(part)), True
    if data is None:
        data = _first_object(whole)
    if isinstance(data, dict):
        data = data.get(RESULTS, [data])
    return (json.dumps(data, ensure_ascii=False), mended) if isinstance(data, list) else (None, mended)


@F.pandas_udf(StructType([StructField("results", StringType()), StructField("mended", BooleanType())]))
def _mend(part: pd.Series, whole: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_results(p, w) for p, w in zip(part, whole, strict=True)], columns=["results", "mended"])


def results(text: Column) -> Column:
    """(results, mended): the answer's list of results as JSON, a single object as a list of one; NULL if nothing in it can be read."""
    return _mend(block(text), text)


def batch(listed: Column, expected: Column) -> Column:
    """Results as maps, NULL for one that is no object, reports an error or lacks a field; NULL as a whole if their number is another one."""

    def checked(item: Column) -> Column:
        def one(m: Column) -> Column:
            whole = F.lit(True)
            for name in REQUIRED:
                whole = whole & F.map_contains_key(m, name)
            rest = F.map_filter(m, lambda k, v: k != "subtitle")
            return F.when(whole & ~F.map_contains_key(m, "erro"), F.map_concat(rest, F.create_map(F.lit("subtitle"), F.coalesce(F.try_element_at(m, F.lit("subtitle")), F.lit("")))))

        return let(F.from_json(item, "map<string,string>"), one)

    return let(F.from_json(listed, "array<string>"), lambda a: F.when(F.size(a) == expected, F.transform(a, checked)))


def recovered(fields: Column) -> Column:
    """Fields that say nothing (absent, NULL, '', [], {}, 0, false) filled from the first of their other names that says something."""
    value = lambda name: F.try_element_at(fields, F.lit(name))
    said = lambda name: let(value(name), lambda v: F.when(~v.isin("", "[]", "{}", "0", "false"), v))
    filled = F.create_map(*[x for name, others in ALIASES.items() for x in (F.lit(name), F.coalesce(said(name), *[said(o) for o in others], value(name)))])
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*ALIASES))
    return F.map_concat(rest, F.map_filter(filled, lambda k, v: v.isNotNull() | F.map_contains_key(fields, k)))


def claim_answer(draft_id: Column, haystack: Column, raw: Column, most: int = 100) -> Column:
    """(claims, warnings) of a model's answer; NULL if it is no object with a list of claims.

    A claim whose text the draft does not hold is dropped: an answer can point at facts, not bring them.
    haystack is the draft's comparison key. Equal claims stay once; beyond `most` the rest is reported as cut. Text after the object is not read.
    """
    text = F.trim(raw)
    bare = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(text, r"(?i)^```[a-z]*\s*|\s*```$", "")).otherwise(text)

    def judged(m: Column, i: Column) -> Column:
        get = lambda k: F.try_element_at(m, F.lit(k))
        empty = lambda k: F.coalesce(F.trim(get(k)), F.lit("")).isin("", "[]", "{}", "0", "false")
        missing = F.array_join(F.array_compact(F.array(*[F.when(empty(k), F.lit(k)) for k in CLAIM_FIELDS])), ",")
        shown, kind = normal(get("display_text")), F.upper(F.trim(get("claim_type")))
        sure = get("confidence").try_cast("double")
        known, value = kind.isin(*CLAIM_TYPES), F.coalesce(F.nullif(get("normalized_value"), F.lit("")), get("value"))
        said = F.when(value != "", F.coalesce(values.normal_date(value), values.normal_number(value), comparison_key(value)))
        places = F.coalesce(F.from_json(get("location"), "array<string>"), F.array(get("location")))
        part = lambda k: F.nullif(comparison_key(get(k)), F.lit(""))
        type_, subject, predicate = F.when(known, kind).otherwise("OTHER"), part("subject"), part("predicate")
        claim = F.struct(
            ids.claim_id(draft_id, type_, F.coalesce(subject, F.lit("")), F.coalesce(predicate, F.lit("")), F.coalesce(said, F.lit("")), shown).alias("claim_id"),
            type_.alias("claim_type"), shown.alias("display_text"), subject.alias("normalized_subject"), predicate.alias("predicate"), said.alias("value"),
            F.filter(F.transform(places, lambda p: F.trim(p)), lambda p: p != "").alias("locations"), F.when(sure.between(0, 1), sure).alias("confidence"),
            (~F.coalesce(get("is_material"), F.lit("true")).isin("false", "0", "") & factual.material(shown)).alias("is_material"),
        )
        notes = F.array_compact(F.array(
            F.when(~known, F.concat(F.lit("CLAIM_TYPE_UNKNOWN:"), kind)),
            F.when(get("confidence").isNotNull() & sure.isNull(), "CLAIM_CONFIDENCE_NOT_NUMERIC").when(~sure.between(0, 1), "CLAIM_CONFIDENCE_OUT_OF_RANGE"),
        ))
        wrong = F.when(m.isNull(), F.concat(F.lit("CLAIM_ITEM_NOT_OBJECT:"), i.cast("string"))).when(missing != "", F.concat(F.lit("CLAIM_MISSING_FIELDS:"), i.cast("string"), F.lit(":"), missing)).when(~F.contains(haystack, comparison_key(shown)), "CLAIM_NOT_FOUND_IN_DRAFT")
        return F.struct(F.when(wrong.isNull(), claim).alias("claim"), F.when(wrong.isNotNull(), F.array(wrong)).otherwise(notes).alias("notes"))

    def answer(items: Column) -> Column:
        rows = F.transform(F.transform(F.slice(items, 1, most), lambda x: F.from_json(x, "map<string,string>")), judged)

        def whole(r: Column) -> Column:
            kept = F.filter(F.transform(r, lambda x: x["claim"]), lambda c: c.isNotNull())
            once = let(kept, lambda k: F.filter(k, lambda c, i: F.array_position(F.transform(k, lambda x: x["claim_id"]), c["claim_id"]) == i + 1))
            cut = F.when(F.size(items) > most, F.array(F.format_string(f"CLAIMS_TRUNCATED:%d>{most}", F.size(items)))).otherwise(F.array().cast("array<string>"))
            return F.struct(once.alias("claims"), F.concat(F.flatten(F.transform(r, lambda x: x["notes"])), cut).alias("warnings"))

        return F.when(items.isNotNull(), let(rows, whole))

    return let(F.from_json(bare, "struct<claims:array<string>>")["claims"], answer)
