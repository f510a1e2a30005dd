"""Dates and quantities in text, as ordered rules over built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import comparison_key, fold, let, normal

#: Month names and their numbers.
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
#: Words that multiply a number.
MULTIPLIERS = {
    "mil": 10**3, "milhao": 10**6, "milhoes": 10**6, "million": 10**6, "millions": 10**6, "bilhao": 10**9, "bilhoes": 10**9,
    "billion": 10**9, "billions": 10**9, "trilhao": 10**12, "trilhoes": 10**12,
}
#: Currency signs and codes.
CURRENCIES = {"r$": "BRL", "us$": "USD", "u$s": "USD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def plausible(year: Column, month: Column, day: Column) -> Column:
    """Bounds only: 1900 to 2200, 1 to 12, 1 to 31."""
    return year.between(1900, 2200) & month.between(1, 12) & day.between(1, 31)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normal_date(text: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM or YYYY, never more precise than the text; NULL if it has no date. The first rule that finds a plausible one wins."""
    return let(normal(text), _date_of)


def _date_of(t: Column) -> Column:
    num = lambda c: c.try_cast("int")
    month = lambda c: _lookup(MONTHS, fold(c))
    show = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    iso, dmy = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
    pt, en = r"(?i)\b(\d{1,2})\s*(?:de\s+)?([a-zçã]+)\s*(?:de\s+)?(\d{4})\b", r"\b([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\b"
    iso_month, pt_month, en_month = r"\b(\d{4})-(\d{2})\b", r"(?i)\b([a-zçã]+)\s+de\s+(\d{4})\b", r"\b([A-Za-z]+)\s+(\d{4})\b"

    def full(pattern: str, y: int, m: int, d: int, named: bool) -> Column:
        year, day = num(_part(t, pattern, y)), num(_part(t, pattern, d))
        mon = month(_part(t, pattern, m)) if named else num(_part(t, pattern, m))
        return let(F.struct(year.alias("y"), mon.alias("m"), day.alias("d")), lambda p: F.when(plausible(p["y"], p["m"], p["d"]), show(p["y"], p["m"], p["d"])))

    def monthly(pattern: str, y: int, m: int, named: bool) -> Column:
        year = num(_part(t, pattern, y))
        mon = month(_part(t, pattern, m)) if named else num(_part(t, pattern, m))
        return let(F.struct(year.alias("y"), mon.alias("m")), lambda p: F.when(p["m"].between(1, 12), F.format_string("%04d-%02d", p["y"], p["m"])))

    return F.coalesce(
        full(iso, 1, 2, 3, False),
        full(dmy, 3, 2, 1, False),
        full(pt, 3, 2, 1, True),
        full(en, 3, 1, 2, True),
        monthly(iso_month, 1, 2, False),
        monthly(pt_month, 2, 1, True),
        monthly(en_month, 2, 1, True),
        _part(t, r"\b((?:19|20)\d{2})\b", 1),
    )


def dates_conflict(left: Column, right: Column) -> Column:
    """Whether two normal dates differ at the precision they share."""

    def clash(p: Column) -> Column:
        shared = F.least(F.length(p["l"]), F.length(p["r"]))
        return F.coalesce((F.left(p["l"], shared) != F.left(p["r"], shared)) & (p["l"] != "") & (p["r"] != ""), F.lit(False))

    return let(F.struct(left.alias("l"), right.alias("r")), clash)


def decimal(raw: Column) -> Column:
    """A number in either style of separators; NULL if it is none."""
    return let(F.replace(F.trim(raw), F.lit(" "), F.lit("")), _decimal_of)


def _decimal_of(text: Column) -> Column:
    comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    drop = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    last = lambda s: F.length(F.substring_index(text, s, -1))
    both = F.when(last(",") < last("."), F.replace(drop(text, "."), F.lit(","), F.lit("."))).otherwise(drop(text, ","))
    only_comma = F.when(last(",") <= 2, F.replace(text, F.lit(","), F.lit("."))).otherwise(drop(text, ","))
    only_dot = F.when((last(".") == 3) & (F.length(drop(text, ".")) > 3), drop(text, ".")).otherwise(text)
    plain = F.when(comma & dot, both).when(comma, only_comma).when(dot, only_dot).otherwise(text)
    return let(plain, lambda p: F.when(p.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), p.try_cast("double")))


def shown(value: Column) -> Column:
    """A whole number without a fraction, others with at most 10 significant digits."""
    return let(value, _shown)


def _shown(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    digits = F.greatest(F.lit(0), F.lit(9) - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300)))).cast("int"))
    fixed = F.format_string("%.10f", F.round(value, 10))
    short = F.regexp_replace(F.regexp_replace(F.when(digits >= 10, fixed).otherwise(F.format_string("%.9f", value)), "0+$", ""), r"\.$", "")
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).when(value.isNotNull(), short)


def normal_number(text: Column) -> Column:
    """A quantity with its unit: a percentage, else a currency amount, else a plain number; currencies are never converted."""
    return let(F.lower(normal(text)), _number_of)


def _number_of(t: Column) -> Column:
    money, plain = r"(r\$|us\$|u\$s|\$|€|£|¥|brl|usd|eur|gbp)\s*(-?[\d.,]+)\s*([a-zçãõ]+)?", r"(-?[\d.,]+)\s*([a-zçãõ]+)?"
    times = lambda w: F.coalesce(_lookup(MULTIPLIERS, w), F.lit(1))
    percent = let(decimal(_part(t, r"(-?[\d.,]+)\s*%", 1)), lambda p: F.concat(shown(p), F.lit("%")))
    amount = F.struct(_part(t, money, 1).alias("sign"), decimal(_part(t, money, 2)).alias("n"), comparison_key(_part(t, money, 3)).alias("word"))
    code = lambda a: F.coalesce(_lookup(CURRENCIES, a["sign"]), F.upper(a["sign"]))
    currency = let(amount, lambda a: F.when(a["n"].isNotNull(), F.concat_ws(" ", code(a), shown(a["n"] * times(a["word"])))))
    counted = F.struct(decimal(_part(t, plain, 1)).alias("n"), comparison_key(_part(t, plain, 2)).alias("unit"))
    kept = lambda c: (c["unit"] != "") & (times(c["unit"]) == 1)
    number = let(counted, lambda c: F.when(c["n"].isNotNull(), F.concat_ws(" ", shown(c["n"] * times(c["unit"])), F.when(kept(c), c["unit"]))))
    return F.coalesce(percent, currency, number)


def unit_and_value(number: Column) -> Column:
    """struct(unit, value) of a normal number."""
    return let(F.trim(number), _unit_of)


def _unit_of(t: Column) -> Column:
    first, second = F.substring_index(t, " ", 1), F.when(F.contains(t, F.lit(" ")), F.substring(t, F.instr(t, " ") + 1, F.length(t)))
    code = first.rlike("^[A-Z]{3}$")
    unit = F.when(t.endswith("%"), F.lit("%")).when(second.isNull(), F.lit("")).when(code, first).otherwise(second)
    value = F.when(t.endswith("%"), decimal(F.left(t, F.length(t) - 1))).when(second.isNull(), decimal(t)).when(code, decimal(second)).otherwise(decimal(first))
    return F.struct(unit.alias("unit"), value.alias("value"))


def numbers_conflict(left: Column, right: Column) -> Column:
    """Whether two quantities of the same unit differ; different units never conflict."""
    both = F.struct(left.alias("l"), right.alias("r"), unit_and_value(left).alias("a"), unit_and_value(right).alias("b"))

    def clash(p: Column) -> Column:
        differ = F.when(p["a"]["value"].isNull() | p["b"]["value"].isNull(), p["l"] != p["r"]).otherwise(F.abs(p["a"]["value"] - p["b"]["value"]) > 1e-9)
        return F.coalesce((p["l"] != "") & (p["r"] != "") & (p["l"] != p["r"]) & (p["a"]["unit"] == p["b"]["unit"]) & differ, F.lit(False))

    return let(both, clash)


def instant(text: Column) -> Column:
    """ISO 8601 with any offset as a UTC time ending in Z, a time without offset as UTC; what is no time stays as it is."""
    return let(text, _instant)


def _instant(text: Column) -> Column:
    time = F.try_to_timestamp(F.regexp_replace(F.trim(text), "[Zz]$", "+00:00"))
    looks = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}){0,2}([.,]\d+)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$")
    base = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(time, "SSSSSS")
    return F.coalesce(F.when(looks & time.isNotNull(), F.concat(base, F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(F.lit("")), F.lit("Z"))), text)


def flag(text: Column) -> Column:
    """Yes and no in the spellings of the wire; NULL for others."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "sim", "y"), F.lit(True)).when(t.isin("0", "false", "no", "nao", "não", "n", ""), F.lit(False))


def whole(text: Column, default: int | None = None) -> Column:
    """An integer; NULL or empty gives the default, anything else that is none gives -1."""
    empty = F.coalesce(text, F.lit("")) == ""
    return F.when(empty, F.lit(default).cast("int")).otherwise(F.coalesce(F.trim(text).try_cast("int"), F.lit(-1)))


def real(text: Column) -> Column:
    """A number; NULL or empty gives NULL, anything else that is none gives NaN."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan"))))
