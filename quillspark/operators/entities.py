"""Names in texts: found by dictionary, taken from sources, and corrected in what was rewritten."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillspark.functions import names as dictionary
from quillspark.functions.text import let, squeeze
from quillspark.operators.qa import entity_kind, nearest_entity

#: Bytes of names that one pass over the texts looks for. A larger dictionary takes a pass for each block of it.
BLOCK_BYTES = 64_000_000


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("fixes", ArrayType(StringType()))]))
def spelled(text: pd.Series) -> pd.DataFrame:
    """A text with the known names as they are written, and the changes."""
    return pd.DataFrame([dict(zip(("text", "fixes"), dictionary.spelled(t), strict=True)) for t in text], columns=["text", "fixes"])


def occurrences(texts: DataFrame, names: DataFrame, id_col: str, text_col: str = "text", overlaps: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, start, end, name, found) of every name (a column `name` of names) in every text, in characters from 0.

    The dictionary's size is measured first. It is sent to the tasks whole if it is no larger than a block, else in blocks dealt by
    the names' hash, each of which reads the texts once; matches of one row that overlap are then settled among its blocks' matches.
    Null texts and names have no matches; repeated rows of texts are told apart.
    """
    spark = texts.sparkSession
    known = names.where("name <> ''").select("name").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    kind = dict(texts.dtypes)[id_col]
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def found(block: int, settled: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(tuple(sorted(r["name"] for r in known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).toLocalIterator())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(k, *m) for k, t in enumerate(b.column(2).to_pylist()) for m in dictionary.matches(t, sent.value, not settled)]
                k, start, end, i = zip(*out, strict=True) if out else ((), (), (), ())
                at = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([sent.value[x] for x in i], pa.string())],
                    ["row", "id", "start", "end", "name"],
                )

        return rows.mapInArrow(run, f"row bigint, id {kind}, start int, end int, name string")

    every = found(0, settled=not overlaps and blocks == 1)
    for block in range(1, blocks):
        every = every.union(found(block, False))
    if blocks > 1 and not overlaps:
        # One text's matches, which its own length bounds.
        every = every.groupBy("row").applyInPandas(_settle, every.schema)
    return every.select(F.col("id").alias(id_col), "start", "end", "name")


def _settle(own: pd.DataFrame) -> pd.DataFrame:
    own = own.sort_values(["start", "end", "name"], ascending=[True, False, True]).reset_index(drop=True)
    kept = [i for _, _, i in dictionary.leftmost(list(zip(own["start"], own["end"], own.index, strict=True)))]
    return own.loc[kept]


# --- Names of sources ------------------------------------------------------

#: Patterns of capitalised sequences and years, known studios, and words that only begin sentences.
_CAPITAL = r"(?:[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][\wÁÀÂÃÉÊÍÓÔÕÚÇáàâãéêíóôõúç'’.-]*|[A-Z]{2,})"
#: The loops are possessive: Java matches other loops by recursion, and a long run of capitalised words would end the stack and the executor.
#: Nothing is lost, since what follows a loop never begins as another round of it does.
SEQUENCE = rf"(?U)\b({_CAPITAL}(?:\s+(?:(?:of|the|and|de|da|do|das|dos|e|&)\s+)*+{_CAPITAL})*+)"
YEAR = r"(?U)\b((?:19|20)[0-9]{2})\b"
STUDIOS = ("Warner Bros.", "Warner Bros. Pictures", "DC Studios", "DC Universe", "Marvel Studios", "Sony Pictures", "20th Century Studios", "Universal Pictures", "Paramount Pictures", "Walt Disney Pictures", "Netflix", "Prime Video", "HBO Max", "Max", "Disney+")
STARTERS = ("A", "O", "Os", "As", "Um", "Uma", "Após", "Com", "De", "Em", "No", "Na", "Para", "Por", "Quando", "Se", "Segundo", "Enquanto", "Isso", "Esse", "Essa", "Dessa", "Desse", "Além", "Mas", "Já", "Também", "Ainda", "Outro", "Nova", "Novo")
_ENDS = r"^[ .,;:!?()\[\]{}]+|[ .,;:!?()\[\]{}]+$"


def entity_key(name: Column) -> Column:
    """By which spellings of one name agree."""
    once = F.regexp_replace(F.replace(squeeze(name), F.lit(".."), F.lit(".")), r"(?U)\s+([,.;:!?])", "$1")
    return F.lower(once)


def is_entity(name: Column) -> Column:
    """A year; a known studio or an acronym; or several words, one with a capital, that are more than a sentence's beginning."""

    def judged(n: Column) -> Column:
        words = F.split(n, " ")
        one = ~n.isin(*STARTERS) & (n.isin(*STUDIOS) | ((n == F.upper(n)) & (n != F.lower(n))))
        many = ~(F.get(words, 0).isin(*STARTERS) & (F.size(words) == 2)) & n.rlike(r"\p{Lu}")
        return F.when(n.rlike("^(?:19|20)[0-9]{2}$"), True).when(F.length(n) < 3, False).when(F.size(words) == 1, one).otherwise(many)

    return let(squeeze(name), judged)


def capitalised(text: Column) -> Column:
    """Capitalised sequences of a plain text that are names, in order, repeated ones too."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEQUENCE), 1)
    return F.filter(F.transform(found, lambda n: squeeze(F.regexp_replace(n, _ENDS, ""))), is_entity)


def mentions(text: Column) -> Column:
    """Names of a plain text in the order in which they are looked for: known studios as whole words, years, capitalised sequences and their parts."""
    plain = F.coalesce(text, F.lit(""))
    studios = F.array_compact(F.array(*[F.nullif(F.regexp_extract(plain, rf"(?iuU)(?<!\w){re.escape(s)}(?!\w)", 0), F.lit("")) for s in STUDIOS]))
    years = F.regexp_extract_all(plain, F.lit(YEAR), 1)

    def parts(n: Column) -> Column:
        cut = F.split(n, r"(?U)\s+(?:e|and|&)\s+")
        return F.when(F.size(cut) > 1, F.concat(F.array(n), F.transform(cut, squeeze))).otherwise(F.array(n))

    return F.filter(F.concat(studios, years, F.flatten(F.transform(capitalised(plain), parts))), is_entity)


def canonical_entities(sources: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, key, name) of every name of a source, spelled as where it was found first."""
    found = sources.select(F.col(id_col), F.posexplode(mentions(F.col(text_col))).alias("at", "name"))
    return found.groupBy(id_col, entity_key(F.col("name")).alias("key")).agg(F.min_by("name", "at").alias("name"))


_POSSESSIVE = r"(?i)('s|’s|â€™s|'|’|â€™)$"


def possessive_only(found: Column, name: Column) -> Column:
    """Whether a name differs from what was found by an English possessive only."""
    base = lambda c: F.regexp_replace(F.trim(c), _POSSESSIVE, "")
    return (F.trim(found) != F.trim(name)) & (base(found) == base(name)) & F.trim(name).rlike(_POSSESSIVE)


def corrections(rewritten: DataFrame, sources: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, found, name, kind, distance, action FIX or WARN, reason) of names in rewritten texts that their sources spell nearly so.

    Both tables hold plain texts by id. One or two edits are corrected unless only a possessive differs, or the first name of a person;
    three or four are a warning.
    """
    known = canonical_entities(sources, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("key").alias("_key"), F.col("name").alias("canonical"))
    own = rewritten.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(capitalised(F.col(text_col)))).alias("name"))
    unknown = own.withColumn("_key", entity_key(F.col("name"))).join(known.select("_id", "_key"), ["_id", "_key"], "left_anti").drop("_key")
    near = nearest_entity(unknown, known, ["_id"]).where("action in ('FIX', 'WARN') and distance > 0")
    kind = entity_kind(F.col("canonical"))
    first = lambda c: entity_key(F.substring_index(F.col(c), " ", 1))
    reason = F.when(F.col("action") == "WARN", "distance").when(possessive_only(F.col("name"), F.col("canonical")), "english_possessive_only")
    reason = reason.when((kind == "pessoa") & (first("name") != first("canonical")), "first_name_diff")
    return near.select(F.col("_id").alias(id_col), F.col("name").alias("found"), F.col("canonical").alias("name"), kind.alias("kind"), "distance", F.when(reason.isNull(), "FIX").otherwise("WARN").alias("action"), reason.alias("reason"))


def corrected(rewritten: DataFrame, fixes: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Rewritten texts with the names of `corrections` put right, whole words only; other columns stay."""
    pairs = fixes.where("action = 'FIX'").groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct(F.length("found").alias("n"), "found", "name")), asc=False).alias("_fixes"))

    def replace(text: Column, fix: Column) -> Column:
        # The pattern is quoted, and so is what takes its place.
        quoted = F.concat(F.lit(r"(?<![\wÀ-ÿ])\Q"), fix["found"], F.lit(r"\E(?![\wÀ-ÿ])"))
        return F.regexp_replace(text, quoted, F.regexp_replace(fix["name"], r"([\\$])", r"\\$1"))

    fixed = F.reduce(F.coalesce("_fixes", F.array().cast("array<struct<n:int,found:string,name:string>>")), F.col(text_col), replace)
    joined = rewritten.join(pairs, F.col(id_col) == F.col("_id"), "left")
    return joined.select(*[fixed.alias(c) if c == text_col else F.col(f"`{c}`") for c in rewritten.columns])
