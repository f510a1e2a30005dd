"""Named queries on names in texts: dictionary, spelling, names of sources and their corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import entities
from quillspark.plans.catalogue import query, table
from quillspark.plans.rules import _pick

GIVEN = ["NETFLIX", "hbo  max", "HBO", "disney +", "the last of us", "warner bros", "max original", "maximum", "suits up", "suits", "game of\nthrones", "Marvel"]


@query(r"""with t as (select doc_id, text, doc_id % 12 as k from documents)
select doc_id, md5(text || ' [' || case k when 0 then 'Netflix' when 1 then 'HBO Max' when 2 then 'HBO' when 3 then 'Disney+' when 4 then 'The Last of Us' when 5 then 'Warner Bros.' when 6 then 'Max original' when 7 then 'maximum' when 8 then 'suits up' when 9 then 'Suits' when 10 then 'Game of Thrones' else 'Marvel' end || ']') as digest,
 case when k in (2, 7, 8, 11) then 0 else 1 end as fixes from t""")
def names_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", entities.spelled(F.concat("text", F.lit(" ["), _pick(F.col("doc_id") % 12, GIVEN), F.lit("]"))).alias("s"))
    return got.select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("digest"), F.size("s.fixes").alias("fixes"))


@query(r"""with names as (select distinct lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) as name from benchmark),
words as (select doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) as name from documents)
select doc_id, count(*) as found, count(distinct name) as names from words join names using (name) where length(name) >= 6 group by doc_id""")
def dictionary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as names: how often each document has one."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    names = table(spark, sf_dir, "benchmark").select(words.alias("name")).where(F.length("name") >= 6)
    return entities.occurrences(table(spark, sf_dir, "documents"), names, "doc_id").groupBy("doc_id").agg(F.count("*").alias("found"), F.countDistinct("name").alias("names"))


_CAP = "(?:[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][\\p{L}\\p{N}_''’.-]*|[A-Z]{2,})"
_STARTERS = "'A','O','Os','As','Um','Uma','Após','Com','De','Em','No','Na','Para','Por','Quando','Se','Segundo','Enquanto','Isso','Esse','Essa','Dessa','Desse','Além','Mas','Já','Também','Ainda','Outro','Nova','Novo'"


@query(rf"""with c as (select doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])({_CAP}(?:\s+(?:(?:of|the|and|de|da|do|das|dos|e|&)\s+)*{_CAP})*)', 1)) as n from documents),
s as (select doc_id, trim(regexp_replace(trim(n, ' .,;:!?()[]{{}}'), '\s+', ' ', 'g')) as n from c),
parts as (select doc_id, n from s union all select doc_id, unnest(regexp_split_to_array(n, '\s+(?:e|and|&)\s+')) from s where regexp_matches(n, '\s(?:e|and|&)\s')
  union all select doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])((?:19|20)[0-9][0-9])(?:$|[^\p{{L}}\p{{N}}_])', 1)) from documents),
ok as (select doc_id, n, lower(regexp_replace(replace(n, '..', '.'), '\s+([,.;:!?])', '\1', 'g')) as k from parts, (select 1) where case when regexp_full_match(n, '(19|20)[0-9][0-9]') then true when length(n) < 3 then false
  when not contains(n, ' ') then n not in ({_STARTERS}) and (n in ('Max', 'Netflix') or (n = upper(n) and n <> lower(n)))
  else not (string_split(n, ' ')[1] in ({_STARTERS}) and len(string_split(n, ' ')) = 2) and regexp_matches(n, '\p{{Lu}}') end)
select doc_id, count(distinct k) as names, md5(string_agg(distinct k, '|' order by k)) as digest from ok group by doc_id""")
def source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.canonical_entities(table(spark, sf_dir, "documents"), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("names"), F.md5(F.array_join(F.sort_array(F.collect_list("key")), "|").cast("binary")).alias("digest"))


@query(r"""with p as (select p_partkey as id, p_partkey % 6 as k, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] as a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] as b from part)
select id, case k when 0 then a || ' ' || b || 'x' when 1 then a || 'e ' || b when 2 then a || ' ' || b when 3 then a || ' ' || b when 4 then a || ' ' || b[:-3] || 'xyz' else a || 'z Studios' end as found,
 case k when 2 then a || ' ' || b || '''s' when 5 then a || ' Studios' else a || ' ' || b end as name, case k when 2 then 'obra' when 5 then 'estudio' else 'pessoa' end as kind,
 case k when 2 then 2 when 4 then 3 else 1 end as distance, case when k in (0, 5) then 'FIX' else 'WARN' end as action,
 case k when 1 then 'first_name_diff' when 2 then 'english_possessive_only' when 4 then 'distance' end as reason,
 case k when 0 then 'Vimos ' || a || ' ' || b || ' ali, ' || a || ' ' || b || 'xis e mais.' when 5 then 'Vimos ' || a || ' Studios ali.' end as fixed from p where k <> 3""")
def entity_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, misspelled in the last word, the first, by a possessive, not at all, by three letters, and as a studio."""
    word = lambda i: F.initcap(F.get(F.split("p_name", " "), i))
    a, b, k = word(0), word(1), (F.col("p_partkey") % 6).cast("int")
    full = F.concat(a, F.lit(" "), b)
    source = _pick(k, [full, full, F.concat(full, F.lit("'s")), full, full, F.concat(a, F.lit(" Studios"))])
    wrong = _pick(k, [F.concat(full, F.lit("x")), F.concat(a, F.lit("e "), b), full, full, F.concat(F.regexp_replace(full, "..$", ""), F.lit("xyz")), F.concat(a, F.lit("z Studios"))])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("ontem "), source, F.lit(", disse.")).alias("source"),
        F.concat(F.lit("Vimos "), wrong, F.lit(" ali"), F.when(k == 0, F.concat(F.lit(", "), wrong, F.lit("is e mais."))).otherwise(".")).alias("text"),
    )
    # `Vimos` stands before the name as a word of its own kind, so the sentence is given to the search without it.
    bare = rows.withColumn("text", F.regexp_replace(F.regexp_replace("text", "^Vimos ", "vimos "), r", .*is e mais\.", "."))
    found = entities.corrections(bare, rows.select("id", F.col("source").alias("text")), "id")
    fixed = entities.corrected(rows.select("id", "text"), found, "id")
    return found.join(fixed, "id").select("id", "found", "name", "kind", "distance", "action", "reason", F.when(F.col("action") == "FIX", F.col("text")).alias("fixed"))
