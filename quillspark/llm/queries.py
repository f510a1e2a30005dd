"""Queries of the training-data operators over their whole tables, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontam, divergence, html_extract, ngram_join, ngram_lm, pii, quality, resample, sharding, token_counts, toxicity, url_filter
from quillspark.llm.common import table
from quillspark.llm.oracles import DIVERGENCE_SQL, RESAMPLE_SQL, URL_FILTER_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return quality.judge(table(spark, sf_dir, "documents")).select(*names)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), pooled=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Host, path and verdict of the rules that `op12_url_filter` applies.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    outcomes = url_filter.outcomes_of_labels(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, rules, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_html, op4_toxicity, op5_decontamination, op6_token_counts, op7_ngram_lm, op8_sharding, op9_ngram_join, op10_pii, op11_resample, op12_url_filter, op13_divergence, pipeline)}


#: Components of near duplicates by all links between sets and a walk along them. The other queries learn, encode by vocabulary or hash as only Spark does.
NGRAM_JOIN_SQL = """
with recursive words as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s
  from words
), shingles as (
  select doc_id, len(s) as n, unnest(s) as g from sets
), links as materialized (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, node) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, l.b from reach r join links l on r.node = l.a
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id
from sets s join (select doc_id, min(node) as component_id from reach group by doc_id) r on s.doc_id = r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_ngram_join": NGRAM_JOIN_SQL, "op11_resample": RESAMPLE_SQL, "op12_url_filter": URL_FILTER_SQL, "op13_divergence": DIVERGENCE_SQL}
