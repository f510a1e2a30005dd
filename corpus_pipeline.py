"""The training-data pipeline: quality, near duplicates, decontamination, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet into the shared folder and reads again as the next one's docs.
All stages but the last return the columns of `documents`, and further ones that the table has.

Edge cases: rows are told apart by id and text, so null and repeated ids are
treated as any other; of rows that repeat id and text one stays, unless they have
no words; empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontam, ngram_join, pii, quality
from quillspark.llm.common import met, table, tidy, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality.keep(docs)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their id and text, under a name of its own: rows with equal keys are copies of each other."""
    name = "_row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest id (none counts as the smallest), any of rows that repeat it.

    Rows without words have no near duplicates and all stay.
    """
    tidy(spark)
    keyed, key = _keyed(docs)
    classes = ngram_join.classes(keyed, key)
    kept = classes.where(F.col(key) == F.col("component_id")).groupBy(key).agg((F.max("n_shingles") > 0).alias("words"), F.count("*").alias("n"))
    kept = written(kept, "kept")
    once = keyed.join(met(kept.where("n = 1 or not words").select(key)), key, "left_semi")
    repeated = keyed.join(met(kept.where("n > 1 and words").select(key)), key, "left_semi").dropDuplicates([key])
    return once.unionByName(repeated).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found. The list of others is written first, so that its size decides how it is joined."""
    tidy(spark)
    keyed, key = _keyed(docs)
    leaks = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), key).select(key).distinct()
    return keyed.join(met(written(leaks, "leaks")), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets masked."""
    tidy(spark)
    return pii.redact(docs, pii.train(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document that is left."""
    tidy(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Stages that learn from the data have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
