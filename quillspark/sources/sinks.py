"""Idempotent writers. A batch that is written again changes nothing, which is what a restarted stream needs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.state import absent


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What a state table holds; an empty table of the same shape where nothing has been written."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def append_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not stored yet."""
    absent(df, stored(df.sparkSession, path, df), keys).write.mode("append").parquet(path)


def draft_status(df: DataFrame, before: DataFrame, key: str = "draft_id", digest: str = "output_hash") -> DataFrame:
    """Adds submission: WRITTEN for a new draft, UNCHANGED for the same content, CONFLICT for other content."""
    old = before.groupBy(F.col(key).alias("_k")).agg(F.collect_set(digest).alias("_h"))
    status = F.when(F.col("_h").isNull(), "WRITTEN").when(F.array_contains("_h", F.col(digest)), "UNCHANGED").otherwise("CONFLICT")
    return df.join(old, F.col(key) == F.col("_k"), "left").withColumn("submission", status).drop("_k", "_h")


def submit_drafts(df: DataFrame, path: str, key: str = "draft_id", digest: str = "output_hash") -> DataFrame:
    """Write new drafts, put conflicting ones beside, leave unchanged ones; returns the statuses.

    The decisions are written first and everything else follows from what was written, so no later read can decide differently.
    """
    spark = df.sparkSession
    batch = f"{path}/submissions/{uuid.uuid4().hex}"
    draft_status(df, stored(spark, f"{path}/drafts", df), key, digest).write.parquet(batch)
    judged = spark.read.parquet(batch)
    judged.where("submission = 'WRITTEN'").drop("submission").write.mode("append").parquet(f"{path}/drafts")
    judged.where("submission = 'CONFLICT'").drop("submission").write.mode("append").parquet(f"{path}/conflicts")
    return judged.select(key, "submission")


def batch_writer(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append-if-absent by key, a folder for each batch, committed at the end.

    A batch that was committed is left alone; one that was interrupted replaces what it has left. Only keys of committed batches are
    read, not whole rows. Rows are read back by `routing.table(spark, path, "rows", schema)`.
    """
    from quillspark.streaming import routing

    def fresh(df: DataFrame, batch: int) -> DataFrame:
        kept = routing.table(df.sparkSession, path, "rows", df.schema).select(*keys)
        return absent(df, kept, keys).withColumn("target", F.lit("rows"))

    return routing.fan_out(path, fresh, ("rows",))


#: Sinks by mode; a mode that publishes is refused by name.
MODES = {"local": submit_drafts}


def submitter(mode: str) -> Callable[..., DataFrame]:
    if mode not in MODES:
        raise ValueError(f"unknown or forbidden submission mode: {mode}")
    return MODES[mode]
