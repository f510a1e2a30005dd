"""One pass over a stream of deliveries, fanned out to several tables, with batches that are committed once.

A batch writes each of its tables under its own number, replacing what an interrupted run of the same batch has left, and is
committed by a marker at the end. Readers see committed batches only. So a batch that is started again, before its
commit or after it, leaves every row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Where deliveries go: on to processing, kept with their reason, unreadable, or not under the contract at all.
TARGETS = ("accepted", "rejected", "dead_letter", "passed")


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are complete: one small file each."""
    fs, place = _files(spark, f"{path}/_committed")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(place)) if fs.exists(place) else []


def table(spark: SparkSession, path: str, target: str, schema: StructType) -> DataFrame:
    """Rows of a target in committed batches."""
    fs, _ = _files(spark, path)
    parts = [p for b in committed(spark, path) if fs.exists(_files(spark, p := f"{path}/{target}/batch={b}")[1])]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def judged(raw: DataFrame, ledger: DataFrame, payload: str = "payload") -> DataFrame:
    """Deliveries (seq, payload) with target and reason, after a ledger (seq, event_key, revision, payload_hash) of accepted ones.

    Payloads that name no event and no contract pass; unreadable and oversized ones are dead letters; the rest is validated and
    decided, and what is neither a new event nor a new revision is rejected with its decision and issues. Rows are read once and
    move once, by event key, with what was found in them; there is no join.
    """
    from quillspark.functions.canonical import payload_hash
    from quillspark.operators import contract, revisions

    f, readable = contract.field, F.col("_readable")
    named = F.coalesce(f("event_key"), f("eventKey"), f("contract_version"), f("contractVersion"))
    kind = F.when(~readable, "dead_letter").when(named.isNull(), "passed").when(~F.col("route").isin("V1", "LEGACY"), "dead_letter")
    read = contract.typed(contract.opened(raw.select("seq", payload), payload), payload).withColumn("target", kind)
    under = F.col("target").isNull()
    checked = contract.validate(read.withColumn("_hash", payload_hash(F.when(under, F.col(payload)))), F.col("_hash"))
    # A payload under the contract that has no event key at all can't be decided. What is not decided is a key of its own.
    decidable = under & contract.filled(F.col("event_key"))
    event = F.concat(F.lit("="), "event_key")
    rows = checked.select(
        "seq", payload, "target", F.when(F.col("target") == "dead_letter", F.when(readable, F.col("route")).otherwise("MALFORMED_JSON")).alias("reason"), "event_key", "revision", F.coalesce("payload_hash", "_hash").alias("payload_hash"),
        "valid", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("_codes"), decidable.alias("_decided"), F.when(decidable, event).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string"))).alias("_key"),
    )
    told = revisions.with_ledger(ledger.withColumn("_key", event), rows, "_key")
    decision, decided = F.when(F.col("valid"), F.col("decision")).otherwise("INVALID"), F.col("_decided")
    target = F.when(decided & decision.isin("ACCEPT_NEW_EVENT", "ACCEPT_NEW_REVISION"), "accepted").otherwise("rejected")
    reason = F.when(decided, F.rtrim(F.concat_ws(" ", decision, "_codes"))).when(under, "MISSING_EVENT_KEY")
    return told.select("seq", payload, F.coalesce("target", target).alias("target"), F.coalesce("reason", reason).alias("reason"), *[F.when(decided, F.col(c)).alias(c) for c in ("event_key", "revision", "payload_hash")])


def fan_out(path: str, judge: Callable[[DataFrame, int], DataFrame], targets: tuple[str, ...] = TARGETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: judge(rows, batch) adds `target`; every target's rows go to path/target/batch=number, then the batch is committed.

    The judged rows are written once, so that all targets follow from one judgement; a committed batch is left alone.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        fs, mark = _files(spark, f"{path}/_committed/{batch}")
        if fs.exists(mark):
            return
        whole = f"{path}/_judged/batch={batch}"
        judge(df, batch).write.mode("overwrite").parquet(whole)
        rows = spark.read.parquet(whole)
        for target in targets:
            rows.where(F.col("target") == target).drop("target").write.mode("overwrite").parquet(f"{path}/{target}/batch={batch}")
        fs.create(mark, True).close()
        fs.delete(_files(spark, whole)[1], True)

    return write


ROUTED = StructType([StructField("seq", LongType()), StructField("payload", StringType()), StructField("reason", StringType()), StructField("event_key", StringType()), StructField("revision", IntegerType()), StructField("payload_hash", StringType())])


def judge_after(path: str) -> Callable[[DataFrame, int], DataFrame]:
    """judged() whose ledger is what earlier committed batches under the path have accepted."""

    def judge(df: DataFrame, batch: int) -> DataFrame:
        ledger = table(df.sparkSession, path, "accepted", ROUTED).select("seq", "event_key", "revision", "payload_hash")
        return judged(df, ledger).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROUTED], "target")

    return judge


def route_stream(raw: DataFrame, path: str, checkpoint: str):
    """Start routing a stream of (seq, payload)."""
    return raw.writeStream.foreachBatch(fan_out(path, judge_after(path))).option("checkpointLocation", checkpoint).start()
