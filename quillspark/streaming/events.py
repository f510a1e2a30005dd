"""Streams of deliveries: deduplication, windows, and revision decisions in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED = "event_key string, seq long, revision int, payload_hash string, decision string, missing_from int, missing_to int"
_STATE = "top int, revisions array<int>, hashes array<string>"


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp: a watermark cannot stand on a time without zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def read(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Landed Parquet as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(df: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first delivery of each key within the watermark; state older than that is dropped."""
    return timed(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, keys: list[str], time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by window and key."""
    w = timed(df, time).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def _decider(forget_ms: int | None):
    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            top, numbers, hashes = state.get
            known = dict(zip(numbers, hashes, strict=True))
        else:
            top, known = None, {}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, revision, digest in zip(rows["seq"], rows["revision"], rows["payload_hash"], strict=True):
            digest, skipped = (digest or "").strip().lower(), (None, None)
            if top is None:
                decision = "ACCEPT_NEW_EVENT"
            elif revision in known:
                decision = "DUPLICATE" if known[revision] == digest else "REVISION_HASH_CONFLICT"
            elif revision < top:
                decision = "STALE_REVISION"
            else:
                decision, skipped = "ACCEPT_NEW_REVISION", (top + 1, revision - 1) if revision > top + 1 else (None, None)
            known.setdefault(int(revision), digest)
            top = int(revision) if top is None else max(top, int(revision))
            out.append((key[0], seq, revision, digest, decision, *skipped))
        state.update((top, list(known), list(known.values())))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        frame = pd.DataFrame(out, columns=["event_key", "seq", "revision", "payload_hash", "decision", "missing_from", "missing_to"])
        yield frame.astype({"missing_from": "Int32", "missing_to": "Int32"})

    return decide


def revision_decisions(deliveries: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Decisions for a stream of (event_key, seq, revision, payload_hash): the state of a key is its highest revision and the hash of each stored one.

    With forget_ms, a key that has had no delivery for so long is dropped from the state, and would be new if it came again: choose it
    longer than events are delivered late, or decide against a ledger (`routing`), which keeps no state. Without it, every key is kept.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return deliveries.groupBy("event_key").applyInPandasWithState(_decider(forget_ms), DECIDED, _STATE, "append", timeout)


def accepted(decided: DataFrame) -> DataFrame:
    """What goes on to processing; deliveries without a key never were decided and are united by the caller."""
    return decided.where(F.col("decision").isin("ACCEPT_NEW_EVENT", "ACCEPT_NEW_REVISION"))


def breaker(outcomes: DataFrame, opens_at: int = 3) -> DataFrame:
    """outcomes (source_id, seq, failed) -> failures in a row, and whether the source is skipped next and starts at zero again."""
    from pyspark.sql import Window

    by = Window.partitionBy("source_id").orderBy("seq")
    island = outcomes.withColumn("_i", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(by))
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("source_id", "_i").orderBy("seq"))
    return island.withColumn("streak", streak).withColumn("skip_next", F.col("failed") & (F.col("streak") % opens_at == 0)).drop("_i")
