"""Looking back: as-of joins, revisions of an event, material of a draft, and processing stored events again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.sinks import stored


def asof(left: DataFrame, right: DataFrame, key: str, at: str, since: str, take: list[str], slice_of: Column | None = None) -> DataFrame:
    """left with columns `take` of the last row of right with the same key whose `since` is not after left's `at`; NULLs without one.

    No range join: both sides are united by key and time, and the last right row is carried along. So that a key with a large share of all
    rows is not one task, time is cut into slices (of a day by default; `slice_of` of the column `_t` otherwise): a slice carries within
    itself, and what it begins with comes from one row for each earlier slice of the key. Of right rows at one time the one with the
    greatest values counts; rows with a NULL key or time have no partner. Columns of left keep their values, those taken
    must not be among them.
    """
    slice_of = F.to_date(F.col("_t")) if slice_of is None else slice_of
    value = F.struct(F.col("_t").alias("t"), *[F.col(f"_v.{c}").alias(c) for c in take])
    rows = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    ours = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), rows.alias("_row"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_v"))
    theirs = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), F.struct(*take).alias("_v"))
    lost = ours.where("_k is null or _t is null")
    both = ours.where("_k is not null and _t is not null").unionByName(theirs).withColumn("_slice", slice_of)
    # The last right row of each slice of a key, and before each slice the last of all earlier ones.
    ends = both.groupBy("_k", "_slice").agg(F.max(F.when(F.col("_side") == 0, value)).alias("_end"))
    earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_k", "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    within = Window.partitionBy("_k", "_slice").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_seen", F.last(F.when(F.col("_side") == 0, value), ignorenulls=True).over(within)).where("_side = 1")
    found = carried.join(starts, ["_k", "_slice"], "left").withColumn("_last", F.coalesce("_seen", "_start"))
    taken = lambda of: [F.col(f"{of}.{c}").alias(c) for c in take]
    none = lost.select("_row.*", *taken("_v"))
    return found.select("_row.*", *taken("_last")).unionByName(none)


def revisions(events: DataFrame, key: str = "event_key", revision: str = "revision") -> DataFrame:
    """events with `ordinal` among those of their key by revision, `revisions` of the key in all, and `gap`, how many numbers lie between this and the one before."""
    order = Window.partitionBy(key).orderBy(revision)
    gap = F.col(revision) - F.lag(revision).over(order) - 1
    return events.withColumn("ordinal", F.row_number().over(order)).withColumn("revisions", F.count("*").over(Window.partitionBy(key))).withColumn("gap", F.coalesce(gap, F.lit(0)).cast("long"))


def input_events(drafts: DataFrame, events: DataFrame) -> DataFrame:
    """drafts (event_key, created_at) with revision and payload_hash of the event as it stood when the draft was made."""
    return asof(drafts, events, "event_key", "created_at", "received_at", ["revision", "payload_hash"])


def source_material(evidence: DataFrame, draft: str = "draft_id") -> DataFrame:
    """(draft, url, source_name, title, published_at, is_primary, content) from stored evidence (ordinal, source_url, excerpt, strength...): excerpts of a source joined in order, the rest from its first."""
    first = F.min_by(F.struct("source_name", "title", "published_at", (F.col("strength") == "PRIMARY").alias("is_primary")), "ordinal").alias("f")
    excerpts = F.sort_array(F.collect_list(F.struct("ordinal", F.trim(F.coalesce("excerpt", F.lit(""))).alias("e"))))
    text = F.array_join(F.filter(F.transform(excerpts, lambda x: x["e"]), lambda e: e != ""), " ")
    return evidence.groupBy(draft, F.col("source_url").alias("url")).agg(first, text.alias("content")).select(draft, "url", "f.*", "content")


def replay(events: DataFrame, asked: DataFrame, process: Callable[[DataFrame], DataFrame], ledger: str, run: str) -> DataFrame:
    """Process stored events again under a run id; returns all attempts of the run (run, event_key, revision, status, draft_id, output_hash, error).

    asked: (event_key, revision), a NULL revision meaning the last one. process() turns events (event_key, revision, payload...) into
    (event_key, revision, draft_id, output_hash, error); a row with an error, and an event without a row, failed. What the run has
    completed is not processed again, so a second call does nothing, and one after a failure takes up what failed. Events themselves
    are not changed. What was asked for and is not stored, or has no payload, is an attempt of status NOT_FOUND or NO_PAYLOAD.
    """
    spark = events.sparkSession
    last = events.groupBy("event_key").agg(F.max("revision").alias("_last"))
    wanted = asked.join(last, "event_key", "left").select("event_key", F.coalesce("revision", "_last").alias("revision")).distinct()
    shape = "run string, event_key string, revision int, status string, draft_id string, output_hash string, error string, attempt string"
    like = spark.createDataFrame([], shape)
    done = stored(spark, ledger, like).where((F.col("run") == run) & (F.col("status") == "REPLAY_COMPLETED")).select("event_key", F.col("revision"))
    # Compared by value, also where an event was not found and has no revision.
    same = lambda a, b: (F.col(f"{a}.event_key") == F.col(f"{b}.event_key")) & F.col(f"{a}.revision").eqNullSafe(F.col(f"{b}.revision"))
    todo = wanted.alias("w").join(done.alias("d"), same("w", "d"), "left_anti")
    known = events.select("event_key", "revision", (F.coalesce("payload", F.lit("")) != "").alias("_payload"))
    told = todo.alias("t").join(known.alias("k"), same("t", "k"), "left").select("t.event_key", F.col("t.revision").cast("int").alias("revision"), "_payload")
    out = process(events.join(told.where("_payload").select("event_key", "revision"), ["event_key", "revision"], "left_semi"))
    out = out.select("event_key", F.col("revision").cast("int").alias("revision"), "draft_id", "output_hash", "error").withColumn("_done", F.lit(True))
    status = F.when(F.col("_payload").isNull(), "NOT_FOUND").when(~F.col("_payload"), "NO_PAYLOAD").when(F.col("_done") & F.col("error").isNull(), "REPLAY_COMPLETED").otherwise("REPLAY_FAILED")
    judged = told.join(out, ["event_key", "revision"], "left").select(F.lit(run).alias("run"), "event_key", "revision", status.alias("status"), "draft_id", "output_hash", "error")
    # One write decides; whatever is read later follows from it. Each call's attempts are told apart.
    judged.withColumn("attempt", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(ledger)
    return spark.read.schema(like.schema).parquet(ledger).where(F.col("run") == run).drop("attempt")
