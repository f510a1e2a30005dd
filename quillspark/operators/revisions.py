"""Revision decisions per event key: three windows instead of a loop over arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(deliveries: DataFrame, key: str = "event_key", revision: str = "revision", digest: str = "payload_hash", arrival: str = "seq") -> DataFrame:
    """Adds decision, and missing_from and missing_to (the first and the last of the revisions skipped, or NULLs), to deliveries in order of arrival.

    The first arrival of a revision is stored whatever its decision, and a later one of the same revision is compared
    with it: so an old revision delivered again unchanged is a duplicate, not stale.
    """
    same = Window.partitionBy(key, revision).orderBy(arrival)
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    # The window by key comes first: rows that it has dealt out by key need not move again for the others.
    rows = deliveries.withColumn("_max", F.max(revision).over(before)).withColumns({
        "_nth": F.row_number().over(same),
        "_first": F.first_value(F.lower(F.trim(digest))).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    decision = (
        F.when(F.col("_max").isNull(), "ACCEPT_NEW_EVENT")
        .when((F.col("_nth") > 1) & (F.lower(F.trim(digest)) == F.col("_first")), "DUPLICATE")
        .when(F.col("_nth") > 1, "REVISION_HASH_CONFLICT")
        .when(F.col(revision) < F.col("_max"), "STALE_REVISION")
        .otherwise("ACCEPT_NEW_REVISION")
    )
    gap = (decision == "ACCEPT_NEW_REVISION") & (F.col(revision) > F.col("_max") + 1)
    rows = rows.withColumn("missing_from", F.when(gap, F.col("_max") + 1)).withColumn("missing_to", F.when(gap, F.col(revision) - 1))
    return rows.withColumn("decision", decision).drop("_nth", "_first", "_max")


def with_ledger(ledger: DataFrame, batch: DataFrame, key: str = "event_key") -> DataFrame:
    """Decisions for a batch after what a ledger has stored: ledger rows come first and are not returned."""
    both = ledger.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return decide(both, key).where("_new").drop("_new")


def cursors(decided: DataFrame) -> DataFrame:
    """Last cursor of each source and contract among accepted and repeated deliveries; a delivery without a cursor moves nothing."""
    moves = decided.where(F.col("decision").isin("ACCEPT_NEW_EVENT", "ACCEPT_NEW_REVISION", "DUPLICATE") & F.col("cursor").isNotNull())
    last = lambda c: F.max_by(c, "seq").alias(c)
    return moves.groupBy("source_id", "contract_version").agg(last("cursor"), last("event_key"), last("revision"))


def without_cursor(stored: DataFrame, marked: DataFrame) -> DataFrame:
    """Stored cursors after sources were marked as having none: their mode changes, what they hold stays; sources not stored yet come without a cursor.

    marked (source_id, contract_version) may repeat rows; one full join on the key.
    """
    keys = ["source_id", "contract_version"]
    m = marked.select(*keys).distinct().withColumn("_marked", F.lit(True))
    both = stored.join(m, keys, "full").withColumn("cursor_mode", F.when(F.col("_marked"), "unavailable").otherwise(F.col("cursor_mode")))
    return both.select(*stored.columns)
