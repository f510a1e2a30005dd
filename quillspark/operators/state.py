"""State tables without MERGE: append if absent, last write wins, latest per key, retention.

Everything is a join or an aggregate on the key, so partitions follow the key and
nothing is read into the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absent(new: DataFrame, stored: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of `new` whose key is not stored; of several with one key the first in order. Rows with a NULL in the key are always new."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    keyed = new.where(~missing)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)])))
    fresh = keyed.withColumn("_rn", first).where("_rn = 1").drop("_rn").join(stored.select(*keys).distinct(), keys, "left_anti")
    return fresh.unionByName(new.where(missing))


def last_write(stored: DataFrame, new: DataFrame, keys: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """Upsert: the row with the highest order of each key. Columns in `keep` take the last value that is not NULL."""
    both = stored.unionByName(new, allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys]
    at = F.struct(F.col(order), F.struct(*[F.col(c) for c in others if c != order]))
    kept = keep or []
    whole = F.max_by(F.struct(*[F.col(c) for c in others]), at).alias("_last")
    last = both.groupBy(*keys).agg(whole, *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_k_{c}") for c in kept])
    return last.select(*keys, *[(F.coalesce(F.col(f"_k_{c}"), F.col(f"_last.{c}")) if c in kept else F.col(f"_last.{c}")).alias(c) for c in others])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_then(df: DataFrame, keys: list[str], order: list[Column], condition: Column) -> DataFrame:
    """Latest row of each key, and of those the ones that meet the condition: not the latest row that meets it."""
    return latest(df, keys, order).where(condition)


def children_of_latest(parents: DataFrame, children: DataFrame, group: str, parent: str, order: list[Column]) -> DataFrame:
    """Children of the latest parent of each group."""
    return children.join(latest(parents, [group], order).select(parent), parent, "left_semi")


def pending(items: DataFrame, queued: DataFrame, key: str, eligible: Column, order: list[Column], limit: int) -> DataFrame:
    """Eligible items that are not queued, the first `limit` in order."""
    return items.where(eligible).join(queued.select(key).distinct(), key, "left_anti").orderBy(*order).limit(limit)


def newest(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Retention by count."""
    return df.orderBy(*order).limit(limit)


def expire(items: DataFrame, children: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Retention by condition; children of what goes go with it."""
    removed = items.where(gone).select(key)
    return items.where(~F.coalesce(gone, F.lit(False))), children.join(removed, key, "left_anti")


def backfilled(df: DataFrame, first: Column, second: Column, key: str, order: list[Column], limit: int, partition: list[str]) -> DataFrame:
    """Rows that meet `first`, then those that meet `second`, without repeated keys, at most `limit` in each partition."""
    ranked = df.where(first | second).withColumn("_tier", F.when(first, 0).otherwise(1))
    once = latest(ranked, [*partition, key], [F.col("_tier"), *order])
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy("_tier", *order))).where(F.col("_n") <= limit)


def claim_next(queue: DataFrame, posted: DataFrame, key: str, order: list[Column], worker: str, now: Column) -> DataFrame:
    """The next waiting row that is not posted, as it is after the claim."""
    free = queue.where("status = 'QUEUED'").join(posted.select(key).distinct(), key, "left_anti")
    return free.orderBy(*order).limit(1).withColumns({"status": F.lit("PROCESSING"), "claimed_by": F.lit(worker), "claimed_at": now})


def recovered(claims: DataFrame, now: Column, stale_seconds: int, most: int) -> DataFrame:
    """Stale claims: done where a draft exists, else queued again, for good failed after `most` recoveries."""
    stale = (F.col("status") == "PROCESSING") & (F.unix_timestamp(now) - F.unix_timestamp("claimed_at") >= stale_seconds)
    state = F.when(F.col("has_draft"), "DRAFT_GENERATED").when(F.col("recoveries") >= most, "FAILED_PERMANENT").otherwise("QUEUED")
    return claims.withColumns({
        "status": F.when(stale, state).otherwise(F.col("status")),
        "recoveries": F.when(stale & ~F.col("has_draft"), F.col("recoveries") + 1).otherwise(F.col("recoveries")),
        "claimed_by": F.when(~stale, F.col("claimed_by")),
    })


def transition(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Compare-and-set: an update holds only where its expected owner still owns the row."""
    u = updates.select(key, F.col("status").alias("_status"), F.col("expected_claimed_by").alias("_owner"), F.col("increment").alias("_more"))
    ok = F.col("_status").isNotNull() & (F.col("_owner").isNull() | F.col("_owner").eqNullSafe(F.col("claimed_by")))
    joined = rows.join(u, key, "left")
    return joined.withColumns({"status": F.when(ok, F.col("_status")).otherwise(F.col("status")), "fail_count": F.when(ok & F.col("_more"), F.col("fail_count") + 1).otherwise(F.col("fail_count"))}).drop("_status", "_owner", "_more")
