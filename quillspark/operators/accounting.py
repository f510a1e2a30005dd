"""Token accounting that merges: daily partial states which later batches add to, and their check against the log.

A state has one row for each batch, day, API and model: counts, sums, the last call, and a quantile sketch of call sizes.
States are merged by adding rows up, never by reading the log again; a batch that is added twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["day", "api_type", "model"]
SUMS = ["prompt_tokens", "completion_tokens", "total_tokens", "requests", "successful", "failed"]


def valid(log: DataFrame) -> DataFrame:
    """Calls that may be counted: token numbers that are whole and not negative."""
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return log.where((number("prompt_tokens") >= 0) & (number("completion_tokens") >= 0)).withColumn("prompt_tokens", number("prompt_tokens")).withColumn("completion_tokens", number("completion_tokens"))


def partial(log: DataFrame, batch: Column) -> DataFrame:
    """State of a log (at, api_type, model, prompt_tokens, completion_tokens, success); `batch` names the part that a call belongs to."""
    calls = valid(log).withColumn("_total", F.col("prompt_tokens") + F.col("completion_tokens"))
    return calls.groupBy(batch.alias("batch"), F.to_date("at").alias("day"), "api_type", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("_total").alias("total_tokens"),
        F.count("*").alias("requests"),
        F.count_if("success").alias("successful"),
        (F.count("*") - F.count_if("success")).alias("failed"),
        F.max("at").alias("last_call"),
        F.kll_sketch_agg_bigint("_total").alias("sizes"),
    )


def merge(state: DataFrame, *more: DataFrame) -> DataFrame:
    """States as one; rows of a batch that several states hold count once."""
    every = state
    for m in more:
        every = every.unionByName(m)
    return every.dropDuplicates(["batch", *KEYS])


def summary(state: DataFrame, by: list[str]) -> DataFrame:
    """Sums and quantiles of call sizes by some of day, api_type and model; none: of all."""
    rank = lambda q: F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("sizes"), F.lit(q))
    return state.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("last_call").alias("last_call"), rank(0.5).alias("median_size"), rank(0.95).alias("p95_size"))


def integrity(log: DataFrame, state: DataFrame, batch: Column) -> DataFrame:
    """(batch, day, api_type, model, status OK, MISSING, STALE or UNKNOWN) of every part of the log and of the state: held against a fresh count."""
    keys = ["batch", *KEYS]
    fresh = partial(log, batch).select(*keys, F.struct(*SUMS).alias("_log")).alias("f")
    kept = state.select(*keys, F.struct(*SUMS).alias("_state")).alias("s")
    status = F.when(F.col("_state").isNull(), "MISSING").when(F.col("_log").isNull(), "UNKNOWN").when(F.col("_log") != F.col("_state"), "STALE").otherwise("OK")
    # Calls of no API or model are a part like any other.
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return fresh.join(kept, same, "full").select(*[F.coalesce(f"f.{k}", f"s.{k}").alias(k) for k in keys], status.alias("status"))


def gate_metrics(rules: Column) -> Column:
    """array<struct<code, metrics map<string,string>>> as one map of code.metric, in order of code and metric."""
    named = F.transform(rules, lambda r: F.transform(F.map_entries(F.coalesce(r["metrics"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(r["code"], F.lit("."), e["key"]).alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.array_sort(F.flatten(named)))
