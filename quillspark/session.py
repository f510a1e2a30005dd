"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC makes naive timestamps mean what the contract says; RocksDB keeps streaming state off the heap.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: Rows of one Arrow batch. Pages and bodies are long and their trees longer: with Spark's 10,000 rows a worker's memory follows the table.
BATCH = "256"


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; a smaller bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(BATCH):
        spark.conf.set(name, BATCH)


#: Tasks for each core when rows are dealt out, and the fewest of them: a session may not have all its executors yet.
TASKS, FEWEST = 4, 32


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out evenly by keys that tell them apart, before a step that costs much for each row.

    A table of short rows is a few megabytes, and a file's row groups can't be cut: without this, one task may get millions of rows.
    """
    return df.repartition(max(FEWEST, TASKS * df.sparkSession.sparkContext.defaultParallelism), *keys)


def build(app: str = "quillspark", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
