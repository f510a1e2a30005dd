"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised to a few bits, the point's index on the
Hilbert curve is looked up in a constant array, rows are sorted by index and
the sorted run is cut into shards whose row counts differ by one at most
(law `rows`). Neighbours on the curve agree in most dimensions, so a shard's
minimum and maximum of each dimension prune files for filters on any of them.

The sort is a range partitioning by (index, id): a cell that holds a third of
all rows is still split by id, and no task sees the whole table. To number rows
(`shard`) only ids, sizes and checksums move; to write them (`write`) whole rows
move once. `write` keeps the bounds of every dimension for each shard, by which
`read` opens only the shards that can hold what is asked for.

Edge cases: null dimensions quantise to 0; a null text has no bytes, size 1 and
the checksum of no bytes; equal rows are ordered by their values, so repeated
ids get slots of their own; an empty table gives an empty table; extra columns
are ignored by `shard` and kept by `write`, whose own columns take other names
where they would clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

BITS = 4


def _curve(point: list[int], bits: int) -> int:
    """Index on the Hilbert curve of one cell: undo rotations level by level, then Gray code."""
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    index = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ flip) >> level & 1)
    return index


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point with coordinates of so many bits.

    The curve over the quantised grid is a constant of at most 2**16 cells, so a row's index is one array access in generated code.
    """
    n = len(dims)
    if n * bits > 16:
        raise ValueError("quantise to at most 16 bits in all")
    cells = [_curve([c >> (bits * i) & ((1 << bits) - 1) for i in range(n)], bits) for c in range(1 << (n * bits))]
    cell = sum((d.cast("int") * F.lit(1 << (bits * i)) for i, d in enumerate(dims)), F.lit(0))
    return F.get(F.from_json(F.lit(str(cells)), "array<int>"), cell).cast("long")


def quantised(docs: DataFrame, text_col: str) -> list[Column]:
    """Three dimensions of BITS bits: length on a log scale, language and source; a missing column counts as null."""
    top = (1 << BITS) - 1
    has = set(docs.columns)
    named = lambda c: F.coalesce(F.pmod(F.xxhash64(F.col(c)), F.lit(top + 1)).cast("int"), F.lit(0)) if c in has else F.lit(0)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
    return [F.least(F.floor(F.log2(size + 1)).cast("int"), F.lit(top)), named("lang"), named("source")]


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, row: list[Column]) -> DataFrame:
    """(id, size, text_crc32, hilbert, d0 to d2, shard, slot) and the given columns for every row; shards differ by one row at most."""
    spark = docs.sparkSession
    dims = quantised(docs, text_col)
    cells = [F.col(f"d{i}") for i in range(len(dims))]
    bytes_of = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(bytes_of) + 1).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        *[d.alias(f"d{i}") for i, d in enumerate(dims)],
        *row,
    )
    order = ["hilbert", "id", "size", "text_crc32"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The range's number is written with the row, so that a lost executor can't deal rows anew between the count and the cut.
    keyed = narrow.withColumn("hilbert", hilbert_index(cells))
    dealt = written(keyed.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "hilbert")
    # One row for each range: as many as there are partitions, whatever the table's size.
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    ranked = dealt.withColumn("_r", rank).join(F.broadcast(starts), "range").withColumn("_r", F.col("_r") + F.col("start"))
    ranked = ranked.withColumn("shard", F.expr(f"cast((_r * {shards}) div total as int)"))
    first = F.expr(f"(cast(shard as bigint) * total + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", (F.col("_r") - first).cast("long")).drop("_r", "start", "total", "range")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, hilbert) for every row; shards differ by one row at most."""
    return _placed(docs, shards, id_col, text_col, []).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def _free(name: str, taken: list[str]) -> str:
    """The name, with as many _ as make it differ from all taken ones (which Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def write(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows as Parquet under path/rows, a folder for each shard in the order of the curve, and the shards' bounds under path/bounds.

    Returns the bounds: (shard, n, bytes, and least and greatest value of each quantised dimension), a row for each shard that has rows.
    A folder of the same name is replaced. The rows' columns keep their names; the shard's and slot's get _ while they clash.
    """
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = _placed(docs, shards, id_col, text_col, [whole])
    of, at = _free("shard", docs.columns), _free("slot", docs.columns)
    rows = placed.select("row.*", F.col("slot").alias(at), F.col("shard").alias(of))
    rows.sortWithinPartitions(of, at).write.mode("overwrite").partitionBy(of).parquet(f"{path}/rows")
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/columns")  # a folder without shards says nothing of columns
    ends = [f(f"d{i}").alias(f"{name}_d{i}") for i in range(3) for name, f in (("min", F.min), ("max", F.max))]
    bounds = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *ends)
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return spark.read.parquet(f"{path}/bounds")


def read(spark: SparkSession, path: str, length: tuple[int, int] | None = None, lang: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of those shards under path whose bounds admit a text of so many bytes (least, greatest), the language and the source.

    Whole shards come back: the caller's own filter follows. What is brought home is one number for each shard.
    """
    top = (1 << BITS) - 1
    code = lambda v: F.pmod(F.xxhash64(F.lit(v)), F.lit(top + 1)).cast("int")
    asked = [(F.least(F.floor(F.log2(F.lit(n + 1))).cast("int"), F.lit(top)) for n in length) if length else None]
    asked += [(code(v), code(v)) if v is not None else None for v in (lang, source)]
    bounds = spark.read.parquet(f"{path}/bounds")
    for i, ask in enumerate(asked):
        if ask:
            low, high = ask
            bounds = bounds.where((F.col(f"max_d{i}") >= low) & (F.col(f"min_d{i}") <= high))
    found = [r["shard"] for r in bounds.select("shard").collect()]
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    return rows.where(F.col(rows.columns[-1]).isin(found))
