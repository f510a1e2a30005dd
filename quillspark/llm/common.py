"""Shared helpers of the training-data operators.

Everything here is about three concerns: reading tables through Spark only,
keeping Arrow batches small enough for bounded Python memory, and cutting
lineage into tables that survive the loss of executors.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the five ASCII controls \t..\r.
SPACES = "\\x20\\x09-\\x0D"
WORD_RE = f"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1024, size: str = "24m") -> None:
    """Bound what one Arrow batch holds, so that a Python worker's memory does not follow the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception:  # noqa: BLE001  the byte bound is newer than the row bound
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where none is set (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _drop_written() -> None:
    for spark, path in _written:
        try:
            sc = spark.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
    _written.clear()


atexit.register(_drop_written)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """written(), in buckets of a column: a join on it moves only the other side."""
    spark = df.sparkSession
    table = f"quillspark_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    _written.append((spark, path))
    return spark.table(table)


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for own in [x for x in _written if x[1].split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")]:
                _written.remove(own)
                hadoop = own[0].sparkContext._jvm.org.apache.hadoop.fs.Path(own[1])
                hadoop.getFileSystem(own[0].sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of a table that a join may send to all tasks; the driver holds them meanwhile.
SENT = 50_000


def met(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table as the right side of a join: sent to all tasks if it has few rows, else merged by key.

    Spark alone would go by bytes, compressed ones of files and shuffles, and the driver holds a table of ten such megabytes as
    hundreds. rows: the table's, where they are known; the table is counted else, so it should be a written one.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SENT else df.hint("merge")


def tidy(spark: SparkSession) -> None:
    """Give back what earlier work left in the driver: dead objects of Python and Java, and pages that their allocators hold.

    A long job of many stages otherwise keeps the memory of its greedy stages while it runs the others. Shuffles and broadcasts
    that nothing refers to any more are dropped with them.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # an allocator of another kind
        pass
    spark.sparkContext._jvm.java.lang.System.gc()


def slices(batches, col: int, size: int = 6_000_000):
    """The batches, cut so that a column of texts has at most about `size` bytes in each; a longer text stands alone."""
    for b in batches:
        lens = np.asarray(pc.fill_null(pc.binary_length(b.column(col)), 0), np.int64)
        if lens.sum() <= size:
            yield b
            continue
        a, total = 0, 0
        for i, n in enumerate(lens.tolist()):
            if i > a and total + n > size:
                yield b.slice(a, i - a)
                a, total = i, 0
            total += n
        yield b.slice(a)


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of every text (nulls have none) as one flat array, and the offsets of each text in it."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if lower:
        text = pc.ascii_lower(text)
    parts = pc.ascii_split_whitespace(text)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return flat, offsets


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values, and the distinct values that the codes index."""
    d = flat.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices, dtype=np.int64), d.dictionary


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each flat element, the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def rowsum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(distinct: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each distinct word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def fold(id_col: str, n: int):
    """crc32 of the id as decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def zipped(x: np.ndarray) -> bytes:
    """A numeric array with its bytes grouped by significance, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unzipped(data: bytes, kind) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, which come one after the other, as one table each; only one group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if held and rows[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = rows[start]
                held.append(b.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)
