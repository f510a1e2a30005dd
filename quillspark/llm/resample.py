"""Importance resampling towards a target: hashed n-grams, a persisted sparse matrix, gains, a weighted draw.

The document-by-bucket count matrix is written once as CSR blocks (ids, row pointers, bucket numbers, counts), each
of some megabytes of text. Column sums of the blocks give the corpus' distribution; the same of the target's blocks
give the target's. A bucket's gain is the logarithm of the two smoothed shares' ratio, in thousandths and floored,
and the product of the matrix with the gains weighs every document. Gumbel noise from a hash of the id turns the
highest weights into a draw without replacement, which a range partitioning ranks: no task sees all documents, and
only one row for each bucket (a parameter) and for each partition is ever brought together.

Edge cases: null and empty texts have no features, weight 0, and are never drawn; a null id counts as the empty
string for the noise and comes last among ties; repeated rows are weighed and drawn each for itself; an empty
target or corpus leaves the smoothing alone; an empty table gives an empty table; extra columns are ignored by
`draw` and kept by `resample`. The length of a text is not limited: one longer than a block makes a block of its own.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.byte_terms import Words, alphabet
from quillspark.llm.common import bound_batches, rowsum, slices, unzipped, written, zipped

BLOCK_BYTES = 6_000_000


def _buckets(words: Words, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every run of `low` to `high` words, by the crc32 of the words joined by spaces."""
    distinct = words.distinct()
    rows, found = [], []
    for n in range(low, high + 1):
        if n == 1:
            of = np.fromiter((zlib.crc32(x) % buckets for x in distinct), np.int64, len(distinct))
            rows.append(words.row)
            found.append(of[words.code])
            continue
        last = len(words.code) - n + 1
        at = np.flatnonzero(words.row[: max(last, 0)] == words.row[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        codes = words.code.tolist()
        runs = (zlib.crc32(b" ".join([distinct[c] for c in codes[i : i + n]])) % buckets for i in at.tolist())
        rows.append(words.row[at])
        found.append(np.fromiter(runs, np.int64, len(at)))
    return np.concatenate(rows), np.concatenate(found)


def matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """CSR blocks of the counts: (ids, words, indptr, indices, counts); indices and counts are packed 32-bit numbers.

    Rows of a block are its documents in order, `words` how many words each has. Buckets in a row are ascending and distinct.
    """
    table = alphabet(digits=True)
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(batches):
        for b in slices(batches, 1, BLOCK_BYTES):
            words = Words(b.column(1), table)
            row, bucket = _buckets(words, low, high, buckets)
            cells, counts = np.unique(row * buckets + bucket, return_counts=True)
            indptr = np.searchsorted(cells, np.arange(len(b) + 1) * buckets)
            one = lambda x: pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x).cast(pa.list_(x.type))
            yield pa.RecordBatch.from_arrays(
                [
                    one(b.column(0)),
                    one(pa.array(np.bincount(words.row, minlength=len(b)), pa.int64())),
                    one(pa.array(indptr, pa.int64())),
                    pa.array([zipped((cells % buckets).astype(np.int32))], pa.binary()),
                    pa.array([zipped(counts.astype(np.int32))], pa.binary()),
                ],
                names=["ids", "words", "indptr", "indices", "counts"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(blocks, f"ids array<{kind}>, words array<bigint>, indptr array<bigint>, indices binary, counts binary")


def column_sums(blocks: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs: every task sums its blocks into one vector, and at most `buckets` sums come home."""

    def sums(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for indices, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                np.add.at(total, unzipped(indices, np.int32), unzipped(counts, np.int32))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    found = blocks.select("indices", "counts").mapInArrow(sums, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's shares in target and corpus, each count smoothed by one."""
    n = len(corpus)
    up, down = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * up / (float(s + 1) * down))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every document: the product of the blocks with the gains."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def products(batches):
        for b in batches:
            for i in range(len(b)):
                ids = b.column(0).slice(i, 1).flatten()
                indptr = np.asarray(b.column(2)[i].values, np.int64)
                counts = unzipped(b.column(4)[i].as_py(), np.int32).astype(np.int64)
                values = gain[unzipped(b.column(3)[i].as_py(), np.int32)] * counts
                yield pa.RecordBatch.from_arrays(
                    [ids, b.column(1).slice(i, 1).flatten(), pa.array(rowsum(counts, indptr)), pa.array(rowsum(values, indptr))],
                    names=["id", "n_words", "n_features", "weight"],
                )

    return blocks.mapInArrow(products, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def _noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 8 hex digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighted: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank): ranks 1, 2, 3... to floor(percent * N / 100) of the N documents with enough words.

    Rows are dealt to ranges of (drawable, score, id), counted by range, and ranked within their range from where it starts.
    """
    spark = weighted.sparkSession
    scored = weighted.select(
        "id",
        "n_features",
        "weight",
        (F.col("weight") + _noise(F.col("id"), seed)).cast("long").alias("score"),
        (F.col("n_words") >= least_words).alias("able"),
    )
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The range's number is written with the row, so that a lost executor can't deal rows anew between count and rank.
    dealt = written(scored.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "scores")
    # One row for each range: as many as there are partitions, whatever the table's size.
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"), F.count_if("able").alias("able_n"))
    starts = sizes.select(
        "range",
        (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"),
        F.expr(f"({percent} * sum(able_n) over ()) div 100").alias("drawn"),
    )
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("start")
    ranked = dealt.join(F.broadcast(starts), "range").withColumn("place", place)
    return ranked.select("id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= F.col("drawn")), F.col("place")).cast("long").alias("rank"))


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; the target's texts stand in a column of the same name."""
    blocks = written(matrix(docs, id_col, text_col, low, high, buckets), "csr")
    wanted = column_sums(matrix(target, target_id, text_col, low, high, buckets), buckets)
    gain = gains(wanted, column_sums(blocks, buckets))
    return draw(weights(blocks, gain), percent, least_words, seed).withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that were drawn, whole rows; with repeated ids, all rows of an id of which one was drawn."""
    drawn = sample(docs, target, id_col, **options).where("rank is not null").select(id_col)
    return docs.join(drawn.distinct(), id_col, "left_semi").select(*[f"`{c}`" for c in docs.columns])
