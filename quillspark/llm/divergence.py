"""How the sources of a language differ from each other and from the language, term by term, in exact integers.

Every task finds terms by a byte table, groups them by xxhash with a check of the bytes, and hands on one row for
each source, language and term of some megabytes of text. Spark sums them. The terms that enough documents of a
language have are its columns; a source's smoothed shares (parts in a thousand million, floored) are its row.
A source's row is its floor p0 wherever it has no count, so the distance of two rows is V times the distance of
their floors, plus corrections at the columns where either has a count. These corrections are summed by
reduceat over CSR rows, for a bounded number of cells and rows at a time: columns are dealt to buckets and rows to
blocks, and a task holds two blocks of rows within one bucket.

Edge cases: null texts, languages and sources read as the empty string, so do rows without them; a language
without kept terms has distance 0 between all sources and no terms; a source without terms is a row of floors;
equal values are ranked by the item's UTF-8 bytes; repeated rows count each; an empty table gives an empty
table; further columns are ignored. A text of any length is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.byte_terms import Words, alphabet
from quillspark.llm.common import bound_batches, slices, written

#: Cells of the matrix in a bucket of columns, about, and rows of the matrix in a block.
CELLS, ROWS = 1 << 14, 256
SCALE = 1_000_000_000


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    return np.asarray(d.indices, np.int64), d.dictionary


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): how often each source of each language has a term, and in how many documents."""
    table = alphabet(digits=False)
    bound_batches(docs.sparkSession)

    def counts(batches):
        for b in slices(batches, 2, 16_000_000):
            words = Words(b.column(2), table)
            langs, lang_names = _codes(b.column(0))
            sources, source_names = _codes(b.column(1))
            group = langs * len(source_names) + sources
            distinct = max(len(words.first), 1)
            in_doc, n = np.unique(words.row * distinct + words.code, return_counts=True)
            cell, at = np.unique(group[in_doc // distinct] * distinct + in_doc % distinct, return_inverse=True)
            count = np.bincount(at, n, len(cell)).astype(np.int64)
            group = cell // distinct
            # Bytes of a word are whole characters, so they are text again.
            terms = pa.array(words.distinct(), pa.binary()).cast(pa.string())
            for k in range(0, len(cell), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [
                        lang_names.take(pa.array(group[part] // len(source_names))),
                        source_names.take(pa.array(group[part] % len(source_names))),
                        terms.take(pa.array(cell[part] % distinct)),
                        pa.array(count[part]),
                        pa.array(np.bincount(at, minlength=len(cell))[part].astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "count", "docs"],
                )

    narrow = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    found = narrow.mapInArrow(counts, "lang string, source string, term string, count bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str, smooth: int) -> str:
    """SQL of 1 + floor(SCALE * (count + smooth) / (total + smooth * terms)), divided as whole decimals; NULL without terms."""
    up = f"cast({count} + {smooth} as decimal(20,0)) * cast({SCALE} as decimal(10,0))"
    return f"case when {terms} > 0 then 1 + ({up}) div cast({total} + {smooth} * {terms} as decimal(20,0)) end"


class Audit:
    """The written tables of one audit.

    `groups`: every (lang, source) with its row number gid and block, the language's kept terms and cells, and the row's floor.
    `cells`: (lang, source, gid, block, term, column, bucket, count, p, q) of every kept term that a group has.
    """

    def __init__(self, docs: DataFrame, least_docs: int = 30, smooth: int = 5, cells: int = CELLS, rows: int = ROWS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> None:
        counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count"), F.count("*").alias("n"))
        # The numbers are written with the terms, so that a lost executor can't number them anew.
        kept = written(kept.where(F.col("docs") >= least_docs).withColumn("column", F.monotonically_increasing_id()), "kept")
        used = written(counts.join(kept.select("lang", "term", "column", "lang_count"), ["lang", "term"]), "used")
        named = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
        every = docs.select(named(lang_col, "lang"), named(source_col, "source")).distinct()
        totals = used.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"), F.sum("n").alias("nnz"))
        groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total", "nnz"])
        of_lang = Window.partitionBy("lang")
        groups = groups.withColumn("gid", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("block", F.expr(f"cast(gid div {rows} as int)"))
        groups = groups.withColumn("blocks", F.max("block").over(of_lang) + 1).withColumn("buckets", F.expr(f"cast(nnz div {cells} + 1 as int)"))
        self.groups = written(groups.withColumn("floor", F.expr(share("0", "total", "terms", smooth))), "groups")
        placed = used.join(self.groups, ["lang", "source"])
        placed = placed.withColumn("p", F.expr(share("count", "total", "terms", smooth))).withColumn("q", F.expr(share("lang_count", "lang_total", "terms", smooth)))
        placed = placed.withColumn("bucket", F.expr("cast(pmod(xxhash64(column), buckets) as int)"))
        self.cells = written(placed.select("lang", "source", "gid", "block", "blocks", "term", "column", "bucket", "count", "p", "q"), "cells")

    def corrections(self) -> DataFrame:
        """(lang, g, h, part), g < h: sums over columns in which either row has a count of |p_g - p_h| - |floor_g - floor_h|."""
        cells = self.cells.select("lang", "bucket", "block", "blocks", "gid", "column", "p")
        floors = self.groups.select("lang", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), "block", "blocks", "gid", F.lit(-1).cast("long").alias("column"), F.col("floor").alias("p"))
        every = cells.unionByName(floors.where("p is not null")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = every.select("lang", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "gid", "column", "p")
        parts = dealt.groupBy("lang", "bucket", "i", "j").applyInArrow(_corrections, "lang string, g int, h int, part bigint")
        return parts.groupBy("lang", "g", "h").agg(F.sum("part").alias("part"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of every ordered pair of different sources of a language.

        All pairs are what is asked for; the rows of a language meet a block at a time, so that no key holds all its pairs.
        """
        left = self.groups.select("lang", "source", "gid", "floor", "terms", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        right = self.groups.select("lang", F.col("block").alias("other"), F.col("source").alias("item"), F.col("gid").alias("item_gid"), F.col("floor").alias("item_floor"))
        pairs = left.join(right, ["lang", "other"]).where("gid <> item_gid")
        pairs = pairs.withColumn("g", F.least("gid", "item_gid")).withColumn("h", F.greatest("gid", "item_gid"))
        met = pairs.join(self.corrections(), ["lang", "g", "h"], "left")
        value = F.coalesce(F.col("terms") * F.abs(F.col("floor") - F.col("item_floor")), F.lit(0)) + F.coalesce("part", F.lit(0))
        return met.select("lang", "source", "item", value.cast("long").alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value) of every kept term that a source has more of than its language."""
        return self.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def _corrections(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of one bucket of columns for each row of block i with each row of block j; column -1 holds the rows' floors."""
    lang, _, i, j = (x.as_py() for x in key)
    block, gid, p, column = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "gid", "p", "column"))
    names, column = np.unique(column, return_inverse=True)

    def csr(of: int) -> tuple[np.ndarray, ...]:
        """Row numbers and floors of a block, then its CSR: row pointers, columns and shares."""
        at = np.flatnonzero(block == of)
        at = at[np.lexsort((column[at], gid[at]))]
        head = at[column[at] == 0]
        body = at[column[at] > 0]
        return gid[head], p[head], np.searchsorted(gid[body], np.append(gid[head], np.iinfo(np.int64).max)), column[body], p[body]

    rows_i, floor_i, ptr_i, col_i, p_i = csr(i)
    rows_j, floor_j, ptr_j, col_j, p_j = csr(j)
    full = np.flatnonzero(np.diff(ptr_j))
    own_floor = np.repeat(floor_j, np.diff(ptr_j))
    g_out, h_out, sums = [], [], []
    for k in range(len(rows_i)):
        mine = slice(ptr_i[k], ptr_i[k + 1])
        dense = np.full(len(names), floor_i[k])
        dense[col_i[mine]] = p_i[mine]
        total = np.abs(p_i[mine][:, None] - floor_j[None, :]).sum(axis=0) - (ptr_i[k + 1] - ptr_i[k]) * np.abs(floor_i[k] - floor_j)
        if len(full):
            met = dense[col_j]
            total[full] += np.add.reduceat(np.abs(met - p_j) - np.abs(met - own_floor), ptr_j[full])
        some = np.flatnonzero((total != 0) & (rows_j > rows_i[k]))
        g_out.append(np.full(len(some), rows_i[k]))
        h_out.append(rows_j[some])
        sums.append(total[some])
    flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), kind)
    g = flat(g_out, pa.int32())
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": g, "h": flat(h_out, pa.int32()), "part": flat(sums, pa.int64())})


def audit(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50, **options) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources (part pair), and the terms most in excess (part term, to rank `top`)."""
    found = Audit(docs, least_docs, smooth, **options)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.pairs().withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    terms = found.terms().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
