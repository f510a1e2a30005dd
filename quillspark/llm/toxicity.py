"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words (letters only) and their
first 3 to 6 characters, which generalise to inflected and coded forms. The
machine adds to each term's weight a product of short factors for each pair of
terms, so that an insult together with a group mention can weigh more than both.
It is fitted on the driver by AdaGrad on a bounded sample of labelled rows
(MAX_TRAIN, a hash order of ids); every text is scored whole.

Terms are screened before the fit, in Spark: a term stays if its presence depends
on the label, among the distinct sets of terms in the sample (copies of a text count
once, else a large group of them would make all its words look telling). So many
terms are looked at that the dependence must be beyond doubt: none of BUCKETS terms
independent of the label would show it but once in twenty times. A pair of which
neither term depends on the label is not seen. Only counts by term and the rows'
screened terms reach the driver, a bit for each term and row of the sample, however
long the texts are.

Edge cases: a null or empty text has no terms and gets the bias as its score;
without labelled rows the score is 0.5 less a hair, so nothing is predicted
toxic; rows with a null id or label are not learned from; an id with several labels
or rows is learned from as often; ties between terms go to the smaller bucket;
repeated ids are scored each; an empty table gives an empty table; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, coded, fold, hash_words, owner, slices, split_words, written

BUCKETS = 1 << 18
FACTORS = 4
#: Labelled rows that the machine is fitted on, at most.
MAX_TRAIN = 10_000
#: Chi-square that none of BUCKETS terms independent of the label reaches but once in twenty times.
SURE = 2 * float(np.log(BUCKETS / 0.05))
PREFIXES = (3, 4, 5, 6)
TERMS = 1 + len(PREFIXES)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, lin: np.ndarray, vec: np.ndarray, sq: np.ndarray) -> np.ndarray:
        z = self.bias + lin + 0.5 * ((vec**2).sum(axis=1) - sq)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct (row, word) pairs, and the words."""
    flat, offsets = split_words(text)
    codes, raw = coded(flat)
    bare = pc.utf8_lower(pc.replace_substring_regex(raw, r"[^\p{L}]+", ""))
    to, words = coded(bare)
    key = np.unique(owner(offsets) << 32 | to[codes]) if len(codes) else np.zeros(0, np.int64)
    row, word = key >> 32, key & 0xFFFFFFFF
    kept = np.asarray(pc.greater(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False), dtype=bool)[word] if len(word) else np.zeros(0, bool)
    return row[kept], word[kept], words


def terms(words: pa.Array) -> np.ndarray:
    """Buckets of each word's terms; a word shorter than a prefix repeats itself there."""
    parts = [pc.utf8_slice_codeunits(words, 0, n) for n in PREFIXES]
    salts = np.arange(TERMS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed = [hash_words(words)]
    for p in parts:
        at, distinct = coded(p)
        hashed.append(hash_words(distinct)[at] if len(distinct) else np.zeros(0, np.uint64))
    return np.stack([(h ^ s) >> np.uint64(46) for h, s in zip(hashed, salts, strict=True)], axis=1).astype(np.int32)


def train_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """(y, terms) of a sample of at most about MAX_TRAIN labelled rows; only their ids are broadcast."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    n = usable.count()
    share = int(min(1.0, MAX_TRAIN / max(n, 1)) * 1_000_000)
    picked = usable.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) < share).limit(2 * MAX_TRAIN)
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row, word, words = _words(b.column(1))
            at = terms(words)[word] if len(word) else np.zeros((0, TERMS), np.int32)
            seen = np.unique(np.repeat(row, TERMS) * BUCKETS + at.ravel())
            ends = np.concatenate(([0], np.cumsum(np.bincount(seen // BUCKETS, minlength=len(b)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((seen % BUCKETS).astype(np.int32)))], ["y", "terms"])

    return texts.join(F.broadcast(picked), F.col("_own") == F.col("_id")).select("_y", "_text").mapInArrow(run, "y int, terms array<int>")


def screen(rows: DataFrame) -> np.ndarray:
    """Terms whose presence depends on the label, ascending. The sample's size bounds how many pass."""
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = float(total.n), float(total.pos)
    if pos in (0.0, n):
        return np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            col, toxic = b.column(1), b.column(0).to_numpy() > 0
            t = col.flatten().to_numpy()
            m += np.bincount(t, minlength=BUCKETS)
            a += np.bincount(t[toxic[np.asarray(pc.list_parent_indices(col), np.int64)]], minlength=BUCKETS)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(m[at]), pa.array(a[at])], ["term", "m", "a"])

    counts = rows.mapInArrow(count, "term int, m long, a long").groupBy("term").agg(F.sum("m").alias("m"), F.sum("a").alias("a")).where("m >= 3")
    expected = F.col("m") * (pos / n)
    spread = F.col("m") * (pos / n) * (1 - pos / n) * (1 - F.col("m") / n)
    chi2 = F.pow(F.greatest(F.abs(F.col("a") - expected) - 0.5, F.lit(0.0)), F.lit(2)) / F.greatest(spread, F.lit(1e-9))
    return np.array(sorted(r.term for r in counts.where(chi2 >= SURE).select("term").collect()), np.int64)


def reduced(rows: DataFrame, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, row and place in `used` of the screened terms of all rows."""
    size = -(-len(used) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.full(BUCKETS, -1)
        to[used] = np.arange(len(used))
        for b in batches:
            col = b.column(1)
            row, x = np.asarray(pc.list_parent_indices(col), np.int64), to[col.flatten().to_numpy()]
            bits = np.zeros((len(b), 8 * size), bool)
            bits[row[x >= 0], x[x >= 0]] = True
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], ["y", "bits"])

    got = rows.mapInArrow(run, "y int, bits binary").toArrow().combine_chunks()
    bits = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(len(got), size)
    own, x = np.nonzero(np.unpackbits(bits, axis=1))
    return got["y"].to_numpy().astype(float), own, x


def fit(y: np.ndarray, own: np.ndarray, x: np.ndarray, used: np.ndarray, rounds: int = 200, seed: int = 3) -> Machine:
    """AdaGrad over the whole sample with a soft threshold on linear weights, so that chance terms stay at zero. Row own[i] holds term used[x[i]]."""
    lin_all, fac_all = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    if not len(y) or y.min() == y.max():
        return Machine(-1e-3 if not len(y) or y.max() == 0 else 1e-3, lin_all, fac_all)
    n, rng = len(y), np.random.default_rng(seed)
    bias, lin, fac = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS))
    g_bias, g_lin, g_fac = 1e-6, np.full(len(used), 1e-8), np.full(fac.shape, 1e-8)
    for _ in range(rounds):
        vx = fac[x]
        vec = np.stack([np.bincount(own, vx[:, f], n) for f in range(FACTORS)], axis=1)
        z = bias + np.bincount(own, lin[x], n) + 0.5 * ((vec**2).sum(axis=1) - np.bincount(own, (vx**2).sum(axis=1), n))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        e = err[own]
        gl = np.bincount(x, e, len(used)) + 1e-5 * lin
        gf = np.stack([np.bincount(x, e * (vec[own, f] - vx[:, f]), len(used)) for f in range(FACTORS)], axis=1) + 1e-3 * fac
        g_bias, g_lin, g_fac = g_bias + err.sum() ** 2, g_lin + gl**2, g_fac + gf**2
        bias -= 0.1 * err.sum() / np.sqrt(g_bias)
        step = 0.2 / np.sqrt(g_lin)
        new = lin - step * gl
        lin = np.sign(new) * np.maximum(np.abs(new) - step * 2e-5, 0)
        fac -= 0.02 / np.sqrt(g_fac) * gf
    lin_all[used], fac_all[used] = lin, fac
    return Machine(bias, lin_all, fac_all)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> Machine:
    bound_batches(docs.sparkSession)
    rows = written(train_rows(docs, labels, id_col, label_col, text_col), "labelled")
    used = screen(rows.dropDuplicates(["y", "terms"]))
    return fit(*reduced(rows, used), used)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    # A fixed size: BUCKETS weights and factors, whatever the corpus.
    sent = spark.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*sent.value)
        for b in slices(batches, 2):
            row, word, words = _words(b.column(2))
            n = len(b)
            if len(word):
                at = terms(words)
                v = m.factors[at]
                sums = [m.linear[at].sum(axis=1), (v**2).sum(axis=(1, 2)), *v.sum(axis=1).T]
                lin, sq, *vec = [np.bincount(row, s[word], n) for s in sums]
            else:
                lin, sq, *vec = [np.zeros(n)] * (2 + FACTORS)
            p = m.score(lin, np.stack(vec, axis=1), sq)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, (F.coalesce(fold(id_col, 5), F.lit(1)) == 0).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
