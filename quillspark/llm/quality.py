"""Quality rules by weak supervision.

Every rule votes for, against or abstains; expectation-maximisation over the
counts of vote patterns estimates how reliable each rule is; the posterior
probability of good quality replaces a filter that all rules must pass. Labels
are never read.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; texts of any length are read whole; equal texts get equal verdicts; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm.common import bound_batches, coded, owner, rowsum, split_words, written
from quillspark.llm.weak import ABSTAIN, AGAINST, FOR, Reliability, estimate

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_lettered", "n_ends", "n_short"]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes of 64-bit keys, by hashing rather than sorting."""
    d = pa.array(keys).dictionary_encode()
    return np.asarray(d.indices, dtype=np.int64), len(d.dictionary)


def repeat_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words covered by 3-word windows that occur at least twice in it."""
    n = len(codes)
    covered = np.zeros(n + 1, np.int64)
    if n >= 3:
        row = owner(offsets)
        at = np.flatnonzero(row[2:] == row[:-2])
        a, _ = _distinct(row[at] << 32 | codes[at])
        b, _ = _distinct(a << 32 | codes[at + 1])
        c, k = _distinct(b << 32 | codes[at + 2])
        again = at[np.bincount(c, minlength=k)[c] > 1]
        for step in range(3):
            covered[again + step] = 1
    return rowsum(covered[:n], offsets)


def _features(text: pa.Array) -> list[np.ndarray]:
    flat, offsets = split_words(text)
    codes, words = coded(flat)
    of = lambda values: rowsum(np.asarray(values, dtype=np.int64)[codes] if len(codes) else np.zeros(0, np.int64), offsets)
    flag = lambda x: x.cast(pa.int64()).to_numpy(zero_copy_only=False)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    lettered = flag(pc.match_substring_regex(words, r"\p{L}"))
    caps = flag(pc.and_(pc.utf8_is_upper(words), pc.match_substring_regex(words, r"\p{L}{2}")))
    ends = flag(pc.match_substring_regex(words, r"(^|[^.!?])[.!?][\"')]*$"))
    symbols = pc.count_substring_regex(words, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(pc.fill_null(text.cast(pa.large_string()), ""), "\n")
    line_offsets = np.asarray(lines.offsets, dtype=np.int64)
    line_offsets, line = line_offsets - line_offsets[0], lines.flatten()
    wordy = pc.match_substring_regex(line, "[^ \t-\r]").to_numpy(zero_copy_only=False)
    own = owner(line_offsets)[wordy]
    line_codes, _ = coded(line.filter(pa.array(wordy)))
    rows = len(text)
    n_lines = np.bincount(own, minlength=rows)
    key = np.unique(own << 32 | line_codes)
    first = np.bincount(key >> 32, minlength=rows)
    return [np.diff(offsets), of(chars), of(symbols), n_lines - first, repeat_words(codes, offsets), n_lines, of(caps), of(lettered), of(ends), of((chars <= 3).astype(np.int64))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS) for every row, in one pass over the texts."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in _features(b.column(1))]], [id_col, *COUNTS])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(AGAINST)).when(good, F.lit(FOR)).otherwise(F.lit(ABSTAIN))


def votes() -> dict[str, Column]:
    """The rules; a text without words makes every rule with a ratio abstain."""
    c = F.col
    share = lambda a, b: c(a) / F.when(c(b) > 0, c(b))  # noqa: E731  null without words, so that neither side votes
    return {
        "v_length": _vote(c("n_words") < 50, c("n_words") >= 80),
        "v_symbols": _vote(share("n_symbols", "word_chars") > 0.08, share("n_symbols", "word_chars") < 0.02),
        "v_lines": _vote(share("n_dup_lines", "n_lines") > 0.3, (share("n_dup_lines", "n_lines") < 0.1) & (c("n_lines") >= 4)),
        "v_repeats": _vote(share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.1),
        "v_caps": _vote(share("n_caps", "n_words") > 0.4, share("n_caps", "n_words") < 0.1),
        "v_letters": _vote(share("n_lettered", "n_words") < 0.7, share("n_lettered", "n_words") > 0.9),
        "v_sentences": _vote(share("n_ends", "n_words") < 0.01, (share("n_ends", "n_words") > 0.03) & (share("n_ends", "n_words") < 0.4)),
        "v_function_words": _vote(share("n_short", "n_lettered") < 0.12, (share("n_short", "n_lettered") > 0.2) & (share("n_short", "n_lettered") < 0.7)),
    }


def fit_patterns(rows: list, names: list[str], prior: float) -> Reliability:
    """Estimate from the counts of vote patterns: at most 3 ** len(names) rows."""
    rows = sorted(rows, key=lambda r: tuple(r[v] for v in names))
    pattern = np.array([[r[v] for v in names] for r in rows], dtype=np.int64).reshape(-1, len(names))
    return estimate(pattern, np.array([r["n"] for r in rows], dtype=float), prior)


def _odds(fitted: Reliability, names: list[str]) -> Column:
    odds = F.lit(fitted.prior)
    for i, v in enumerate(names):
        a, b, c = (float(x) for x in fitted.log_ratio[i])
        odds = odds + F.when(F.col(v) == AGAINST, a).when(F.col(v) == ABSTAIN, b).otherwise(c)
    return odds


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def keep(docs: DataFrame, text_col: str = "text", prior: float = 0.85) -> DataFrame:
    """The rows that judge() keeps, with their columns as they are. The verdict is taken again where the text is, so that no text is shuffled."""
    bound_batches(docs.sparkSession)
    rules = votes()
    names = list(rules)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    text = own[docs.columns.index(text_col)]
    voted = written(features(plain.select(F.lit(0).alias("k"), text), "k", text).withColumns(rules).groupBy(*names).agg(F.count("*").alias("n")), "votes")
    fitted = fit_patterns(voted.collect(), names, prior)
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.int64()) for x in _features(b.column(at))]], [*own, *COUNTS])

    schema = StructType([*plain.schema.fields, *[StructField(c, LongType()) for c in COUNTS]])
    judged = plain.mapInArrow(run, schema).withColumns(rules)
    return judged.where(~_base_failed() & (_odds(fitted, names) >= 0)).select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.85) -> DataFrame:
    """(id, COUNTS, base_failed, posterior, kept) for every row."""
    rules = votes()
    names = list(rules)
    voted = written(features(docs, id_col, text_col), "quality").withColumns(rules)
    fitted = fit_patterns(voted.groupBy(*names).agg(F.count("*").alias("n")).collect(), names, prior)
    return (
        voted.withColumn("base_failed", _base_failed())
        .withColumn("posterior", 1 / (1 + F.exp(-_odds(fitted, names))))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )
