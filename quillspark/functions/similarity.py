"""Similarity that has no built-in: Arrow functions over pairs that joins have already narrowed down."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of characters in matching blocks, longest first; 0 if either side is empty."""
    from difflib import SequenceMatcher

    for left, right in pairs:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64")


def ratio_from(threshold: float):
    """ratio() where it is at least the threshold, else 0: most pairs fall short by the characters they share, which are counted first."""

    @F.pandas_udf(DoubleType())
    def over(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from collections import Counter
        from difflib import SequenceMatcher
        from functools import lru_cache

        letters = lru_cache(maxsize=100_000)(Counter)

        def one(a: str, b: str) -> float:
            if not a or not b:
                return 0.0
            # An upper bound, as SequenceMatcher.quick_ratio has it.
            if 2.0 * (letters(a) & letters(b)).total() / (len(a) + len(b)) < threshold:
                return 0.0
            return SequenceMatcher(None, a, b).ratio()

        for left, right in pairs:
            yield pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")

    return over
