"""Near titles meet on few grams: no pair is lost, and titles that only share common grams don't come to the ratio."""

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import near, similarity
from quillspark.operators import coverage


def _syllables(rng, n):
    return " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_titles_of_common_grams_do_not_come_to_the_ratio(spark, monkeypatch):
    rng = random.Random(11)
    left = [(i, "t", _syllables(rng, 10)) for i in range(600)]
    right = [(1000 + i, "t", _syllables(rng, 10)) for i in range(600)] + [(9000, "t", left[7][2][:20] + "x" + left[7][2][20:])]
    whole, pairs = similarity.ratio_from(0.92), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        pairs.add(1)
        return True

    monkeypatch.setattr(similarity, "ratio_from", lambda threshold: lambda a, b: whole(F.when(seen(a), a), b))
    schema = "id long, topic string, title_key string"
    got = {(r.id, r.covered_by) for r in coverage.similar_titles(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.92).collect()}
    assert got == {(7, 9000)} and 0 < pairs.value < 50


@pytest.mark.parametrize("threshold", [0.97, 0.92, 0.8, 0.5, 0.2])
def test_no_pair_is_lost(threshold, monkeypatch):
    """Small parts, blocks and tables of costs; short and long titles, signs beyond 16 bits, two topics with one hash."""
    for name, value in {"HOT": 3, "TITLES": 7, "ROWS": 40, "PAIRS": 50, "COSTS": 300}.items():
        monkeypatch.setattr(near, name, value)
    rng = random.Random(5)
    base = ["a", "ab", "abc", "aaaaaaaaaaaaaaaa", "\U0001f600\U0001f601 ção", *[_syllables(rng, rng.randint(1, 12)) for _ in range(25)], _syllables(rng, 70)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 2 + len(t) // 12)):
            i = rng.randint(0, len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "er"])
        return "".join(t) or "x"

    rows = sorted({(topic, t) for topic in "uv" for t in [*base, *[changed(t) for t in base], *[changed(t) for t in base]]})
    wanted, covering = [[rng.random() < 0.6 for _ in rows] for _ in range(2)]
    columns = {"topic": [r[0] for r in rows], "title": [r[1] for r in rows], "wanted": wanted, "covering": covering, "covered_by": list(range(len(rows)))}
    titles = pa.table(columns | {"salt": [1] * len(rows), "deal": [hash(i) * 7 for i in range(len(rows))]})
    slices = list(near.added(near.counter(threshold)(titles.to_batches())))[0]
    often = np.zeros((64, near.BUCKETS // 64), np.int64)
    for s, n in zip(slices.column(0).to_pylist(), slices.column(1).to_pylist(), strict=True):
        often[s] = np.frombuffer(n, np.int64)
    cut = pa.Table.from_batches(near.cutter(threshold, SimpleNamespace(value=often.ravel()))(titles.to_batches(20)))
    cut = cut.sort_by([("gram", "ascending"), ("item", "ascending"), ("place", "ascending")])
    got = {(r["topic"], r["id_title"], r["covered_by_title"], r["covered_by"]) for b in near.meeting(threshold)(cut.to_batches(13)) for r in b.to_pylist()}
    either = [(i, k) for i, (p, a) in enumerate(rows) for k, (q, b) in enumerate(rows) if wanted[i] and covering[k] and p == q and a != b]
    want = {(*rows[i], rows[k][1], k) for i, k in either if SequenceMatcher(None, rows[i][1], rows[k][1]).ratio() >= threshold}
    assert want and want <= got
    assert all((len(a) + len(b)) * threshold <= 2 * near.common(near.places(a), len(a), b) + 1e-6 for _, a, b, _ in got)


@pytest.mark.parametrize("m", [20, 300])
def test_grams_do_not_overlap(m):
    often = np.random.default_rng(1).integers(0, 50, (40, m))
    k, q = m // 6, 5
    at = near._rarest(often, k, q)
    assert at.shape == (40, k) and (np.diff(at, axis=1) >= q).all() and at.min() >= 0 and at.max() < m
    if m == 20:
        places = [p for p in np.ndindex(m, m, m) if p[1] - p[0] >= q and p[2] - p[1] >= q]
        assert all(row[a].sum() == min(row[list(p)].sum() for p in places) for row, a in zip(often, at, strict=True))
