"""The sharded trie model against a dictionary model, and Elias-Fano against plain arrays."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import ngram_lm


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (7, 3), (500, 40), (3000, 1 << 40)):
        v = np.sort(rng.integers(0, top, n))
        ef = ngram_lm.EliasFano(*ngram_lm.EliasFano.parts(v))
        assert (ef.get(np.arange(n)) == v).all()
        q = np.concatenate((v, v + 1, rng.integers(0, 2 * top + 2, 200)))
        assert (ef.successor(q) == np.searchsorted(v, q)).all()


def tokens(text):
    return [*re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


@pytest.mark.parametrize("frequent", [1 << 20, 25])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_lm, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_lm, "SHARD", 300)
    monkeypatch.setattr(ngram_lm, "PACK", 200)
    monkeypatch.setattr(ngram_lm, "SLICE", 40)
    rng = random.Random(4)
    vocab = [f"W{i}" for i in range(60)]
    rows = [(i, rng.choice([None, "", " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 40))), f"only{i} here"])) for i in range(150)]
    rows += rows[:7]
    got = ngram_lm.score(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, gain double")).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if not held(i)]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    words = sorted(((c, w) for w, c in uni.items() if w is not None), key=lambda x: -x[0])
    for least in sorted({c for c, _ in words}):
        if sum(c >= least for c, _ in words) <= frequent:
            break
    own = {w for c, w in words if c >= least}
    cls = lambda w: w if w is None or w in own else "RARE"
    rare = [c for w, c in uni.items() if cls(w) == "RARE"]
    bi, ctx = Counter(), Counter()
    for t in train:
        k = ["START", *map(cls, t)]
        bi.update(zip(k, k[1:]))
        ctx.update(k[:-1])
    p1 = lambda x: ((sum(rare) + len(rare) + 1) if x == "RARE" else uni[x] + 1) / (n + v + 1)
    want = {}
    for i, text in rows:
        t = tokens(text)
        k = ["START", *map(cls, t)]
        s = sum(math.log10((bi[a, b] + ngram_lm.MU * p1(b)) / (ctx[a] + ngram_lm.MU)) for a, b in zip(k, k[1:]))
        s += sum(math.log10((uni[w] + 1) / (sum(rare) + len(rare) + 1)) for w in t if cls(w) == "RARE")
        want[i] = (held(i), len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), s)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6
        assert abs(r.score - want[r.doc_id][5]) < 0.02 * r.n_tokens, (r, want[r.doc_id])


def test_empty_table(spark):
    assert ngram_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("frequent", [1 << 20, 25, 0])
def test_every_word_has_bigrams_of_its_own(spark, monkeypatch, frequent):
    """However few words the tries hold, scores are those of one bigram model over all words."""
    for name, value in (("FREQUENT", frequent), ("SHARD", 300), ("PACK", 200), ("SLICE", 40)):
        monkeypatch.setattr(ngram_lm, name, value)
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(60)]
    rows = [(i, rng.choice([None, "", " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 40))), f"only{i} here", "only held w0 only held"])) for i in range(150)]
    rows += rows[:7]
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), pooled=False).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if not held(i)]
    uni = Counter(w for t in train for w in t)
    bi, ctx = Counter(), Counter()
    for t in train:
        bi.update(zip(["START", *t], t))
        ctx.update(["START", *t[:-1]])
    p1 = lambda x: (uni[x] + 1) / (sum(uni.values()) + len(uni) + 1)
    want = {i: sum(math.log10((bi[a, b] + ngram_lm.MU * p1(b)) / (ctx[a] + ngram_lm.MU)) for a, b in zip(["START", *tokens(t)], tokens(t))) for i, t in rows}
    for r in got:
        assert abs(r.score - want[r.doc_id]) < (0.02 if frequent else 1e-6) * r.n_tokens + 1e-6, (r, want[r.doc_id])
