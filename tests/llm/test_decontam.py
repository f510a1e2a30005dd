"""Decontamination where content words do not suffice."""

import random

import numpy as np
import pyarrow as pa

from quillspark.llm import decontam


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def prose(rng, n, vocab):
    return [rng.choice(["the", "of", "and", "to", "in", "is", "was", "it"]) if rng.random() < 0.4 else f"term{rng.randrange(vocab)}" for _ in range(n)]


def test_items_of_few_content_words(spark):
    rng = random.Random(6)
    few = "it was the of the alpha and it was in the beta of the gamma and it is to"
    items = [few, "the of and to in is", "delta"]
    texts = [" ".join(prose(rng, 200, 40000)) for _ in range(300)]
    at = [10, 50, 90]
    for d, item in zip(at, items, strict=True):
        words = texts[d].split()
        words[70:70] = item.split()
        texts[d] = " ".join(words)
    texts[120] += " " + few.replace("beta", "zeta")  # not word by word
    texts[150] += " " + few[:40]
    texts[151] = few[40:] + " " + texts[151]  # not over two texts
    bare = [f" {t} " for t in texts]
    want = {(d, k) for d, t in enumerate(bare) for k, i in enumerate(items) if f" {i} " in t}
    assert want >= set(zip(at, range(3), strict=True))
    assert found(spark, texts, items) == want


def test_leaks_do_not_make_their_own_words_common(spark):
    rng = random.Random(7)
    items = [" ".join(prose(rng, 30, 40000)) for _ in range(4)]
    texts = [" ".join(prose(rng, 120, 40000)) for _ in range(300)]
    want = set()
    for d in range(0, 300, 3):
        words, copy = texts[d].split(), items[0].split()
        if d % 2:  # a near copy
            for i in rng.sample(range(len(copy)), 3):
                copy[i] = f"term{rng.randrange(40000)}"
        at = rng.randrange(len(words))
        words[at:at] = copy
        texts[d] = " ".join(words)
        want.add((d, 0))
    got = found(spark, texts, items)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_tiny_table(spark):
    rng = random.Random(8)
    items = [" ".join(prose(rng, 30, 40000)) for _ in range(3)]
    near = [i.replace(i.split()[9], "changed") for i in items]
    texts = [" ".join([*prose(rng, 60, 40000), near[k % 3] if k < 6 else ""]) for k in range(8)]
    assert found(spark, texts, items) == {(k, k % 3) for k in range(6)}


def every_passage(items, basis, texts):
    """What counts by the stated rule, every passage of every text looked at for every item, without bounds and short cuts."""
    codes, words, offsets = decontam._bare(pa.array(texts, pa.string()))
    to = {w: i for i, w in enumerate(items.vocabulary.to_pylist())}
    place = np.array([to.get(w, -1) for w in words.to_pylist()])
    out = {}
    for r in range(len(texts)):
        a, z = offsets[r], offsets[r + 1]
        room = max(z - a - decontam.WINDOW, 0)
        for start in sorted({a + min(k * decontam.STRIDE, room) for k in range(-(-room // decontam.STRIDE) + 1)}):
            end = min(start + decontam.WINDOW, z)
            if end <= start:
                continue
            vec = decontam._vectors(basis, words, codes, np.array([start]), np.array([end]))[0]
            for k, own in enumerate(items.words):
                own_passages = slice(items.first[k], items.first[k + 1])
                if k in items.plain or not own or not (items.vectors[own_passages] @ vec >= items.cosine[own_passages]).any():
                    continue
                region = place[codes[max(a, start - items.reach[k]) : min(z, end + items.reach[k])]].tolist()
                near = [x for x in region if x in own or x in items.answers[k]]
                common = decontam.lcs(own, near) / len(own)
                answered = bool(items.answers[k]) and decontam.lcs(items.answers[k], near) >= 0.8 * len(items.answers[k])
                was = out.get((r, k), (0.0, False))
                out[r, k] = (max(was[0], common), was[1] or answered)
    return {x for x, (common, answered) in out.items() if common >= decontam.ALONE or common >= decontam.WITH_ANSWER and answered}


def test_no_passage_that_counts_is_lost(spark):
    """Scattered paraphrases, repeated and cut items, long texts, and a basis that says nothing: the same finds as looking at every passage."""
    rng = random.Random(10)
    items = [" ".join(prose(rng, rng.randint(14, 70), 40000)) for _ in range(12)]
    texts = ["", "one", " ".join(items)]
    for i in range(400):
        item = items[i % 12].split()
        kept = [w for w in item if rng.random() < rng.choice([0.45, 0.6, 0.8])]
        gap = rng.randint(0, 3)
        words = prose(rng, rng.randint(0, 200), 40000)
        for w in kept:
            words += [*prose(rng, rng.randint(0, gap), 40000), w]
        words += prose(rng, rng.randint(0, 100), 40000)
        texts.append(" ".join(words + (item[: len(item) // 2] if i % 7 == 0 else [])))
    docs = spark.createDataFrame(list(enumerate(texts + [" ".join(prose(rng, 200, 40000)) for _ in range(400)])), "doc_id long, text string")
    stats, sample = decontam.statistics(docs, "text", items)
    real = decontam.latent_basis(sample, decontam._sequences(pa.array(items, pa.string())), stats)
    for basis in (real, np.random.default_rng(2).normal(size=real.shape).astype(real.dtype)):
        built = decontam.prepare(list(range(len(items))), items, basis, stats)
        got = {(r, k) for r, k, *_ in decontam._found(built, basis, pa.array(texts, pa.string())) if k not in built.plain}
        want = every_passage(built, basis, texts)
        assert got == want and len(want) > 60, (len(got), len(want), got ^ want)


def test_basis_is_fitted_on_every_word(spark):
    """The product with the corpus is that of all its passages, each word once, whatever the size of the table and its partitions."""
    rng = random.Random(11)
    texts = [" ".join(prose(rng, rng.choice([1, 31, 32, 33, 90]), 3000)) for _ in range(900)] + ["", None, "a a a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    stats, passages = decontam.statistics(docs, "text", [texts[0] + " one more"])
    assert passages.agg({"n": "sum"}).first()[0] == sum(-(-len((t or "").split()) // decontam.WINDOW) for t in texts)
    codes, words, offsets = decontam._bare(pa.array(texts, pa.string()))
    terms = decontam._terms(words)[codes]
    cut = [terms[i : min(i + decontam.WINDOW, z)] for a, z in zip(offsets[:-1], offsets[1:]) for i in range(a, z, decontam.WINDOW)]
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((decontam.TERMS, 6)))[0]
    want, got = decontam._gram(cut, q, stats.idf), decontam._product(passages, q, stats.idf)
    assert np.abs(want - got).max() < 1e-5 * np.abs(want).max()
