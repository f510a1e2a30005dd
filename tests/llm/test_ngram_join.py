"""The prefix-tree join against all pairs, and its parts."""

import random
import re

import numpy as np
import pytest

from quillspark.llm import common, components, ngram_join


def words(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((root(i), root(j)))
                up[s] = r
    least = {}
    for i in sorted(up):
        least.setdefault(root(i), i)
    return {i: (len(s), least[root(i)]) for i, s in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and out:
            base = words(rng.choice(out)[1]) or ["x"]
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            text = " ".join(base)
        elif kind < 0.6:
            text = rng.choice([None, "", "  \n", "one", "One two", "one two three four", "A b c d e"])
        else:
            text = " ".join(passage * (rng.random() < 0.5) + [rng.choice(vocab) for _ in range(rng.randint(3, 120))])
        out.append((i, text))
    return out


@pytest.mark.parametrize(("group", "hot", "bucket"), [(1024, 1 << 17, 1_000_000), (8, 2, 500)])
def test_equals_all_pairs(spark, monkeypatch, group, hot, bucket):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    rows = corpus(group)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_finds_exactly_the_similar_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(150)]
    sets += [np.unique(np.append(s, 60 + k)) for k, s in enumerate(sets[:60])] + [s[:-1] for s in sets[:40] if len(s) > 1]
    sets = [np.array(x) for x in {tuple(s) for s in sets}]
    trie = ngram_join.Trie(sets)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(trie.similar(s, 400)) == want


def test_sql_equals_all_pairs():
    duckdb = pytest.importorskip("duckdb")
    from quillspark.llm.queries import NGRAM_JOIN_SQL

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = corpus(31)
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    assert {i: (n, c) for i, n, c in con.execute(NGRAM_JOIN_SQL).fetchall()} == brute(rows)


def test_tables_beyond_a_bound_are_never_sent(spark, monkeypatch):
    """The driver holds what is sent, so the rows decide and not the bytes."""
    small, large = (spark.range(n).withColumnRenamed("id", "node") for n in (common.SENT, common.SENT + 1))
    plan = lambda t: spark.range(10).withColumnRenamed("id", "node").join(common.met(t), "node")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
    rows = [(3, 4), (4, 5), (5, 6), (6, 7), (1, 2), (9, 9), (None, 1), (3, 4)]
    links = spark.createDataFrame(rows, "a long, b long")
    want = {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3}
    for sent in (common.SENT, 0):
        monkeypatch.setattr(common, "SENT", sent)
        assert {r.node: r.label for r in components.components(links).collect()} == want
