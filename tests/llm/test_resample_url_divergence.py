"""Importance resampling, URL reputations and the source audit against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import byte_terms, divergence, resample, url_filter

ODD = [None, "", " ", "12 3", "x" * 300_000, "É é ÉÉ", "a\x00b", "aZ-z9 Zz", "ab" * 3 + " ab ab", "\U0001f600a \U0001f600a"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["the", "É", "naïve", "Of"] * 5
    return ODD + [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60))) for _ in range(150)] + ["the same text " * 12] * 40


@pytest.mark.parametrize("digits", [True, False])
def test_words_by_bytes(digits, monkeypatch):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    want = [(i, w) for i, t in enumerate(texts()) for w in re.findall(pattern, (t or "").translate(LOWER))]

    def found():
        column = pa.array(["before", *texts(), "after"]).slice(1, len(texts()))
        words = byte_terms.Words(column, byte_terms.alphabet(digits))
        distinct = words.distinct()
        return [(i, distinct[c].decode()) for i, c in zip(words.row.tolist(), words.code.tolist())], len(distinct)

    assert found() == (want, len({w for _, w in want}))
    # With a hash of three values every group has other words in it: the bytes keep them apart.
    monkeypatch.setattr(byte_terms.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 3)
    assert found() == (want, len({w for _, w in want}))
    assert byte_terms.Words(pa.array([], pa.string()), byte_terms.alphabet(digits)).distinct() == []


def plain_sample(rows, target, low=1, high=1, percent=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda t: [zlib.crc32(" ".join(words(t)[i : i + n]).encode()) % 10000 for n in range(low, high + 1) for i in range(len(words(t)) - n + 1)]
    s, t = Counter(b for _, x in rows for b in runs(x)), Counter(b for x in target for b in runs(x))
    up, down = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * up / (float(s[b] + 1) * down)))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, runs(x)))
        out.append((i, len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    rest = [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in out if not r[4]]
    return sorted(drawn + rest, key=repr)


def test_resample(spark):
    rows = [*enumerate(texts()), (None, "w1 w2 w3 " * 20), (30, texts()[30]), (30, texts()[30])]
    target = ["w1 w2 w3 w1 w2", "the É naïve", None]
    docs = spark.createDataFrame([(i, t, 1, 2, "b") for i, t in rows], "doc_id long, text string, weight int, id int, Rank string").repartition(5)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for options in ({}, {"low": 1, "high": 2, "percent": 33}):
        got = sorted((tuple(r) for r in resample.sample(docs, wanted, **options).collect()), key=repr)
        assert got == plain_sample(rows, target, options.get("low", 1), options.get("high", 1), options.get("percent", 10))
    drawn = {r[0] for r in plain_sample(rows, target) if r[4]}
    kept = resample.resample(docs, wanted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {x for x in drawn if x is not None}
    assert resample.sample(docs.limit(0), wanted).count() == 0
    assert resample.sample(docs, wanted.limit(0)).where("rank is not null").count() == len(drawn)


def test_blocks_are_the_matrix(spark):
    docs = spark.createDataFrame([*enumerate(texts())], "doc_id long, text string")
    cells = Counter()
    for b in resample.matrix(docs).collect():
        indices, counts = resample.unzipped(b.indices, np.int32), resample.unzipped(b.counts, np.int32)
        assert len(b.indptr) == len(b.ids) + 1 and b.indptr[-1] == len(indices) == len(counts)
        for k, i in enumerate(b.ids):
            own = indices[b.indptr[k] : b.indptr[k + 1]]
            assert (np.diff(own) > 0).all()
            cells.update({(i, int(c)): int(n) for c, n in zip(own, counts[b.indptr[k] : b.indptr[k + 1]])})
    words = ((i, w) for i, t in enumerate(texts()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    assert cells == Counter((i, zlib.crc32(w.encode()) % 10000) for i, w in words)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("www.example.org", "/es/x", "allow"), ("org", "/", "block"), (None, "/", "block"), ("com", "", "allow"), ("com", "", None)]


def fitting(host, path):
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES if h is not None and v and ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def test_rules(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT", 3)  # so that hot hosts are cut to pieces
    urls = [None, "", "no url", "http://", "HTTP://WWW.Example.ORG/es/x?q", "https://example.org", "https://example.org?x=/es/", "https://a.example.org/es/#f", "https://b.com", "x://y://z.org/p", "http://h.net/a\nb?c", "http://a..org/", "http://" + "a." * 300 + "org/" + "p" * 9000]
    urls += ["http://hot.net/same"] * 300
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "http://x.org/", "", "")], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    none = spark.createDataFrame([], "host string, n long, bad long")
    got = {r.page_id: r for r in url_filter.judge(pages, rules, none).collect()}
    assert len(got) == len(urls) + 1 and got[None].verdict == "block"
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].translate(LOWER), m[2]
        rule, verdict = fitting(host, path) if host else (None, None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u
    assert url_filter.judge(pages.limit(0), rules, none).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), none).collect()} == {"allow"}
    kept = url_filter.keep(pages, rules, none)
    assert kept.columns == pages.columns and kept.count() == sum(r.verdict == "allow" for r in got.values())


def test_reputation_is_shrunk_and_bounded(spark):
    """Hosts with many bad pages are blocked, those with a few are not; a host without labels goes by its domain; SUFFIXES count as one label."""
    rng = random.Random(1)
    seen = {f"good{i}.net": (200, rng.randint(2, 20)) for i in range(40)} | {f"h{i}.farm.net": (100, 97) for i in range(8)}
    seen |= {"bad.net": (300, 280), "few.net": (1, 1), "x.spam.co.uk": (80, 78), "y.spam.co.uk": (90, 88), "ok.co.uk": (300, 10)}
    outcomes = spark.createDataFrame([(h, n, k) for h, (n, k) in seen.items()] + [("", 5, 5), ("null.net", 0, 0)], "host string, n long, bad long")
    hosts = [*seen, "new.farm.net", "z.spam.co.uk", "unseen.org", "other.net", "null.net"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = {r.host: r for r in url_filter.judge(pages, rules, outcomes).collect()}
    blocked = {h for h, r in got.items() if r.verdict == "block"}
    assert blocked == {"bad.net", "x.spam.co.uk", "y.spam.co.uk", "z.spam.co.uk", "new.farm.net"} | {f"h{i}.farm.net" for i in range(8)}
    assert got["few.net"].bad_rate > got["other.net"].bad_rate and got["few.net"].bad_bound < 0.5
    # The plain version of the three levels.
    suffix = lambda h: "co.uk" if h.endswith("co.uk") else "net"
    domain = lambda h: ".".join(h.split(".")[-3:] if h.endswith("co.uk") else h.split(".")[-2:])
    n, k = sum(x for x, _ in seen.values()), sum(x for _, x in seen.values())
    post = lambda h: (k + 0.5) / (n + 1)
    for of in (suffix, domain, lambda h: h):
        members = defaultdict(lambda: [0, 0, 0.0])
        for h, (a, b) in seen.items():
            members[of(h)][0] += a
            members[of(h)][1] += b
            members[of(h)][2] = post(h)
        rho = sum((b - a * m) ** 2 - a * m * (1 - m) for a, b, m in members.values()) / sum(a * (a - 1) * m * (1 - m) for a, b, m in members.values())
        z = 1 / min(max(rho, 0.001), 0.25) - 1
        after = {x: (m * z + b) / (z + a) for x, (a, b, m) in members.items()}
        post = (lambda after, of: lambda h: after[of(h)])(after, of)
    assert all(abs(got[h].bad_rate - post(h)) < 1e-9 for h in seen)


def test_outcomes_of_labels(spark):
    pages = spark.createDataFrame([(1, "http://A.net/en/7?x"), (2, "http://a.net/de/8/"), (3, "http://a.net/en/9"), (4, None), (5, "http://b.net/en/7.html"), (6, "http://b.net/en/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, None), (8, 1, 0), (9, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in url_filter.outcomes_of_labels(pages, labels).collect()) == [("a.net", 3, 2), ("b.net", 1, 0)]


def plain_audit(rows, least, smooth=5, top=50):
    docs = [((lang or ""), (source or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = [t for t, n in seen.items() if n >= least]

        def shares(group):
            count = Counter()
            for d in group:
                count.update({t: d[2][t] for t in kept if t in d[2]})
            n = sum(count.values())
            return count, {t: 1 + 10**9 * (count[t] + smooth) // (n + smooth * len(kept)) for t in kept}

        q = shares(own)[1]
        groups = {s: shares([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (count, p) in groups.items():
            pairs = sorted(((-sum(abs(p[t] - o[t]) for t in kept), x.encode(), x) for x, (_, o) in groups.items() if x != s))
            terms = sorted((-(p[t] - q[t]), t.encode(), t) for t in kept if count[t] and p[t] > q[t])[:top]
            out += [(lang, s, part, x, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, x) in enumerate(found)]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(5)
    rows = [(t, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "É", None, "zz"])) for t in texts() * 2]
    rows += [("alone", "xx", "s1"), (None, "xx", "s2"), ("", "yy", None)] + [("w1 only words of one source " * 40, "en", "big")] * 30
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, value int, Term string").repartition(6)
    for least, options in ((3, {}), (1, {"cells": 7, "rows": 2}), (30, {"rows": 3})):
        got = sorted(tuple(r) for r in divergence.audit(docs, least, **options).collect())
        assert got == plain_audit(rows, least), (least, options)
    assert divergence.audit(docs.limit(0)).count() == 0
