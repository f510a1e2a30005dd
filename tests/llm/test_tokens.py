"""BPE and token counts against the library on whole texts; sharding against its law."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe, sharding, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", " the", "  ", "\n", "\t", " ", "'s", "'S", "don't", "é", "ÀÉ", "naïve", "北京", "🙂👍🏽", "123", "٣", "<|endoftext|>", "<|startoftext|>", "...", "|", "a", "Z", "é", " ", "　", " ", "​", "Σίσυφος", "İ", "ǅ", "!!", "x" * 90, "\x00", "\x1c", "ﬁ", "ß"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    made += [" ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    long = ["xyzzy" * 200_000, "<|startoftext|>" * 10_000, "!" * 50_000 + "<|endoftext|>", "a\nb\n\nc \n d " * 2000]
    return [None, "", " ", "\n", "a " * 30000, "x" * 20000, *long, *made, *made[:20]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def test_digests_equal_the_library(docs):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.digests(docs, BYTE).collect()}
    assert len(got) == len(texts())
    for i, text in enumerate(texts()):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_distinct_word_is_encoded_once(spark, docs):
    packs = bpe._packs(docs.repartition(3), 5, "doc_id", "text").cache()
    met = [(r.bucket, w) for r in packs.where("bucket is not null").collect() for w in bpe._from_strings(bpe._parts(bytes(r.data), 2)[1]).to_pylist()]
    assert len({w for _, w in met}) == len(set(met)) < len(met)


def test_round_trip_and_empty_table(spark, docs):
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts())}
    assert bpe.digests(docs.limit(0), BYTE).count() == 0


def test_counts_equal_the_library(docs):
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, WORD).collect()}
    for i, text in enumerate(texts()):
        assert got[i].n_tokens == len(t.encode(text or "", add_special_tokens=False).ids), text
        assert got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 2048)
        assert got[i].over_limit or got[i].fit_chars == len(text or "")


def test_longest_prefix_within_a_limit(spark):
    t, some = Tokenizer.from_file(WORD), [x for x in texts() if x and len(x) < 60][::7]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for limit in (1, 3, 8):
        for r in token_counts.prefix_counts(docs, WORD, limit).collect():
            counts = [len(t.encode(some[r.doc_id][:i], add_special_tokens=False).ids) for i in range(len(some[r.doc_id]) + 1)]
            assert r.fit_chars == max(i for i, n in enumerate(counts) if n <= limit), some[r.doc_id]
            assert (r.prefix_tokens or [0])[-1] == counts[-1]


def test_every_prefix_and_truncation():
    t, counts = Tokenizer.from_file(WORD), token_counts.PrefixCounts(WORD)
    for text in [x for x in texts() if x and len(x) < 60][::9]:
        assert counts.text(text) == [len(t.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text
    word = "x" * 200_000 + "y<|endoftext|>!"
    at = counts.text(word)
    assert len(at) == len(word) + 1 and all(at[i] == len(t.encode(word[:i], add_special_tokens=False).ids) for i in (0, 1, 77, 5000, *range(200_000, len(word) + 1)))
    cut = counts.truncate("the unbelievable strangeness of tokenisation", 4)
    assert len(t.encode(cut, add_special_tokens=False).ids) <= 4


def test_sharding_law(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "same text", "x" * rng.randint(0, 3000)]), rng.choice(["en", None]), rng.choice(["a", "b", "c"]), 1) for i in range(1003)] + [(7, "same text", "en", "a", 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for k, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    import zlib

    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id != 7:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    ranges = [(min(r.hilbert for r in own), max(r.hilbert for r in own)) for _, own in sorted(by.items())]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert sharding.shard(docs.limit(0)).count() == 0


def test_hilbert_index_is_a_walk_of_neighbours(spark):
    from pyspark.sql import functions as F

    for n in (2, 3):
        grid = spark.range(1 << (3 * n)).select(*[F.expr(f"cast(shiftright(id, {3 * i}) & 7 as int)").alias(f"c{i}") for i in range(n)])
        at = [f"c{i}" for i in range(n)]
        walk = [tuple(r)[:n] for r in grid.withColumn("h", sharding.hilbert_index([F.col(c) for c in at], 3)).orderBy("h").collect()]
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(walk, walk[1:]))


def test_shards_are_written_whole_and_pruned(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 14)), f"l{i % 7}", f"s{i % 11}", i, "k") for i in range(3000)] + [(None, None, None, None, 1, "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, Slot string")
    bounds = sharding.write(docs, str(tmp_path / "out"))
    every = spark.read.parquet(str(tmp_path / "out/rows"))
    assert sorted((tuple(r) for r in every.select(*docs.columns).collect()), key=repr) == sorted(rows, key=repr)
    want = sorted((r.doc_id or -1, r.shard, r.slot) for r in sharding.shard(docs).collect())
    assert sorted((r.doc_id or -1, r.shard_, r.slot_) for r in every.collect()) == want
    assert sum(r.n for r in bounds.collect()) == len(rows) and bounds.count() == 16
    asks = [{"lang": "l3"}, {"source": "s2"}, {"length": (9000, 12000)}, {"lang": "l1", "source": "s4", "length": (0, 100)}]
    opened = []
    for ask in asks:
        low, high = ask.get("length", (0, 1 << 40))
        wanted = [r[0] for r in rows if r[0] is not None and r[2] == ask.get("lang", r[2]) and r[3] == ask.get("source", r[3]) and low <= len(r[1]) <= high]
        got = sharding.read(spark, str(tmp_path / "out"), **ask)
        assert set(wanted) <= {r.doc_id for r in got.collect()}
        opened.append(got.select("shard_").distinct().count())
    assert all(n < 16 for n in opened[2:]) and opened[3] <= 8 and sum(opened) < 48, opened
    assert sharding.write(docs.limit(0), str(tmp_path / "none")).count() == sharding.read(spark, str(tmp_path / "none")).count() == 0
