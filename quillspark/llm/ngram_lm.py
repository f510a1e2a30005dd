"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is a bigram model over words and an end of text. Unigrams have add-one
estimates; the probability of x after v is (c(v,x) + MU p(x)) / (c(v) + MU).
The tries hold the bigrams of the FREQUENT most frequent words. The others are
either pooled into one class inside which each word keeps its own add-one
estimate, or (pooled=False) have contexts and successors of their own: bigrams
with such a word are counted by a grouping of their hashes, so no word and no
bigram is left out however long the vocabulary. Either way the probabilities
sum to 1.

N-grams are dealt to shards by context (frequent contexts by context and slice
of successors, so that no shard follows a hot word). A shard is a trie of two
levels in one memory-mapped file: contexts and their pointers as Elias-Fano
sequences, successors as an Elias-Fano sequence that restarts above the last
value of the context before, and smoothed log probabilities quantised to 8 bits.
A query finds its context, then the successor of its own value within the
context's range. Texts meet the shards' tries in the task that builds them, so
neither the model nor the texts are gathered anywhere.

Words are told apart by 64-bit hashes. Edge cases: a null or empty text is one
token, the end; without training rows every token is unknown and the score is
the base score; repeated rows are scored each and count each in training; texts
are read whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, coded, fold, hash_words, mix, owner, rowsum, runs, split_words, unzipped, written, zipped

#: Words with ids of their own, at most; what is broadcast is 16 bytes for each.
FREQUENT = 1 << 20
MU = 60.0
#: Tokens of one shard and of one packed part, about; occurrences of a context above which its successors are sliced.
SHARD, PACK, SLICE = 2_000_000, 500_000, 500_000
_X = 21  # bits of a word id


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
#: Set bits of every byte, and the place of its first, second, ... set bit.
_ONES, _PLACE = _BITS.sum(1).astype(np.uint8), np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, and two more for each bit of its unary part to select in it."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.concatenate(([0], np.cumsum(_ONES[high].reshape(-1, 4).sum(1, dtype=np.int64))))
        # Ones and zeros before each four bytes: a select looks up its four bytes here and steps over them.
        self.ones, self.zeros = ones.astype(np.uint32), (32 * np.arange(len(ones)) - ones).astype(np.uint32)
        self.buckets = int(self.zeros[-1])
        self.eight = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))  # the eight bytes from each byte on

    def _select(self, i: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place in the unary part of the i-th one (flip 0) or zero (flip 255)."""
        k = np.searchsorted(before, i.astype(np.uint32), "right") - 1
        left, at, last = i - before[k].astype(np.int64), k * 4, len(self.high) - 1
        for _ in range(3):
            here = _ONES[self.high[np.minimum(at, last)] ^ np.uint8(flip)]
            on = left >= here
            left, at = left - here * on, at + on
        return at * 8 + _PLACE[self.high[np.minimum(at, last)] ^ np.uint8(flip), np.minimum(left, 7)]

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
        low = np.concatenate([np.packbits(((v[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()) for i in range(0, n, 65536)]) if n and bits else np.zeros(0, np.uint8)
        up = (v >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((n + (int(up[-1]) if n else 0) + 33) // 32 * 32, np.uint8)
        unary[up + np.arange(n)] = 1
        return n, bits, np.concatenate((low, np.zeros(9, np.uint8))), np.packbits(unary)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word = self.eight[at >> 3].astype(np.uint64)
        return ((word >> (64 - self.bits - (at & 7)).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, self.ones, 0) - i) << self.bits | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is at least x (n if there is none)."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        up = np.minimum(x >> self.bits, self.buckets - 1)
        before = np.maximum(up - 1, 0)
        a = np.where(up > 0, self._select(before, self.zeros, 255) - before, 0)
        b = np.minimum(self._select(up, self.zeros, 255) - up, self.n)
        a, target = np.minimum(a, self.n), x & ((1 << self.bits) - 1)
        beyond = (x >> self.bits) >= self.buckets
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < target)
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return np.where(beyond, self.n, a)


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words by hash, their counts, and the totals of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    texts: int
    rare_tokens: int
    rare_distinct: int

    @property
    def rare(self) -> int:
        return len(self.hashes)

    def class_counts(self) -> np.ndarray:
        """Counts by class id: frequent words, rare words together, end, and start as a context."""
        return np.concatenate((self.counts, [self.rare_tokens, self.texts, self.texts])).astype(np.float64)

    def class_p(self) -> np.ndarray:
        """Add-one unigram probability by class id; the rare class has the mass of its words and of one unknown word."""
        top = np.concatenate((self.counts + 1.0, [self.rare_tokens + self.rare_distinct + 1.0, self.texts + 1.0, 1.0]))
        return top / (self.tokens + self.distinct + 1.0)

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        found = at < len(self.hashes)
        found[found] = self.hashes[at[found]] == h[found]
        return np.where(found, at, self.rare)


def count_words(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Vocabulary]:
    """(h, c) of all training words, and the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            h, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            u, inv = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, c, len(u)).astype(np.int64))], ["h", "c"])

        for b in batches:
            flat, _ = split_words(b.column(0), lower=True)
            if len(flat):
                codes, words = coded(flat)
                held.append((hash_words(words), np.bincount(codes, minlength=len(words))))
            if sum(len(x) for x, _ in held) > 1_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    train = docs.where(~_held(id_col))
    texts = train.count()
    words = written(train.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    # How many words have each count, up to 65,535: decides which counts fit the table.
    by_count = words.groupBy(F.least("c", F.lit(65535)).alias("k")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("k")).collect()
    least, n = 1 << 62, 0
    for r in by_count:
        if n + r.n > FREQUENT:
            break
        least, n = r.k, n + r.n
    top = words.where(F.col("c") >= least).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    total, distinct = sum(r.c for r in by_count), sum(r.n for r in by_count)
    return words, Vocabulary(h[order], c[order], total + texts, distinct + (texts > 0), texts, total - int(c.sum()), distinct - len(h))


def _held(id_col: str):
    return F.coalesce(fold(id_col, 7), F.lit(0)) == 2


def _classes(text: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class ids of all tokens with the end, offsets of the texts in them, and the rare words as (row, hash)."""
    flat, offsets = split_words(text, lower=True)
    codes, words = coded(flat)
    h = hash_words(words)
    ids = v.ids(h)
    rows = len(offsets) - 1
    ends = offsets[1:] + np.arange(rows)
    out = np.full(len(codes) + rows, v.rare + 1, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids[codes] if len(codes) else 0
    own = owner(offsets)
    is_rare = ids[codes] == v.rare if len(codes) else np.zeros(0, bool)
    return out, np.concatenate((offsets[:1], ends + 1)), own[is_rare], h[codes[is_rare]] if len(codes) else np.zeros(0, np.uint64)


def _contexts(x: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The class before each token; the start before the first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[offsets[:-1]] = v.rare + 2
    return out


def _ends(row: np.ndarray, rows: int) -> pa.Array:
    """Offsets of lists whose elements stand in these rows, ascending."""
    return pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))), pa.int32())


def _texts(docs: DataFrame, vocabulary, id_col: str, text_col: str, pooled: bool) -> DataFrame:
    """One row for each text: what needs only the broadcast vocabulary, its rare words, and unless they are pooled its bigrams with one.

    In those bigrams frequent words are given by their ids, others by their hashes; c is the count of a frequent x.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        p, c = v.class_p(), v.class_counts()
        base, smooth = np.log10(p), np.log10(MU * p)
        context = np.log10(c + MU)
        for b in batches:
            x, offsets, rare_row, rare_h = _classes(b.column(3), v)
            frequent = x != v.rare
            known = frequent & (c[x] > 0)
            known_n = rowsum(known.astype(np.int64), offsets)
            base_sum = rowsum(np.where(frequent, base[x], 0.0), offsets)
            before = _contexts(x, offsets, v)
            if pooled:
                own = np.zeros(len(x), bool)
                lm = rowsum(smooth[x] - context[before], offsets)
            else:
                own = ~frequent | (before == v.rare)
                lm = rowsum(np.where(frequent, smooth[x], 0.0) - np.where(before != v.rare, context[before], 0.0), offsets)
            names = x.copy()
            names[~frequent] = rare_h.view(np.int64)
            count = pa.array(c[x[own]].astype(np.int64), mask=~frequent[own])
            pairs = pa.StructArray.from_arrays([pa.array(_contexts(names, offsets, v)[own]), pa.array(names[own]), count], ["v", "x", "c"])
            rare = pa.ListArray.from_arrays(_ends(rare_row, len(b)), pa.array(rare_h.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(known_n, pa.int64()), pa.array(base_sum), pa.array(lm), rare, pa.ListArray.from_arrays(_ends(owner(offsets)[own], len(b)), pairs)],
                ["id", "key", "held_out", "n_tokens", "known", "base", "lm", "rare", "pairs"],
            )

    shaped = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), _held(id_col).alias("held_out"), text_col)
    return shaped.mapInArrow(run, f"id {kind}, key long, held_out boolean, n_tokens long, known long, base double, lm double, rare array<long>, pairs array<struct<v: long, x: long, c: long>>")


#: Kinds of packed rows: bigrams of a pack's texts for one shard, the keys of a pack's texts, sums for a pack's texts.
_BIGRAMS, _KEYS, _SUMS = 0, 1, 2


def _sewn(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def _cut(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    at = np.cumsum([4 * (n + 1), *np.frombuffer(data, np.uint32, n, 4).tolist()])
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _pairs(docs: DataFrame, vocabulary, shards: int, id_col: str, text_col: str, pooled: bool) -> DataFrame:
    """(shard, pack, kind, data): bigrams packed by shard, with the place in the pack of the text that each comes from, and each pack's keys.

    A pack is named by a hash of its keys, so a task that runs again names it alike.
    """

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        import xxhash

        v: Vocabulary = vocabulary.value
        names = np.concatenate([k for k, *_ in held])
        train = np.concatenate([t for _, t, *_ in held])
        base = np.cumsum([0, *(len(k) for k, *_ in held)])[:-1]
        own = np.concatenate([o + s for (_, _, o, _), s in zip(held, base, strict=True)]).astype(np.uint32)
        pair = np.concatenate([p for *_, p in held])
        held.clear()
        pack = int(np.array([xxhash.xxh3_64_intdigest(names.tobytes())], np.uint64).view(np.int64)[0])
        c, x = pair >> _X, pair & ((1 << _X) - 1)
        slices = (v.class_counts()[c] // SLICE).astype(np.int64) + 1
        shard = (mix((c * 1024 + x % np.minimum(slices, 1024)).view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((pair, shard))
        pair, own, shard = pair[order], own[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        keys, kinds, data = [pack % shards], [_KEYS], [zipped(names)]
        for k in range(shards):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                keys.append(k)
                kinds.append(_BIGRAMS)
                data.append(_sewn([zipped(np.diff(pair[a:b], prepend=0)), zipped(own[a:b]), np.packbits(train[own[a:b]]).tobytes()]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([pack] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["shard", "pack", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            v: Vocabulary = vocabulary.value
            x, offsets, _, _ = _classes(b.column(2), v)
            before, own = _contexts(x, offsets, v), owner(offsets)
            if not pooled:
                both = (x != v.rare) & (before != v.rare)
                before, own, x = before[both], own[both], x[both]
            held.append((b.column(0).to_numpy(), ~b.column(1).to_numpy(zero_copy_only=False).astype(bool), own, before << _X | x))
            n += len(x)
            if n > PACK:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    shaped = docs.select(F.xxhash64(id_col, text_col).alias("key"), _held(id_col).alias("held_out"), text_col)
    return shaped.mapInArrow(run, "shard int, pack long, kind int, data binary")


class Trie:
    """Two levels of one shard, in a memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:128].view(np.int64)
        at, seqs = 128, []
        for k in range(3):
            n, bits, low, high = head[4 * k : 4 * k + 4].tolist()
            seqs.append(EliasFano(n, bits, raw[at : at + low], raw[at + low : at + low + high]))
            at += low + high
        self.contexts, self.pointers, self.successors = seqs
        self.book = np.frombuffer(raw[at : at + 1024].tobytes(), np.float32)
        self.codes = raw[at + 1024 :]

    @staticmethod
    def write(path: str, pairs: np.ndarray, log_p: np.ndarray) -> None:
        """pairs: distinct context << _X | word, ascending."""
        c, x = pairs >> _X, pairs & ((1 << _X) - 1)
        contexts, starts = np.unique(c, return_index=True)
        last = x[np.append(starts[1:], len(x)) - 1] + 1
        base = np.concatenate(([0], np.cumsum(last)))[:-1]
        above = x + 1 + np.repeat(base, np.diff(np.append(starts, len(x))))
        low, high = (float(log_p.min()), float(log_p.max())) if len(log_p) else (0.0, 0.0)
        book = np.linspace(low, high, 256).astype(np.float32)
        codes = np.round((log_p - low) / max(high - low, 1e-12) * 255).astype(np.uint8)
        head, body = [], []
        for seq in (contexts, np.append(starts, len(x)), above):
            n, bits, lo, hi = EliasFano.parts(seq)
            head += [n, bits, len(lo), len(hi)]
            body += [lo, hi]
        with open(path, "wb") as f:
            f.write(np.array(head + [0] * (16 - len(head)), np.int64).tobytes())
            for part in body:
                f.write(part.tobytes())
            f.write(book.tobytes() + codes.tobytes())

    def log_p(self, pairs: np.ndarray) -> np.ndarray:
        """Quantised log10 probability of each pair; NaN where the trie has no such pair."""
        out = np.full(len(pairs), np.nan)
        if not self.contexts.n or not len(pairs):
            return out
        c, x = pairs >> _X, pairs & ((1 << _X) - 1)
        k = self.contexts.successor(c)
        has = np.flatnonzero(k < self.contexts.n)
        has = has[self.contexts.get(k[has]) == c[has]]
        k, x = k[has], x[has]
        start, end = self.pointers.get(k), self.pointers.get(k + 1)
        base = np.where(start > 0, self.successors.get(np.maximum(start - 1, 0)), 0)
        at = self.successors.successor(base + x + 1)
        hit = (at >= start) & (at < end)
        hit[hit] = self.successors.get(at[hit]) == (base + x + 1)[hit]
        out[has[hit]] = self.book[self.codes[at[hit]]]
        return out


def shard_gains(parts: list[bytes], v: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part of a shard: places of texts in its pack, and what the shard's seen bigrams add to their log10 probabilities."""
    pairs, owns, flags = [], [], []
    for data in parts:
        p, o, t = _cut(data)
        pairs.append(np.cumsum(unzipped(p, np.int64)))
        owns.append(unzipped(o, np.uint32))
        flags.append(np.unpackbits(np.frombuffer(t, np.uint8))[: len(pairs[-1])])
    sizes = np.cumsum([len(p) for p in pairs])[:-1]
    pair, train = np.concatenate(pairs), np.concatenate(flags)
    del pairs, flags
    distinct, inverse = np.unique(pair, return_inverse=True)
    del pair
    seen = np.bincount(inverse, train, len(distinct))
    kept = seen > 0
    c, p = v.class_counts(), v.class_p()
    of, x = distinct >> _X, distinct & ((1 << _X) - 1)
    unseen = np.log10(MU * p[x] / (c[of] + MU))
    fd, path = tempfile.mkstemp(suffix=".trie")
    os.close(fd)
    try:
        Trie.write(path, distinct[kept], np.log10((seen[kept] + MU * p[x[kept]]) / (c[of[kept]] + MU)))
        found = Trie(path).log_p(distinct)
    finally:
        os.unlink(path)
    gain = np.where(np.isnan(found), 0.0, found - unseen)
    out = []
    for own, own_gain in zip(owns, np.split(gain[inverse], sizes), strict=True):
        places, at = np.unique(own, return_inverse=True)
        out.append((places, np.bincount(at, own_gain, len(places))))
    return out


def _gains(dealt: DataFrame, vocabulary) -> DataFrame:
    """(key, gain) of every text: sums leave the shards packed as the bigrams came, and meet again by pack."""

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["shard"]):
            kinds = t.column("kind").to_numpy()
            packs, data = t.column("pack").to_pylist(), t.column("data").to_pylist()
            at = np.flatnonzero(kinds == _BIGRAMS).tolist()
            out = [(packs[i], _KEYS, data[i]) for i in np.flatnonzero(kinds == _KEYS)]
            if at:
                sums = shard_gains([data[i] for i in at], vocabulary.value)
                out += [(packs[i], _SUMS, _sewn([zipped(np.diff(places, prepend=np.uint32(0))), zipped(g.astype(np.float32))])) for i, (places, g) in zip(at, sums, strict=True)]
            pack, kind, blob = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(pack, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["pack", "kind", "data"])

    def by_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["pack"]):
            names, total = None, None
            rows = sorted(zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True), key=lambda r: r[0])
            for kind, data in rows:
                if kind == _KEYS:
                    names = unzipped(data, np.int64)
                    total = np.zeros(len(names))
                else:
                    places, gains = _cut(data)
                    total[np.cumsum(unzipped(places, np.uint32), dtype=np.uint32)] += unzipped(gains, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["key", "gain"])

    sums = dealt.mapInArrow(by_shard, "pack long, kind int, data binary")
    return sums.repartition("pack").sortWithinPartitions("pack").mapInArrow(by_pack, "key long, gain double")


def _rare_gains(texts: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """(key, gain): what seen bigrams with a word outside the tries add to the log10 probability of every text.

    c(v,x) is counted over all training texts. No group is hot: of v and x one is rare, and a pair that training texts lack adds nothing.
    """
    pairs = texts.select("key", "held_out", F.explode("pairs").alias("p")).select("key", "held_out", "p.*")
    seen = pairs.where("not held_out").groupBy("v", "x").agg(F.count("*").alias("n"), F.max("c").alias("c"))
    among = seen.where("c is null").drop("c").join(words.select(F.col("h").alias("x"), "c"), "x").select("v", "x", "n", "c")
    counted = seen.where("c is not null").unionByName(among).select("v", "x", F.log10(1 + F.col("n") * total / (MU * (F.col("c") + 1))).alias("gain"))
    return pairs.groupBy("key", "v", "x").agg(F.count("*").alias("tf")).join(counted, ["v", "x"]).groupBy("key").agg(F.sum(F.col("tf") * F.col("gain")).alias("gain"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pooled: bool = True) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row; perplexity is 10 to the score's negative mean over tokens.

    pooled: words outside the tries share the bigrams of one class; else each has its own.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    words, v = count_words(docs, id_col, text_col)
    sent = spark.sparkContext.broadcast(v)  # 16 bytes for each of at most FREQUENT words
    texts = written(_texts(docs, sent, id_col, text_col, pooled), "texts")
    tokens = texts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // SHARD + 1)

    dealt = _pairs(docs, sent, shards, id_col, text_col, pooled).repartition(shards, "shard").sortWithinPartitions("shard")
    total, rare = float(v.tokens + v.distinct + 1), float(v.rare_tokens + v.rare_distinct + 1)
    gains = _gains(dealt, sent)
    if not pooled:
        gains = gains.unionByName(_rare_gains(texts, words, total))
    gains = gains.groupBy("key").agg(F.sum("gain").alias("gain"))
    spread = texts.select("key", F.explode("rare").alias("h")).groupBy("key", "h").agg(F.count("*").alias("tf"))
    c = F.coalesce("c", F.lit(0))
    # A rare word is a token once and a context once.
    rare_lm = F.log10((c + 1) / rare) if pooled else F.log10(MU * (c + 1) / total) - F.log10(c + MU)
    rares = (
        spread.join(words, "h", "left")
        .groupBy("key")
        .agg(
            F.sum(F.col("tf") * F.log10((c + 1) / total)).alias("rare_base"),
            F.sum(F.col("tf") * rare_lm).alias("rare_lm"),
            F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
        )
    )
    # Equal rows share a key: their sums came together and are dealt out again.
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))
    sums = copies.join(gains, "key", "left").join(rares, "key", "left")
    each = lambda name: F.coalesce(F.col(name), F.lit(0.0)) / F.col("copies")
    scored = texts.drop("rare", "pairs").join(sums, "key").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) / F.col("copies")).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + each("rare_base")).alias("base_score"),
        (F.col("lm") + each("rare_lm") + each("gain")).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
