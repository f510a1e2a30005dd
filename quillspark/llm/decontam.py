"""Benchmark decontamination by latent semantic retrieval.

Texts and benchmark items are cut into overlapping passages of WINDOW words.
Passages are TF-IDF vectors over hashed terms, with document frequencies from
all texts, in which words inside a copy of a benchmark passage (runs of RUN words
that an item has too) do not count, so that leaks never make an item's own words
common; a randomised SVD, whose products with the passage matrix run in the
tasks, gives RANK latent dimensions. It is fitted on all texts, cut into passages that follow each other so that
every word counts once, and with equal weight on all passages of the benchmark, and applied to every
passage that can pass. Passages of a text whose cosine with an item's passage is at least
COSINE (less for items shorter than a window) are candidates; a candidate counts if the longest common subsequence of
content words holds most of the item, or half of it with the item's answer (its
last sentence) in the text. The subsequence is looked for in a region around the
passage, and is no longer than the number of the item's words there; passages in
whose region that number stays below half of the item cannot pass and are not
projected. This bound is exact: it loses no candidate that would count.

Content words are judged by exact word, for the words of the benchmark alone.

The benchmark is taken in blocks of at most about ITEMS items and ITEM_BYTES bytes, each with statistics of its own,
so what the driver and the tasks hold is bounded however long it is. Ids of items keep their type; items without id or text are left out. Edge cases: null and empty texts and items match
nothing; an item of fewer than CONTENT content words must occur word by word, is
searched for by its rarest word instead of by cosine, and has cosine and common 1;
texts are read whole, by slices of bounded size; equal texts and equal items match alike, each with a row; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.common import bound_batches, coded, drop, hash_words, mix, owner, slices, split_words, unzipped, written, zipped

TERMS, RANK, OVERSAMPLE = 1 << 15, 48, 8
WINDOW, STRIDE = 32, 8
#: Items of one block, and their bytes.
ITEMS, ITEM_BYTES = 2_000, 8_000_000
#: Passages of one product, and parts in which the products of all tasks meet.
BLOCK, PARTS = 8192, 8
COSINE = 0.3
#: Shares of an item's content words in order that count alone, and together with its answer.
ALONE, WITH_ANSWER = 0.7, 0.5
#: Content words: words in less than this share of the texts; an item needs so many of them.
COMMON, CONTENT = 0.02, 5
#: Words in a row that make a copy of a benchmark passage.
RUN = 3


def _bare(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes, distinct words without case and outer punctuation, and offsets."""
    flat, offsets = split_words(text)
    codes, raw = coded(flat)
    return codes, pc.utf8_lower(pc.utf8_trim(raw, '.,;:!?"()[]{}*#$%&|<>\'')), offsets


def _terms(words: pa.Array) -> np.ndarray:
    return (hash_words(words) >> np.uint64(49)).astype(np.int64)


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the passages of every text; a shorter text is one passage."""
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + np.minimum(k * STRIDE, np.maximum(size[row] - WINDOW, 0))
    return start, np.minimum(start + WINDOW, offsets[row + 1])


@dataclass(frozen=True)
class Statistics:
    texts: int
    frequency: np.ndarray  # texts with each term
    vocabulary: np.ndarray  # hashes of the benchmark's words, ascending
    exact: np.ndarray  # texts with each of these words

    @property
    def idf(self) -> np.ndarray:
        return np.log((self.texts + 1.0) / (self.frequency + 1.0)).astype(np.float32) + np.float32(0.1)

    @property
    def content(self) -> np.ndarray:
        return self.exact < max(2.0, COMMON * self.texts)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the vocabulary of each hash, and whether it is there."""
        return _find(self.vocabulary, h)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def _runs(h: np.ndarray) -> np.ndarray:
    """A hash of each RUN neighbouring words."""
    n = max(0, len(h) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for k in range(RUN):
        out = mix(out + h[k : k + n].view(np.uint64))
    return out


def _copied(h: np.ndarray, codes: np.ndarray, known: np.ndarray, offsets: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Words inside a run that the benchmark has too; only runs of known words are looked up."""
    out = np.zeros(len(codes), bool)
    n = len(codes) - RUN + 1
    if n <= 0 or not len(runs):
        return out
    held = known[codes]
    start = held[:n].copy()
    for k in range(1, RUN):
        start &= held[k : k + n]
    at = np.flatnonzero(start)
    end = offsets[np.searchsorted(offsets, at, side="right")]
    at = at[at + RUN <= end]
    key = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        key = mix(key + h[codes[at + k]].view(np.uint64))
    at = at[_find(runs, key)[1]]
    for k in range(RUN):
        out[at + k] = True
    return out


def _sequences(text: pa.Array) -> list[np.ndarray]:
    """Term sequences of the passages of all texts."""
    codes, words, offsets = _bare(text)
    t = _terms(words)[codes] if len(codes) else np.zeros(0, np.int64)
    return [t[a:b] for a, b in zip(*_windows(offsets), strict=True)]


def _packed(t: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Terms of all texts as rows of WINDOW, one passage each, ascending; the last passage of a text is filled up with TERMS."""
    size = np.diff(offsets)
    rows = -(-size // WINDOW)
    first = np.cumsum(rows) - rows
    out = np.full(int(rows.sum()) * WINDOW, TERMS, np.uint16)
    out[np.arange(len(t)) - np.repeat(offsets[:-1] - first * WINDOW, size)] = t
    out = out.reshape(-1, WINDOW)
    out.sort(axis=1)
    return out


def statistics(docs: DataFrame, text_col: str, items: list[str]) -> tuple[Statistics, DataFrame]:
    """Document frequencies of all texts outside copies of the items, and the terms of all passages (data, n), in one pass."""
    ic, iw, io = _bare(pa.array(items, pa.string()))
    ih = hash_words(iw).view(np.int64)
    vocabulary = np.unique(ih)
    runs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_runs(ih[ic[a:z]]) for a, z in zip(io[:-1], io[1:], strict=True))]))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, runs = sent.value
        size = len(vocabulary)
        df, n = np.zeros(TERMS + size, np.int64), 0
        for b in slices(batches, 0):
            codes, words, offsets = _bare(b.column(0))
            n += len(b)
            if not len(codes):
                continue
            h = hash_words(words)
            place, known = _find(vocabulary, h.view(np.int64))
            t = (h >> np.uint64(49)).astype(np.int64)[codes]
            counted = ~_copied(h, codes, known, offsets, runs)
            row = owner(offsets)
            seen = np.asarray(pc.unique(pa.array((row * TERMS + t)[counted])))
            df[:TERMS] += np.bincount(seen % TERMS, minlength=TERMS)
            counted &= known[codes]
            seen = np.asarray(pc.unique(pa.array(row[counted] * size + place[codes[counted]])))
            if len(seen):
                df[TERMS:] += np.bincount(seen % size, minlength=size)
            passages = _packed(t, offsets)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([zipped(passages.reshape(-1))], pa.binary()), pa.array([len(passages)], pa.int64())], ["kind", "data", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([zipped(df)], pa.binary()), pa.array([n], pa.int64())], ["kind", "data", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + len(vocabulary), np.int64), 0
        for b in batches:
            for data, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df, n = df + unzipped(data, np.int64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([zipped(df)], pa.binary()), pa.array([n], pa.int64())], ["data", "n"])

    rows = written(docs.select(text_col).mapInArrow(run, "kind int, data binary, n long"), "passages")
    # Eight partial sums of counters for terms and words of the block reach the driver, however many tasks there were.
    parts = rows.where("kind = 1").select("data", "n").repartition(8).mapInArrow(add, "data binary, n long").collect()
    df = sum((unzipped(r.data, np.int64) for r in parts), np.zeros(TERMS + len(vocabulary), np.int64))
    return Statistics(sum(r.n for r in parts), df[:TERMS], vocabulary, df[TERMS:]), rows.where("kind = 0").select("data", "n")


def _gram(sequences: list[np.ndarray], basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T A basis for the rows A of unit TF-IDF vectors."""
    out = np.zeros_like(basis, dtype=np.float64)
    for i in range(0, len(sequences), 500):
        part = [s for s in sequences[i : i + 500] if len(s)]
        if not part:
            continue
        row, t = np.repeat(np.arange(len(part)), [len(s) for s in part]), np.concatenate(part)
        w = idf[t]
        key, inv = np.unique(row * TERMS + t, return_inverse=True)
        v = np.bincount(inv, w)
        row, t = key // TERMS, key % TERMS
        v = v / np.sqrt(np.bincount(row, v**2, len(part)))[row]
        # Keys are sorted by row; for the second product they are sorted by term.
        starts = np.searchsorted(row, np.arange(len(part)))
        y = np.add.reduceat(v[:, None] * basis[t], starts, axis=0)
        order = np.argsort(t, kind="stable")
        used, first = np.unique(t[order], return_index=True)
        out[used] += np.add.reduceat((v[:, None] * y[row])[order], first, axis=0)
    return out


def _gram_packed(terms: np.ndarray, basis: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """Adds (A^T A basis)^T for the unit TF-IDF vectors A of packed passages. basis and idf have a last row of zeros, for what fills passages up."""
    for i in range(0, len(terms), BLOCK):
        t = terms[i : i + BLOCK]
        flat = t.reshape(-1)
        new = np.ones(t.shape, bool)
        new[:, 1:] = t[:, 1:] != t[:, :-1]
        run = np.flatnonzero(new.reshape(-1))
        v = idf[flat[run]] * np.diff(np.append(run, len(flat)))
        norm = np.sqrt(np.bincount(run // WINDOW, v * v, len(t)))
        y = np.zeros((len(t), basis.shape[1]), np.float32)
        for k in range(WINDOW):
            y += basis[t[:, k]]
        y /= (norm**2)[:, None]
        at = flat.astype(np.int64)
        for k, column in enumerate(y.T.astype(np.float64)):
            out[k] += np.bincount(at, np.repeat(column, WINDOW), len(idf))


def _product(passages: DataFrame, q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T A q over all passages of the corpus: the tasks' products meet in PARTS parts, so the driver gets one matrix however many tasks there are."""
    weights = np.append(idf, np.float32(0))
    weighed = np.vstack((q * idf[:, None], np.zeros((1, q.shape[1])))).astype(np.float32)
    sent = passages.sparkSession.sparkContext.broadcast((weighed, weights))
    size = TERMS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, weights = sent.value
        total = np.zeros(basis.T.shape)
        for b in batches:
            for data in b.column(0):
                _gram_packed(unzipped(data.as_py(), np.uint16).reshape(-1, WINDOW), basis, weights, total)
        total = (total.T[:-1] * weights[:-1, None]).astype(np.float32)
        for k in range(PARTS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * size : (k + 1) * size].tobytes()], pa.binary())], ["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(data.as_py(), np.float32).astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["part", "data"])

    out = np.zeros(q.shape)
    met = passages.select("data").mapInArrow(run, "part int, data binary").repartition(PARTS, "part").mapInArrow(add, "part int, data binary")
    for r in met.toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.data, np.float32).reshape(size, -1)
    sent.destroy()
    return out


def latent_basis(passages: DataFrame, items: list[np.ndarray], stats: Statistics, rounds: int = 2) -> np.ndarray:
    """TERMS x RANK: what a word adds to its passage's latent vector."""
    rng = np.random.default_rng(7)
    n = passages.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # The benchmark's passages weigh as much together as the corpus's, else the basis would describe common words alone.
    weight = max(1.0, n / max(1, len(items)))
    q, idf = np.linalg.qr(rng.standard_normal((TERMS, RANK + OVERSAMPLE)))[0], stats.idf
    # The benchmark's own directions are where the rounds begin; each takes in the whole corpus.
    z = _gram(items, q, idf)
    q = np.linalg.qr(z / max(1e-9, np.abs(z).max()) + 0.01 * q)[0]
    for _ in range(rounds):
        z = weight * _gram(items, q, idf) + _product(passages, q, idf)
        small = q.T @ z
        q, last = np.linalg.qr(z)[0], (q, small)
    q, small = last
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:RANK]
    # A small table has fewer directions than RANK: what is left is rounding, which the division would enlarge.
    real = values[top] > 1e-6 * values[top[0]]
    sigma = np.sqrt(np.maximum(values[top], 1e-9))
    return ((q @ vectors[:, top]) * (real / np.sqrt(sigma + 1e-6)) * idf[:, None]).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, 64 places and more at a time."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & place.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Items:
    """A block of items; words are given by their places in `vocabulary`."""

    ids: list
    vocabulary: pa.Array
    words: list[list[int]]
    answers: list[list[int]]
    plain: list[int]  # items of fewer than CONTENT content words, whose words are all their words
    rarest: list[int]  # place in each of these of its rarest word
    users: np.ndarray  # items that each content word stands in, end to end,
    used: np.ndarray  # and where each word's items begin there
    need: np.ndarray  # least length of a subsequence that counts, by item
    reach: np.ndarray  # words looked at on either side of a passage, by item
    vectors: np.ndarray  # passages in latent space, by item,
    first: np.ndarray  # where each item's passages begin,
    cosine: np.ndarray  # and the least cosine for each: lower for a passage that fills only part of a window


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers lo[i] .. lo[i] + n[i] - 1 of all i, and i for each."""
    i = np.repeat(np.arange(len(n)), n)
    return lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), i


def prepare(ids: list, texts: list[str], basis: np.ndarray, stats: Statistics) -> Items:
    """What the tasks need of a block of items."""
    codes, words, offsets = _bare(pa.array(texts, pa.string()))
    t = _terms(words)
    place = stats.places(hash_words(words).view(np.int64))[0]  # the items' words are the vocabulary
    at = np.zeros(len(stats.vocabulary), np.int64)
    at[place] = np.arange(len(place))
    content = stats.content
    own, answers, plain, rarest = [], [], [], []
    for i, text in enumerate(texts):
        c = place[codes[offsets[i] : offsets[i + 1]]]
        few = content[c].sum() < CONTENT
        own.append([int(x) for x in (c if few else c[content[c]])])
        if few and len(c):
            plain.append(i)
            rarest.append(int(np.argmin(stats.exact[c])))
        last = [s for s in text.replace("\n", ". ").split(". ") if s.strip()]
        _, aw, _ = _bare(pa.array(last[-1:] or [""], pa.string()))
        held, known = stats.places(hash_words(aw).view(np.int64))
        held = held[known]
        answers.append([int(x) for x in held[content[held]]])
    size = np.array([len(w) for w in own], np.int64)
    searched = np.ones(len(texts), bool)
    searched[plain] = False
    searched &= size > 0
    pairs = np.unique(np.array([(x, k) for k, w in enumerate(own) if searched[k] for x in w], np.int64).reshape(-1, 2), axis=0)
    start, end = _windows(offsets)
    sums = np.concatenate((np.zeros((1, RANK)), np.cumsum(basis[t[codes]].astype(np.float64), axis=0))) if len(codes) else np.zeros((1, RANK))
    of = np.searchsorted(offsets, start, side="right") - 1
    return Items(
        ids,
        words.take(pa.array(at)),
        own,
        answers,
        plain,
        rarest,
        pairs[:, 1],
        np.searchsorted(pairs[:, 0], np.arange(len(at) + 1)),
        np.maximum(1, np.ceil(WITH_ANSWER * size - 1e-9)).astype(np.int64),
        2 * size + WINDOW,
        _unit(sums[end] - sums[start]).astype(np.float32),
        np.searchsorted(of, np.arange(len(texts) + 1)),
        (COSINE * np.sqrt(np.minimum(1.0, (end - start) / WINDOW))).astype(np.float32),
    )


def _whole(items: Items, place: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """Rows for the texts that hold a plain item word by word: place by distinct word, codes and offsets of the texts."""
    out: list[tuple] = []
    anchors = np.array([items.words[k][i] for k, i in zip(items.plain, items.rarest, strict=True)], np.int64)
    if not np.isin(anchors, place).any():
        return out
    # Positions of the anchor words alone, in the order of the words.
    at = np.flatnonzero(np.isin(place, anchors)[codes])
    at = at[np.argsort(place[codes[at]], kind="stable")]
    low, high = np.searchsorted(place[codes[at]], anchors), np.searchsorted(place[codes[at]], anchors, side="right")
    for k, i, a, z in zip(items.plain, items.rarest, low, high, strict=True):
        item = items.words[k]
        first = at[a:z] - i
        first = first[(first >= 0) & (first + len(item) <= len(codes))]
        for j, x in enumerate(item):
            if not len(first):
                break
            first = first[place[codes[first + j]] == x]
        row = np.searchsorted(offsets, first, side="right") - 1
        inside = first + len(item) <= offsets[row + 1]
        out += [(r, k, 1.0, 1.0, bool(items.answers[k])) for r in np.unique(row[inside]).tolist()]
    return out


def _possible(items: Items, place: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, start of a passage) of all passages whose region holds enough of the item's words."""
    none = np.zeros(0, np.int64)
    size = np.diff(items.used)
    users = np.where(place >= 0, size[place], 0) if len(size) else np.zeros(len(place), np.int64)
    pos = np.flatnonzero((users > 0)[codes])
    if not len(pos):
        return none, none, none
    word = place[codes[pos]]
    at, i = _ranges(items.used[word], size[word])
    item, pos = items.users[at], pos[i]
    row = np.searchsorted(offsets, pos, side="right") - 1
    key = row * len(items.need) + item
    order = np.argsort(key, kind="stable")
    key, pos, item, row = key[order], pos[order], item[order], row[order]
    far = np.arange(len(key)) + items.need[item] - 1
    good = far < len(key)
    good[good] = key[far[good]] == key[good]
    reach = items.reach[item]
    good[good] = pos[far[good]] - pos[good] < 2 * reach[good] + WINDOW
    lo, hi, reach, row, key = pos[good], pos[far[good]], reach[good], row[good], key[good]
    # Passages begin every STRIDE words, the last one where it just fits; of those, the ones with lo .. hi in their region.
    room = np.maximum(offsets[row + 1] - offsets[row] - WINDOW, 0)
    most = -(-room // STRIDE)
    k0 = np.clip(-(-(hi - reach - WINDOW + 1 - offsets[row]) // STRIDE), 0, most)
    k1 = np.clip((lo + reach - offsets[row]) // STRIDE, 0, most)
    k1 = np.where(lo + reach - offsets[row] >= room, most, k1)
    k, i = _ranges(k0, np.maximum(k1 - k0 + 1, 0))
    start = offsets[row[i]] + np.minimum(k * STRIDE, room[i])
    both = np.unique(key[i] * (len(codes) + 1) + start)
    key, start = both // (len(codes) + 1), both % (len(codes) + 1)
    return key // len(items.need), key % len(items.need), start


def _vectors(basis: np.ndarray, words: pa.Array, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Latent unit vectors of passages."""
    out = np.zeros((len(start), RANK), np.float32)
    distinct, inverse = np.unique(np.concatenate([codes[a:z] for a, z in zip(start, end, strict=True)]), return_inverse=True)
    rows = basis[_terms(words.take(pa.array(distinct)))]
    cuts = np.concatenate(([0], np.cumsum(end - start)))
    for i in range(0, len(start), 2048):
        part = cuts[i : i + 2049]
        out[i : i + 2048] = np.add.reduceat(rows[inverse[part[0] : part[-1]]], part[:-1] - part[0], axis=0)
    return _unit(out)


def _found(items: Items, basis: np.ndarray, text: pa.Array) -> list[tuple]:
    """(row, item, cosine, common, answered) of a batch of texts."""
    codes, words, offsets = _bare(text)
    if not len(codes):
        return []
    place = np.asarray(pc.fill_null(pc.index_in(words, value_set=items.vocabulary), -1), np.int64)
    out = _whole(items, place, codes, offsets)
    row, item, start = _possible(items, place, codes, offsets)
    if not len(row):
        return out
    passages, where = np.unique(start, return_inverse=True)
    ends = np.minimum(passages + WINDOW, offsets[np.searchsorted(offsets, passages, side="right")])
    vec = _vectors(basis, words, codes, passages, ends)
    best: dict[tuple[int, int], list] = {}
    for a in range(0, len(row), 8192):
        part = slice(a, a + 8192)
        p, i = _ranges(items.first[item[part]], items.first[item[part] + 1] - items.first[item[part]])
        i += a
        cos = np.einsum("ij,ij->i", vec[where[i]], items.vectors[p])
        kept = cos >= items.cosine[p]
        for r, o, c, w in zip(row[i[kept]].tolist(), item[i[kept]].tolist(), cos[kept].tolist(), where[i[kept]].tolist(), strict=True):
            got = best.setdefault((r, o), [0.0, []])
            got[0] = max(got[0], c)
            got[1].append(w)
    usable = np.zeros(len(items.vocabulary) + 1, bool)
    usable[:-1] = np.diff(items.used) > 0
    for (r, k), (cos, at) in best.items():
        own, answer, reach = items.words[k], items.answers[k], int(items.reach[k])
        mine = np.zeros(len(items.vocabulary) + 1, bool)
        mine[own] = mine[answer] = True
        common, answered, done = 0.0, False, -1
        for w in sorted(set(at)):
            low, high = max(offsets[r], passages[w] - reach), min(offsets[r + 1], ends[w] + reach)
            near = place[codes[low:high]]
            held = np.flatnonzero(mine[near])
            if len(held) < items.need[k] or low + held[-1] == done:
                continue  # regions begin and end later and later: this one's words were all in the last one
            done = low + held[-1]
            near = near[held].tolist()
            common = max(common, lcs(own, near) / len(own))
            if answer:
                answered |= lcs(answer, near) >= 0.8 * len(answer)
        if common >= ALONE or common >= WITH_ANSWER and answered:
            out.append((r, k, cos, common, answered))
    return out


def matches(docs: DataFrame, items: Items, basis: np.ndarray, id_col: str, text_col: str, item_kind: str) -> DataFrame:
    """(id, item, cosine, common, answered) of the candidates that pass, one row for each text and item."""
    spark = docs.sparkSession
    bound_batches(spark, rows=512)
    sent = spark.sparkContext.broadcast((items, basis))
    own = docs.select(id_col)
    kind = dict(own.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, item_id {item_kind}, cosine double, common double, answered boolean"
    id_type = to_arrow_type(spark.createDataFrame([], schema).schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, e = sent.value
        names = pa.array(it.ids, id_type)
        for b in slices(batches, 1):
            out = _found(it, e, b.column(1))
            if out:
                r, k, cos, common, answered = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r, pa.int64())), names.take(pa.array(k, pa.int64())), pa.array(cos, pa.float64()), pa.array(common, pa.float64()), pa.array(answered, pa.bool_())],
                    [id_col, "item_id", "cosine", "common", "answered"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, cosine, common, answered) for every text and benchmark item found in it; clean texts have no row."""
    spark = docs.sparkSession
    bound_batches(spark, rows=512)
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("text is not null and id is not null")
    item_kind = dict(rows.dtypes)["id"]
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    out = None
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        ids, texts = [r.id for r in block], [r.text for r in block]
        stats, passages = statistics(docs, text_col, texts)
        if not len(stats.vocabulary):
            continue
        basis = latent_basis(passages, _sequences(pa.array(texts, pa.string())), stats)
        drop(passages)
        found = matches(docs, prepare(ids, texts, basis, stats), basis, id_col, text_col, item_kind)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.select(id_col, *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", item_kind), ("cosine", "double"), ("common", "double"), ("answered", "boolean"))]).limit(0)
    return out
