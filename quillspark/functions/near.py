"""Near titles inside tasks: how far two titles may differ, the grams they meet on, and the pairs that may be near.

All of it is a filter that loses no pair: hashes that collide and signs that share a bit only let more pairs through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest gram, buckets of the table of counts, and covering rows that a part of one gram has, about.
LONGEST, BUCKETS, HOT = 6, 1 << 18, 8_192
#: Worked on at once, at most: titles, rows, their bytes, pairs, and numbers of a table of costs. Titles longer than LONG are cut evenly.
TITLES, ROWS, BYTES, PAIRS, COSTS, LONG = 2_048, 32_768, 1 << 23, 1 << 19, 1 << 21, 160
#: Odd numbers that mix the characters of a gram, its topic and its part.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Bounds:
    """What a ratio of at least `threshold` leaves room for between titles of a and b characters."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.most, self.grams, self.sizes = lru_cache(None)(self._most), lru_cache(None)(self._grams), lru_cache(None)(self._sizes)

    def edits(self, a, b):
        """Characters of both that no block holds, at most: (1 - t) (a + b), and as even or odd as the lengths' difference."""
        d = np.floor((1 - self.threshold) * (np.asarray(a) + b) + 1e-6).astype(np.int64)
        return d - ((d - np.abs(np.asarray(a) - b)) & 1)

    def others(self, a: int) -> np.ndarray:
        """Lengths that a title may have that is near one of a characters."""
        t = max(self.threshold, 0.05)
        b = np.arange(max(1, int(a * t / (2 - t)) - 1), int(a * (2 - t) / t) + 2)
        return b[np.abs(b - a) <= self.edits(a, b)]

    def _most(self, a: int) -> int:
        return int(max(self.edits(a, self.others(a)), default=0))

    def _grams(self, a: int) -> tuple[int, int]:
        """Number and size of the grams that a title of a characters is looked for by: one more than what edits can break, as they don't overlap."""
        k = self._most(a) + 1
        q = min(LONGEST, a // k)
        return (k, q) if q else (1, 0)

    def _sizes(self, b: int) -> frozenset[int]:
        """Sizes of the grams that a covering title of b characters is found by."""
        return frozenset(self.grams(int(a))[1] for a in self.others(b) if self.most(int(a)))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together, or cut, to tables of so many rows or bytes, about; the last may have fewer."""
    own: list[pa.RecordBatch] = []
    for b in batches:
        step = max(1, min(rows, len(b) * BYTES // max(1, b.nbytes)))
        for k in range(0, len(b), step):
            own.append(b.slice(k, step))
            if sum(map(len, own)) >= rows or sum(o.nbytes for o in own) >= BYTES:
                yield pa.Table.from_batches(own)
                own = []
    if own:
        yield pa.Table.from_batches(own)


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all titles one after the other, where each title begins, and how long it is."""
    n = np.fromiter(map(len, titles), np.int64, len(titles))
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.cumsum(n) - n, n


def _hashes(codes: np.ndarray, starts: np.ndarray, q: int, topic: np.ndarray) -> np.ndarray:
    h = topic + np.uint64(q)
    for k in range(q):
        h = (h ^ codes[starts + k]) * MIX[k]
        h ^= h >> np.uint64(29)
    return h


def _starts(first: np.ndarray, n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place where a gram of q characters begins: number of the title, place in it, place in all codes."""
    many = np.maximum(n - q + 1, 0) if q else np.ones(len(n), np.int64)
    row = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, at, first[row] + at


def bags(titles: list[str]) -> np.ndarray:
    """Four words for each title: eight bits for each of 32 kinds of signs, as many of them set as the title has of it.

    Bits in which two differ are at most the characters that one has and the other has not.
    """
    codes, _, n = _codes(titles)
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * 32 + (codes & np.uint64(31)).astype(np.int64), minlength=32 * len(n))
    return ((1 << np.minimum(counts, 8)) - 1).astype(np.uint8).reshape(-1, 32).view(np.uint64)


def common(masks: dict[str, int], a: int, other: str) -> int:
    """Length of the longest common subsequence of a title of a characters, as places of its characters, and another title."""
    v = (1 << a) - 1
    for c in other:
        u = v & masks.get(c, 0)
        v = (v + u) | (v - u)
    return a - (v & ((1 << a) - 1)).bit_count()


def places(title: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(title):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _covering(titles: pa.Table, bounds: Bounds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and hash of each gram that covering titles are found by."""
    rows = np.flatnonzero(titles["covering"].to_numpy())
    codes, first, n = _codes(titles["title"].take(pa.array(rows)).to_pylist())
    topic = titles["salt"].to_numpy()[rows].view(np.uint64)
    sizes = [bounds.sizes(int(x)) for x in n]
    for q in sorted(frozenset().union(*sizes)):
        own = np.flatnonzero([q in s for s in sizes])
        row, at, start = _starts(first[own], n[own], q)
        yield rows[own[row]], at, _hashes(codes, start, q, topic[own[row]])


def _rarest(often: np.ndarray, k: int, q: int) -> np.ndarray:
    """For titles of one length, given how often the gram at each place is: the k places, q apart at least, with the least sum."""
    count, m = often.shape
    if m > LONG:  # one of each of k even cuts
        edge = np.arange(k + 1) * (m + q - 1) // k
        return np.stack([edge[j] + np.argmin(often[:, edge[j] : edge[j + 1] - q + 1], 1) for j in range(k)], 1)
    if count > (most := max(1, COSTS // (k * m))):
        return np.concatenate([_rarest(often[c : c + most], k, q) for c in range(0, count, most)])
    cost = np.zeros((k + 1, m + q, count))  # [j, i]: j grams that end within the first i characters
    cost[1:] = np.inf
    for j in range(1, k + 1):
        for i in range(q, m + q):
            np.minimum(cost[j, i - 1], cost[j - 1, i - q] + often[:, i - q], out=cost[j, i])
    at, i, titles = np.zeros((count, k), np.int64), np.full(count, m + q - 1), np.arange(count)
    for j in range(k, 0, -1):
        for _ in range(m):
            left = (i > q) & (cost[j, np.maximum(i - 1, 0), titles] == cost[j, i, titles]) & np.isfinite(cost[j, np.maximum(i - 1, 0), titles])
            if not left.any():
                break
            i = i - left
        i = i - q
        at[:, j - 1] = i
    return at


def _items(titles: pa.Table, bounds: Bounds, often: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and hash of the grams that items' titles look for others by."""
    rows = np.flatnonzero(titles["wanted"].to_numpy())
    codes, first, n = _codes(titles["title"].take(pa.array(rows)).to_pylist())
    topic = titles["salt"].to_numpy()[rows].view(np.uint64)
    for a in np.unique(n):
        if not bounds.most(int(a)):
            continue  # only equal titles are near
        k, q = bounds.grams(int(a))
        own = np.flatnonzero(n == a)
        _, _, start = _starts(first[own], n[own], q)
        m = len(start) // len(own)
        h = _hashes(codes, start, q, np.repeat(topic[own], m)).reshape(len(own), m)
        at = _rarest(often[h & np.uint64(BUCKETS - 1)], k, q) if q else np.zeros((len(own), 1), np.int64)
        yield np.repeat(rows[own], k), at.ravel(), np.take_along_axis(h, at, 1).ravel()


def counter(threshold: float) -> Callable:
    """titles -> (slice, n): how often covering titles have grams of each bucket, in slices of the table; one row a slice and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, n = Bounds(threshold), np.zeros(BUCKETS, np.int64)
        for titles in gathered(batches, TITLES):
            for _, _, h in _covering(titles, bounds):
                n += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        if n.any():
            cut = n.reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["slice", "n"])

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of one number added up."""
    own: dict[int, np.ndarray] = {}
    for b in batches:
        for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own[s] = own.get(s, 0) + np.frombuffer(n, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([n.tobytes() for n in own.values()], pa.binary())], ["slice", "n"])


def cutter(threshold: float, often) -> Callable:
    """titles -> a row for each gram (gram, item, place, topic, title, covered_by); covering titles of a common gram are dealt to parts, items look in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(threshold)
        for titles in gathered(batches, TITLES):
            deal = titles["deal"].to_numpy().view(np.uint64)
            for item, found in ((False, _covering(titles, bounds)), (True, _items(titles, bounds, often.value))):
                for row, at, h in found:
                    parts = np.maximum(1, -(-often.value[h & np.uint64(BUCKETS - 1)] // HOT))
                    if item:
                        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                        row, at, h = (np.repeat(v, parts) for v in (row, at, h))
                    else:
                        part = (deal[row] % parts.astype(np.uint64)).astype(np.int64)
                    h = (h + part.astype(np.uint64)) * MIX[0]
                    own = titles.select(["topic", "title", "covered_by"])
                    step = max(1, min(ROWS, BYTES * len(own) // max(1, own.nbytes)))
                    for k in range(0, len(h), step):
                        c = slice(k, k + step)
                        columns = [pa.array(h[c].view(np.int64)), pa.array(np.full(len(h[c]), item)), pa.array(at[c], pa.int32())]
                        yield from pa.table([*columns, *own.take(pa.array(row[c])).columns], ["gram", "item", "place", *own.column_names]).combine_chunks().to_batches()

    return run


def meeting(threshold: float) -> Callable:
    """Rows of cutter(), by gram, covering ones first and by place -> (topic, id_title, covered_by_title, covered_by) of pairs that may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, held = Bounds(threshold), None
        for rows in gathered(batches, ROWS):
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            gram, item = rows["gram"].to_numpy(), rows["item"].to_numpy()
            held = rows.take(pa.array(np.flatnonzero((gram == gram[-1]) & ~item)))
            group = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
            both = (np.bincount(group, item) > 0) & (np.bincount(group, ~item) > 0)
            keep = np.flatnonzero(both[group])
            if len(keep):
                yield from _pairs(rows.take(pa.array(keep)).combine_chunks(), group[keep], item[keep], bounds)

    return run


def _pairs(rows: pa.Table, group: np.ndarray, item: np.ndarray, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    titles, topics, place = rows["title"].to_pylist(), rows["topic"], rows["place"].to_numpy().astype(np.int64)
    n, bag = np.fromiter(map(len, titles), np.int64, len(titles)), bags(titles)
    x, y = np.flatnonzero(item), np.flatnonzero(~item)
    most = np.array([bounds.most(int(a)) for a in n[x]])
    key = (group << 32) + place
    low = np.searchsorted(key[y], (group[x] << 32) + np.maximum(place[x] - most, 0))
    many = np.searchsorted(key[y], key[x] + most, "right") - low
    x, low, many = x[many > 0], low[many > 0], many[many > 0]
    step, masks = np.cumsum(many) // PAIRS, lru_cache(4096)(lambda i: places(titles[i]))
    for s in np.unique(step):
        c = step == s
        i = np.repeat(x[c], many[c])
        j = y[np.arange(len(i)) - np.repeat(np.cumsum(many[c]) - many[c], many[c]) + np.repeat(low[c], many[c])]
        d, shift = bounds.edits(n[i], n[j]), place[j] - place[i]
        ok = np.abs(shift) + np.abs(n[j] - n[i] - shift) <= d
        i, j, d = i[ok], j[ok], d[ok]
        ok = np.bitwise_count(bag[i] ^ bag[j]).sum(1, dtype=np.int64) <= d
        near = {(u, v) for u, v, e in zip(i[ok].tolist(), j[ok].tolist(), d[ok].tolist(), strict=True) if titles[u] != titles[v] and n[u] + n[v] - 2 * common(masks(u), len(titles[u]), titles[v]) <= e}
        if near:
            u, v = (pa.array(k) for k in zip(*near, strict=True))
            out = pa.table([topics.take(u), rows["title"].take(u), rows["title"].take(v), rows["covered_by"].take(v), topics.take(v)], ["topic", "id_title", "covered_by_title", "covered_by", "_other"])
            same = pc.equal(out["topic"], out["_other"])  # hashes of two topics may collide
            yield from out.filter(same).drop_columns(["_other"]).combine_chunks().to_batches()
