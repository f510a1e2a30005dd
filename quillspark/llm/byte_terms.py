"""Words of texts by a lookup table over their UTF-8 bytes, grouped by xxhash with a check of the bytes themselves.

A table of 256 entries says for every byte what it becomes in a word, or 0 where no word can have it. All bytes of
a character outside ASCII map to themselves, so a class of characters that takes or leaves those as a whole needs no
decoding. Word boundaries are where the mapped buffer goes from zero to not zero and back, or where a text ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def alphabet(digits: bool) -> np.ndarray:
    """The table of words made of letters and characters outside ASCII, with digits or without; A-Z become a-z."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    if digits:
        table[0x30:0x3A] = np.arange(0x30, 0x3A)
    return table


class Words:
    """Words of a column of texts in order: `code` numbers the distinct words, `row` is the text that a word stands in."""

    def __init__(self, texts: pa.Array, table: np.ndarray) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.rows = len(texts)
        self.bytes = table[raw]
        inside = np.concatenate(([False], self.bytes != 0, [False]))
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        before, after = inside[:-1], inside[1:]
        self.start = np.flatnonzero(after & (~before | cut))
        self.end = np.flatnonzero(before & (~after | cut))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self._group()

    def _group(self) -> None:
        """Equal hashes are one word if their bytes are equal too; words that only share a hash get numbers of their own."""
        view, digest = memoryview(self.bytes.tobytes()), xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(view[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)), np.uint64, len(self.start))
        _, first, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        self.first = first
        odd = np.flatnonzero(~self._same(np.arange(len(hashes)), first[self.code]))
        if len(odd):
            seen: dict[tuple[int, bytes], int] = {}
            more = []
            for i in odd.tolist():
                key = (int(hashes[i]), self.bytes[self.start[i] : self.end[i]].tobytes())
                if key not in seen:
                    seen[key] = len(first) + len(more)
                    more.append(i)
                self.code[i] = seen[key]
            self.first = np.concatenate((first, np.array(more, first.dtype)))

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b have the same bytes, some million bytes at a time."""
        size = self.end - self.start
        same = size[a] == size[b]
        todo = np.flatnonzero(same & (a != b))
        total = np.cumsum(size[a[todo]])
        at = 0
        while at < len(todo):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4_000_000, "right")))
            part = todo[at:to]
            n = size[a[part]]
            head = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(head, n)
            equal = self.bytes[np.repeat(self.start[a[part]], n) + step] == self.bytes[np.repeat(self.start[b[part]], n) + step]
            same[part] = np.logical_and.reduceat(equal, head)
            at = to
        return same

    def distinct(self) -> list[bytes]:
        """The distinct words, by their numbers."""
        a, b = self.start[self.first].tolist(), self.end[self.first].tolist()
        raw = self.bytes.tobytes()
        return [raw[i:j] for i, j in zip(a, b, strict=True)]
