"""Exact token counts at every prefix of a text, by dynamic programming.

For a word w of a BPE vocabulary let last(p) be the last token of the encoding
of prefix p without a word end, and count(p) its number of tokens. A token t
that ends p is last(p) exactly if the two tokens last(p without t), t encode to
themselves, so last and count of a prefix follow from those of shorter prefixes.
The count with a word end after p, which is what the library gives for a text that
stops there, follows from the same stored states. The prefixes of usual words that a task meets are kept, so words that
begin alike share the work; a longer word keeps two numbers for each place. Truncation and budget questions are lookups.

Edge cases: a null text counts as empty and has 0 tokens; white space alone has
none; words of any length and any number of special strings take memory in
proportion to the text; repeated rows are counted each; null ids are kept; an
empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import byte_of, split, tokenizer
from quillspark.llm.common import bound_batches, rowsum, slices

END = "</w>"
#: Prefixes and words a task keeps before it starts anew: bounds memory, not the result.
KEEP_PREFIXES = 300_000
KEEP_WORDS = 300_000
#: Words beyond this length are not kept.
KEEP_CHARS = 64
#: Unicode white space; Python's own class also holds four control characters that the library counts as symbols.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"([{_WHITE}]+)|[^{_WHITE}]+")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Segments of Latin letters, symbols and white space, which need no Unicode normalisation and hold no contraction or special token.
_PLAIN = re.compile(rf"[{_LETTERS}!#$%&()*+,./:;=?@^_`{{|}}~\[\]\" \t\n\r-]*")
_PLAIN_WORDS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS} \t\n\r]+")


class PrefixCounts:
    """Token counts of all prefixes of words under one vocabulary."""

    def __init__(self, path: str):
        import json

        self.t = tokenizer(path)
        spec = json.loads(self.t.to_str())
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.inner = {x for x in model["vocab"] if not x.endswith(END)}
        self.final = {x[: -len(END)] for x in model["vocab"] if x.endswith(END) and x != END}
        self.inner_sizes, self.final_sizes = self._sizes(self.inner), self._sizes(self.final)
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.shown = {b: c for c, b in byte_of().items()}
        self.latin = {i: "".join(self.shown[b] for b in chr(i).encode()) for i in range(128, 256)}
        self.known: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.ends: dict[str, int] = {}
        self.fit: dict[tuple[str, str, bool], bool] = {}

    @staticmethod
    def _sizes(tokens: set[str]) -> dict[str, list[int]]:
        """Lengths of the tokens that end in each three characters, longest first."""
        sizes: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) >= 3:
                sizes.setdefault(t[-3:], set()).add(len(t))
        return {k: sorted(v, reverse=True) for k, v in sizes.items()}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short sequence of symbols: the definition behind fits()."""
        symbols, rank = list(symbols), self.rank
        while len(symbols) > 1:
            best, at = 1 << 30, -1
            for i in range(len(symbols) - 1):
                r = rank.get((symbols[i], symbols[i + 1]))
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: str, right: str, ends: bool) -> bool:
        """Whether tokens left, right encode to themselves; ends: a word end follows right."""
        key = (left, right, ends)
        held = self.fit.get(key)
        if held is None:
            if len(self.fit) > KEEP_PREFIXES:
                self.fit.clear()
            tail = [*right[:-1], right[-1] + END] if ends else list(right)
            held = self.fit[key] = self.merged([*left, *tail]) == ([left] if left else []) + [right + END if ends else right]
        return held

    def _last(self, w: str, n: int, ends: bool, state) -> tuple[str, int]:
        """The last token of w[:n] and the number of tokens; state(m) gives the same for shorter prefixes."""
        tokens = self.final if ends else self.inner
        for k in (*(self.final_sizes if ends else self.inner_sizes).get(w[max(0, n - 3) : n], ()), 2, 1):
            if k <= n:
                piece = w[n - k : n]
                if piece in tokens:
                    last, count = state(n - k)
                    if self.fits(last, piece, ends):
                        return piece, count + 1
        raise ValueError(f"the vocabulary does not cover {w[max(0, n - 16) : n]!r}")

    def _reach(self, w: str) -> None:
        """Make last token and count of every prefix of w known, from the longest one that is."""
        known = self.known
        if len(known) > KEEP_PREFIXES:
            known.clear()
            self.ends.clear()
            known[""] = ("", 0)
        at = len(w)
        while w[:at] not in known:
            at -= 1
        for i in range(at + 1, len(w) + 1):
            known[w[:i]] = self._last(w, i, False, lambda m: known[w[:m]])

    def _long(self, w: str) -> list[tuple[str, int]]:
        """Last token and count of every prefix of a word that is not kept."""
        held = [("", 0)]
        for i in range(1, len(w)):
            held.append(self._last(w, i, False, held.__getitem__))
        return held

    def count(self, w: str) -> int:
        """Tokens of word w with its word end; w in the vocabulary's own characters."""
        if len(w) > KEEP_CHARS:
            return self._last(w, len(w), True, self._long(w).__getitem__)[1]
        n = self.ends.get(w)
        if n is None:
            self._reach(w[:-1])
            known = self.known
            n = self.ends[w] = self._last(w, len(w), True, lambda m: known[w[:m]])[1]
        return n

    def word(self, w: str) -> list[int]:
        """count() of every prefix of w, from the stored states of the shorter prefixes."""
        if len(w) > KEEP_CHARS:
            state = self._long(w).__getitem__
            return [self._last(w, i, True, state)[1] for i in range(1, len(w) + 1)]
        return [self.count(w[:i]) for i in range(1, len(w) + 1)]

    def split(self, segment: str) -> list[str]:
        """The words of a segment, normalised and in the vocabulary's characters."""
        if _PLAIN.fullmatch(segment):
            words = _PLAIN_WORDS.findall(segment.lower())
            return words if segment.isascii() else [w.translate(self.latin) for w in words]
        return [w for w, _ in self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(segment))]

    def segment(self, segment: str) -> int:
        """Tokens of a segment as the library counts them; strings of special tokens inside count one each."""
        if self.specials and "<|" in segment:
            parts = self.specials.split(segment)
            return sum(sum(map(self.count, self.split(x))) for x in parts[::2]) + len(parts) // 2
        return sum(map(self.count, self.split(segment)))

    def _ordinary(self, part: str) -> list[int]:
        """Counts of the prefixes of a segment in which no special string stands."""
        norm = self.t.normalizer.normalize_str
        each = {c: norm(c) for c in set(part)}
        whole = norm(part)
        words = self.t.pre_tokenizer.pre_tokenize_str(whole)
        ends = [end for _, (_, end) in words]
        if sum(len(each[c]) for c in part) != len(whole) or "".join(each[c] for c in part) != whole or [s for _, (s, _) in words] != [0, *ends][:-1] or ends[-1:] != [len(whole)]:
            # Characters combine: the prefixes have no common split.
            return [self.segment(part[:i]) for i in range(1, len(part) + 1)]
        at_norm: list[int] = []
        done = 0
        for w, (start, end) in words:
            text = whole[start:end]
            if text[0] == "'" and len(text) <= 3:  # a contraction, whose beginning is split in another way
                at_norm += [done + sum(map(self.count, self.split(text[:j]))) for j in range(1, len(text) + 1)]
            else:
                counts, size = self.word(w), 0
                for c in text:
                    size += len(c.encode())
                    at_norm.append(done + counts[size - 1])
            done = at_norm[-1]
        out, place = [], 0
        for c in part:
            place += len(each[c])
            out.append(at_norm[place - 1] if place else 0)
        return out

    def _prefixes(self, segment: str) -> list[int]:
        """segment() of every prefix of a segment."""
        out: list[int] = []
        done = 0
        parts = self.specials.split(segment) if self.specials and "<|" in segment else [segment]
        for before, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            if before:
                out += [done + n for n in self._ordinary(before)]
            if special:
                # Inside a special string its beginning still belongs to the symbols before it.
                k = next((i + 1 for i in range(len(before) - 1, -1, -1) if before[i].isascii() and before[i].isalnum()), 0)
                if k < len(before) and not before[k].isascii():
                    k = 0
                base = done + (self.segment(before[:k]) if k else 0)
                out += [base + self.segment(before[k:] + special[:j]) for j in range(1, len(special))]
                done = (out[-len(special)] if before else done) + 1
                out.append(done)
        return out

    def text(self, text: str) -> list[int]:
        """Token count of text[:i] for i from 0 to its length, without encoding any prefix.

        Whole segments add up; inside a word the stored states of its prefixes answer. Only where characters combine
        (accents apart from their letters), or in a contraction, the prefixes of the segment are split anew.
        """
        out, done = [0], 0
        for m in _RUNS.finditer(text):
            if m[1]:
                out += [done] * len(m[1])
            else:
                out += [done + n for n in self._prefixes(m[0])]
                done = out[-1]
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most budget tokens."""
        counts = np.asarray(self.text(text))
        return text[: int(np.flatnonzero(counts <= budget)[-1])]


def _mapped(docs: DataFrame, path: str, limit: int, id_col: str, text_col: str, cumulative: bool) -> DataFrame:
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PrefixCounts(path)
        known: dict[str, int] = {}
        for b in slices(batches, 2):
            codes, words, offsets = split(b.column(2))
            if len(known) > KEEP_WORDS:
                known.clear()
            each = np.empty(len(words), np.int64)
            for i, w in enumerate(words.to_pylist()):
                w = w[1:] if w[:1] in (" ", "\n") else w
                n = known.get(w)
                if n is None:
                    n = counts.segment(w)
                    if len(w) <= KEEP_CHARS:
                        known[w] = n
                each[i] = n
            at, chars = each[codes], np.asarray(pc.utf8_length(words), np.int64)[codes]
            tokens, fit = rowsum(at, offsets), rowsum(chars, offsets)
            total, passed = np.cumsum(at), np.cumsum(chars)
            base = (total - at)[np.minimum(offsets[:-1], len(at) - 1)] if len(at) else np.zeros(len(b), np.int64)
            for r in np.flatnonzero(tokens > limit).tolist():
                first = offsets[r]
                i = first + bisect_right(total[first : offsets[r + 1]], base[r] + limit)
                left = limit - (total[i] - at[i] - base[r])
                within = counts.text(words[codes[i]].as_py())
                fit[r] = passed[i] - passed[first] + chars[first] - chars[i] + max(k for k, n in enumerate(within) if n <= left)
            out = [b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(fit, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "fit_chars"]
            if cumulative:
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(total - np.repeat(base, np.diff(offsets)), pa.int64())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(docs.select(id_col).dtypes)[id_col]
    more = ", prefix_tokens array<long>" if cumulative else ""
    shaped = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), text_col)
    return shaped.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, fit_chars long{more}")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars) for every row; fit_chars: code points of the longest prefix of at most `limit` tokens."""
    return _mapped(docs, path, limit, id_col, text_col, False).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, fit_chars, prefix_tokens): the count up to the end of every word, for truncation and packing in SQL."""
    return _mapped(docs, path, limit, id_col, text_col, True)
