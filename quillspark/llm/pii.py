"""Personal data by weak supervision.

Fixed patterns find emails, addresses of machines, payment cards and telephone
numbers. Beyond them, every token that could be a credential or identifier is a
candidate span on which labelers vote or abstain: patterns, a gazetteer of key
names and of harmless vocabulary, and the context before the token.
Expectation-maximisation estimates the labelers' reliabilities from the counts
of vote patterns, and its posteriors train a logistic classifier on the span's
shape, which decides. Spans of the fixed patterns always stay.

Offsets are code points, ends exclusive. Edge cases: a null text counts as
empty and has no spans; texts are searched whole; an empty table gives an empty
table and untrained labelers; equal texts get equal spans; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches
from quillspark.llm.weak import ABSTAIN, AGAINST, FOR, estimate

KINDS = ("email", "ip", "card", "phone")
#: Spans that the classifier adds.
EXTRA = "secret"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{8,}+(?![A-Za-z0-9_/+-])")
#: Gazetteer of names that announce a credential or identifier.
KEY_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "ssn", "iban", "account", "passport")
_KEYED = re.compile(r"(?i)(?:" + "|".join(KEY_NAMES) + r")[\"']?\s{0,2}[=:]\s{0,2}[\"']?$")
#: Gazetteer of vocabulary that carries digits without being about a person.
HARMLESS = re.compile(r"(?i)^(?:v?[0-9]+(?:[-/][0-9]+)*|(?:19|20)[0-9]{2}[-/][0-9]{2,4}|cc-by.*|gpl.*|sha-?[0-9]+|utf-?[0-9]+|iso-?[0-9-]+|[a-z]+-?[0-9]{1,4})$")
LABELERS = ("hex", "access_key", "mixed", "context", "harmless", "plain", "entropy", "quoted")
FEATURES = 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards, so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the fixed patterns, by kind."""
    emails = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
    cards = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, ...], tuple[int, ...]]]:
    """(start, end, votes, features) of tokens outside the taken spans that hold a digit or follow a key name."""
    if not (_DIGIT.search(text) or "=" in text or ":" in text):
        return
    taken = sorted(taken)
    starts = [s for s, _ in taken]
    from bisect import bisect_left

    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        token = m[0]
        has_digit = _DIGIT.search(token) is not None
        before = text[max(0, s - 24) : s]
        keyed = bool(before) and before[-1] in "=:\"' " and _KEYED.search(before) is not None
        if not (has_digit or keyed):
            continue
        k = bisect_left(starts, e)
        if k and taken[k - 1][1] > s:
            continue
        lower, upper, digits = sum(c.islower() for c in token), sum(c.isupper() for c in token), sum(c.isdigit() for c in token)
        n, h = len(token), _entropy(token)
        hexa = n >= 16 and all(c in "0123456789abcdefABCDEF" for c in token)
        quoted = s > 0 and text[s - 1] in "\"'" and text[e : e + 1] == text[s - 1]
        harmless = HARMLESS.match(token) is not None
        votes = (
            FOR if hexa and lower + upper > 0 else ABSTAIN,
            FOR if n >= 16 and upper and digits and not lower else ABSTAIN,
            FOR if digits >= 2 and lower + upper >= 4 and n >= 12 else AGAINST if digits == n else ABSTAIN,
            FOR if keyed else ABSTAIN,
            AGAINST if harmless else ABSTAIN,
            AGAINST if not has_digit and lower + upper == n and not keyed else ABSTAIN,
            FOR if h >= 3.2 and n >= 14 else AGAINST if h < 2.4 or n < 10 else ABSTAIN,
            FOR if quoted and n >= 12 else ABSTAIN,
        )
        shape = (min(n // 8, 4), min(int(h), 4), 4 * digits // n, int(hexa), int(upper > 0), int(lower > 0), int(keyed), int(quoted), int(harmless))
        yield s, e, votes, shape


def _design(shape: np.ndarray) -> np.ndarray:
    """Features of the classifier: an intercept, the shape's counts scaled to 1, and two products."""
    x = shape / np.array([4, 4, 4, 1, 1, 1, 1, 1, 1])
    return np.column_stack([np.ones(len(x)), x, x[:, 0] * x[:, 1], x[:, 2] * (1 - x[:, 2])]) if len(x) else np.zeros((0, FEATURES))


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]

    def accepts(self, shape: tuple[int, ...]) -> bool:
        return float(_design(np.array([shape], dtype=float))[0] @ np.array(self.weights)) >= 0


def train(docs: DataFrame, text_col: str = "text", prior: float = 0.3) -> Classifier:
    """Reliabilities and classifier from all texts; the driver gets counts of (votes, shape) patterns, whose number the two codes bound."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    for _, _, v, shape in candidates(text, [s for kind in base_spans(text) for s in kind]):
                        found[(v, shape)] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bytes(v) for v, _ in keys], pa.binary()), pa.array([bytes(s) for _, s in keys], pa.binary()), pa.array([found[k] for k in keys], pa.int64())],
            ["votes", "shape", "n"],
        )

    rows = docs.select(text_col).mapInArrow(run, "votes binary, shape binary, n long").groupBy("votes", "shape").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: (bytes(r.votes), bytes(r.shape)))
    votes = np.array([list(r.votes) for r in rows], dtype=np.int64).reshape(-1, len(LABELERS))
    shape = np.array([list(r.shape) for r in rows], dtype=float).reshape(-1, 9)
    n = np.array([r.n for r in rows], dtype=float)
    target = estimate(votes, n, prior).posterior(votes) if len(rows) else np.zeros(0)
    x, w = _design(shape), np.zeros(FEATURES)
    w[0] = -1.0
    share = np.log1p(n) / max(np.log1p(n).sum(), 1)  # common shapes do not drown the rare ones
    for _ in range(40):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - target)) + 1e-3 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(FEATURES)
        w = w - np.linalg.solve(hess, grad)
    return Classifier(tuple(float(v) for v in w))


def _written(kinds: list[tuple[str, list[tuple[int, int]]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, spans in kinds for s, e in spans)


def _found(text: str, classifier: Classifier, known: dict) -> list[tuple[str, list[tuple[int, int]]]]:
    base = base_spans(text)
    more = []
    for s, e, _, shape in candidates(text, [s for kind in base for s in kind]):
        if shape not in known:
            known[shape] = classifier.accepts(shape)
        if known[shape]:
            more.append((s, e))
    return [*zip(KINDS, base, strict=True), (EXTRA, more)]


def masked(text: str, spans: list[tuple[str, list[tuple[int, int]]]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first names the place and the union goes."""
    done, parts = 0, []
    for s, e, k in sorted((s, e, k) for k, own in spans for s, e in own):
        if s >= done:
            parts += [text[done:s], f"<{k.upper()}>"]
        done = max(done, e)
    return "".join([*parts, text[done:]])


def find(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) for every row."""
    bound_batches(docs.sparkSession)

    def one(text: str, known: dict) -> tuple:
        spans = _found(text, classifier, known)
        base = spans[: len(KINDS)]
        return *(len(own) for _, own in base), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(spans[-1][1])

    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            rows = [one(t or "", known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long")


def redact(docs: DataFrame, classifier: Classifier, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with spans masked in the text and the character count (if there is such a column) brought up to date; null texts stay null."""
    bound_batches(docs.sparkSession)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            texts = [t and masked(t, _found(t, classifier, known)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)], own)

    done = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return done.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col])) if chars_col in docs.columns else done
