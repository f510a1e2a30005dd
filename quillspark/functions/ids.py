"""Derived identities: a prefix and the start of a SHA-256 over labelled parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 32


def _text(part: Column) -> Column:
    return F.coalesce(part.cast("string"), F.lit(""))


def _seed(**parts: Column) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}:"), _text(part)) for name, part in parts.items()])


def _hashed(prefix: str, seed: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(seed, 256), F.lit(SHORT)))


def draft_id(event_key: Column, article_id: Column, canonical_url: Column, revision: Column) -> Column:
    """By event and revision; without an event key by article, URL and revision; NULL with none of them. No revision, or 0, is 1."""
    rev = F.when(F.coalesce(revision, F.lit(0)) == 0, F.lit(1)).otherwise(revision)
    key, article, url = (F.trim(_text(c)) for c in (event_key, article_id, canonical_url))
    by_article = F.when((article != "") | (url != ""), _seed(article=article, url=url, rev=rev))
    return _hashed("draft", F.when(key != "", _seed(event=key, rev=rev)).otherwise(by_article))


def claim_id(draft: Column, claim_type: Column, subject: Column, predicate: Column, value: Column, text: Column) -> Column:
    return _hashed("claim", _seed(draft=draft, type=claim_type, subject=subject, predicate=predicate, value=value, text=text))


def evidence_id(source_url: Column, excerpt: Column) -> Column:
    return _hashed("ev", _seed(url=source_url, excerpt=excerpt))


def link_id(claim: Column, evidence: Column, relation: Column) -> Column:
    return _hashed("link", _seed(claim=claim, evidence=evidence, relation=relation))


def conflict_id(kind: Column, subject: Column, values: Column, claims: Column) -> Column:
    """Values and claims in any order give the same id."""
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return _hashed("conflict", _seed(type=kind, subject=subject, values=joined(values), claims=joined(claims)))


def assessment_id(draft: Column, version: Column, digest: Column) -> Column:
    return _hashed("fa", _seed(draft=draft, version=version, hash=digest))


def gate_id(draft: Column, policy: Column, digest: Column) -> Column:
    return _hashed("gate", _seed(draft=draft, policy=policy, hash=digest))


def idempotency_key(draft: Column, content_hash: Column, destination: Column) -> Column:
    """NULL where a part is missing: such a delivery has no identity."""
    d, c, t = (F.trim(_text(x)) for x in (draft, content_hash, destination))
    return F.when((d != "") & (c != "") & (t != ""), F.sha2(_seed(draft=d, content=c, dest=t), 256))


def delivery_id(key: Column) -> Column:
    return F.concat(F.lit("dlv-"), F.left(key, F.lit(SHORT)))


def hash_of(values: Column) -> Column:
    """SHA-256 of trimmed strings in sorted order."""
    return F.sha2(F.array_join(F.array_sort(F.transform(values, lambda v: F.trim(v))), "|"), 256)


def is_sha256(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike("^[0-9a-f]{64}$"), F.lit(False))
