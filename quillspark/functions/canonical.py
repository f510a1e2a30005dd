"""Canonical JSON of event payloads: arbitrary nesting has no built-in, so it is one Arrow function over the JSON text."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Transport keys that a hash does not cover, keys that hold times, keys whose lists have no order.
TRANSPORT = frozenset("payload_hash payloadHash payload_hash_origin cursor received_at receivedAt delivery_id deliveryId delivery_attempt _raw raw_payload etag request_id requestId".split())
TIMES = frozenset("first_seen firstSeen last_seen lastSeen published_at publishedAt updated_at updatedAt date".split())
UNORDERED = frozenset("sources all_sources urls additional_urls".split())
IDENTITY = ("url", "source_id", "domain", "name")
#: An encoder for all payloads: json.dumps makes one for each.
_dumps = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


@lru_cache(1 << 14)
def utc(value: str) -> str:
    """A time in any offset as UTC; what is no time stays."""
    try:
        t = datetime.fromisoformat(re.sub("[Zz]$", "+00:00", value.strip()))
    except ValueError:
        return value
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    return t.isoformat().replace("+00:00", "Z")


def _place(item: object) -> str:
    if isinstance(item, dict):
        named = [f"{k}:{item[k].strip()}" for k in IDENTITY if isinstance(item.get(k), str) and item[k].strip()]
        return named[0] if named else json.dumps(item, sort_keys=True, ensure_ascii=False)
    return str(item)


def reduced(value: object, key: str = "") -> object:
    if isinstance(value, dict):
        return {k: reduced(v, k) for k, v in value.items() if k not in TRANSPORT}
    if isinstance(value, list):
        items = [reduced(v) for v in value]
        return sorted(items, key=_place) if key in UNORDERED else items
    return utc(value) if isinstance(value, str) and key in TIMES else value


@F.pandas_udf(StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """Sorted keys, no white space, no transport keys; NULL for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else _dumps(reduced(json.loads(text)))
        except ValueError:
            return None

    return payload.map(one)


def payload_hash(payload: Column) -> Column:
    """SHA-256 of the canonical JSON; key order, source order and the spelling of times do not matter."""
    return F.sha2(canonical_json(payload), 256)
