"""Deliveries: payload checks, retry delays, state transitions and idempotent plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions.text import is_slug

#: Seconds and shares of the retry policy.
BASE, CAP, JITTER, ATTEMPTS = 2.0, 60.0, 0.25, 3
#: Where a delivery may go from each state.
TRANSITIONS = {
    "READY_FOR_DELIVERY": ("DELIVERY_IN_PROGRESS", "DELIVERY_BLOCKED", "DELIVERY_REQUIRES_MANUAL_REVIEW"),
    "DELIVERY_IN_PROGRESS": ("DELIVERED", "DELIVERY_FAILED_RETRYABLE", "DELIVERY_FAILED_PERMANENT", "DELIVERY_NEEDS_RECONCILIATION", "DELIVERY_BLOCKED"),
    "DELIVERY_FAILED_RETRYABLE": ("DELIVERY_IN_PROGRESS", "DELIVERY_FAILED_PERMANENT", "DELIVERY_BLOCKED"),
    "DELIVERY_NEEDS_RECONCILIATION": ("DELIVERED", "DELIVERY_IN_PROGRESS", "DELIVERY_FAILED_PERMANENT", "DELIVERY_REQUIRES_MANUAL_REVIEW"),
}


def jitter(seed: Column, attempt: Column) -> Column:
    """A stable number from 0 to 1 for a seed and an attempt."""
    digest = F.sha2(F.concat_ws("|", seed, attempt.cast("string")), 256)
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") / F.lit(4294967295.0)


def retry_after(value: Column) -> Column:
    """Seconds that a destination asks for; only whole or decimal seconds of at least 0 count."""
    seconds = F.trim(value).try_cast("double")
    return F.when(seconds >= 0, seconds)


def delay(attempt: Column, seed: Column, asked: Column | None = None) -> Column:
    """Seconds before an attempt: what was asked for, else 0 for the first and a doubling, capped, jittered wait after that."""
    wait = F.least(F.lit(BASE) * F.pow(F.lit(2.0), attempt - 2), F.lit(CAP))
    own = F.when(attempt <= 1, F.lit(0.0)).otherwise(F.bround(F.least(wait + wait * JITTER * jitter(seed, attempt), F.lit(CAP)), 6))
    return own if asked is None else F.coalesce(F.least(retry_after(asked), F.lit(CAP)), own)


def schedule(seed: Column, attempts: int = ATTEMPTS) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda n: delay(n, seed))


def allowed(current: Column, target: Column) -> Column:
    """Whether a delivery may go from one state to another; terminal states lead nowhere."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(F.array_contains(F.element_at(table, current), target), F.lit(False))


def violations(moves: DataFrame) -> DataFrame:
    """Moves (current, target) that the table does not have."""
    return moves.where(~allowed(F.col("current"), F.col("target")))


def error_class(status: Column) -> Column:
    """What an HTTP status means for a delivery."""
    return (
        F.when(status.isin(401, 403), "AUTHENTICATION")
        .when(status == 404, "NOT_FOUND")
        .when(status == 409, "CONFLICT")
        .when(status.isin(400, 413, 415, 422), "VALIDATION")
        .when(status == 429, "RATE_LIMITED")
        .when(status == 408, "TIMEOUT")
        .when(status >= 500, "SERVER")
        .when(status.between(200, 299), None)
        .otherwise("UNEXPECTED")
    )


def after_attempt(error: Column, attempt: Column, attempts: int = ATTEMPTS) -> Column:
    """State after an attempt: a conflict or a read that timed out at the end has to be reconciled by hand."""
    last = attempt >= attempts
    return (
        F.when(error.isNull(), "DELIVERED")
        .when(error.isin("CONFLICT", "BAD_RESPONSE"), "DELIVERY_NEEDS_RECONCILIATION")
        .when(error.isin("AUTHENTICATION", "NOT_FOUND", "VALIDATION", "UNEXPECTED"), "DELIVERY_FAILED_PERMANENT")
        .when(~last, "DELIVERY_FAILED_RETRYABLE")
        .when(error == "TIMEOUT", "DELIVERY_NEEDS_RECONCILIATION")
        .otherwise("DELIVERY_FAILED_PERMANENT")
    )


def payload_errors(title: Column, slug: Column, excerpt: Column, content: Column, status: Column, key: Column) -> Column:
    """All reasons why a payload cannot go out, in order."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (empty(title), "title_missing"),
        (empty(content), "content_missing"),
        (~is_slug(slug), "slug_invalid"),
        (F.length(F.coalesce(excerpt, F.lit(""))) > 300, "excerpt_too_long"),
        (F.coalesce(status, F.lit("")) != "draft", "status_not_draft"),
        (~ids.is_sha256(key), "idempotency_key_invalid"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))


def plan(drafts: DataFrame, stored: DataFrame, destination: str) -> DataFrame:
    """Drafts (draft_id, content_hash) against stored deliveries (idempotency_key, draft_id, content_hash, state) -> what to do.

    The same content is replayed from the store; other content of a draft that was delivered goes to a person; all else is sent.
    """
    d = drafts.withColumn("idempotency_key", ids.idempotency_key(F.col("draft_id"), F.col("content_hash"), F.lit(destination)))
    same = stored.select("idempotency_key", F.col("state").alias("_state"))
    other = stored.where("state = 'DELIVERED'").groupBy("draft_id").agg(F.collect_set("content_hash").alias("_sent"))
    joined = d.join(same, "idempotency_key", "left").join(other, "draft_id", "left")
    changed = F.size(F.array_remove(F.coalesce("_sent", F.array().cast("array<string>")), F.col("content_hash"))) > 0
    action = F.when(F.col("_state").isin("DELIVERED", "DELIVERY_FAILED_PERMANENT", "DELIVERY_BLOCKED", "DELIVERY_REQUIRES_MANUAL_REVIEW"), "REPLAY").when(changed, "DELIVERY_REQUIRES_MANUAL_REVIEW").otherwise("SEND")
    return joined.withColumn("delivery_id", ids.delivery_id(F.col("idempotency_key"))).withColumn("action", action).drop("_state", "_sent")
