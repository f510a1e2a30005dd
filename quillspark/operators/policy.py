"""Editorial decisions as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of, hits, let, squeeze


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def entry_status(url: Column, title: Column, summary: Column, source_count: Column, multi_source: Column, domains: Column) -> Column:
    """What the entry policy says of an item; the first rule that applies."""
    everything, prose = F.lower(_text(url, title, summary)), _text(title, summary)
    trusted = F.exists(F.coalesce(domains, F.array().cast("array<string>")), lambda d: any_of(d, L.TRUSTED_SINGLE_SOURCES))
    single = (F.coalesce(source_count, F.lit(0)) <= 1) & ~F.coalesce(multi_source, F.lit(False))
    return (
        F.when(any_of(everything, L.LIVE_SIGNALS), "LIVEBLOG_BLOCKED")
        .when(any_of(everything, L.OPINION_SIGNALS), "OPINION_BLOCKED")
        .when(any_of(prose, L.MOJIBAKE), "BROKEN_ENCODING")
        .when(single & ~trusted, "SINGLE_SOURCE_NOT_RELIABLE")
        .otherwise("OK")
    )


def plain(html: Column) -> Column:
    """Text of a fragment without tags; character references stay."""
    return squeeze(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))


def extraction_status(content: Column, min_chars: int = 500) -> Column:
    """How usable an extracted body is. A paywall word outranks menus, menus outrank length."""

    def status(p: Column) -> Column:
        lower = p["lower"]
        return (
            F.when(p["text"] == "", "ARTICLE_BODY_NOT_FOUND")
            .when(any_of(lower, L.PAYWALL_SIGNALS), "PAYWALLED")
            .when(hits(lower, L.NAVIGATION_SIGNALS) >= 3, "NAVIGATION_NOISE")
            .when(F.length(p["text"]) < min_chars, "TOO_SHORT")
            .otherwise("ARTICLE_BODY_OK")
        )

    text = let(plain(content), lambda t: F.struct(t.alias("text"), F.lower(t).alias("lower")))
    return F.when(content.isNull(), "FETCH_ERROR").otherwise(let(text, status))


def reliable_alone(status: Column, domain: Column) -> Column:
    return F.coalesce((status == "ARTICLE_BODY_OK") & any_of(F.lower(domain), L.TRUSTED_SINGLE_SOURCES), F.lit(False))


def article_type(title: Column, source_words: Column, snippet: Column) -> Column:
    """list, guide, analysis or news; a short text is never a list or guide."""

    def kind(p: Column) -> Column:
        text, n = p["text"], p["n"]
        found = (
            F.when(text.rlike(L.LIST_RE), F.when(n <= 600, "news").otherwise("list"))
            .when((n >= 600) & text.rlike(L.GUIDE_RE), F.when(n <= 600, "news").otherwise("guide"))
            .when(text.rlike(L.ANALYSIS_RE), "analysis")
        )
        # Only long texts need to be told from news.
        return F.coalesce(found, F.when((n >= 1500) & ~text.rlike(L.NEWS_RE), "guide").otherwise("news"))

    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(snippet, F.lit("")), F.lit(1500)))
    return let(F.struct(text.alias("text"), source_words.alias("n")), kind)


def editorial_type(title: Column, text: Column, body: Column) -> Column:
    """opinion_like, review, listicle, guide, news or analysis, in this order of signs.

    Signs are looked for in the title and the first 2,000 characters, as the rule has it; the length counts all words. A text of up to 600
    words is news whatever its title says, unless its headings number a list. Without words the title alone decides. NULL is empty.
    """
    headings = F.regexp_extract_all(F.coalesce(body, text, F.lit("")), F.lit(r"(?is)<h2\b[^>]*>(.*?)</h2>"), F.lit(1))
    numbered = F.filter(headings, lambda h: F.regexp_replace(h, "<[^>]+>", "").rlike(r"^\s*\d+[.):\-]"))
    # Trimmed without a pattern of its own: splitting at white space leaves an empty first or last part.
    count = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    signs = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(text, F.lit("")), F.lit(2000)))

    def kind(p: Column) -> Column:
        short = p["n"].between(1, 600)
        return (
            F.when(p["signs"].rlike(L.TYPE_OPINION_RE), "opinion_like")
            .when(p["signs"].rlike(L.TYPE_REVIEW_RE), "review")
            .when(p["listed"], "listicle")
            .when(p["signs"].rlike(L.TYPE_LIST_RE), F.when(short, "news").otherwise("listicle"))
            .when(p["signs"].rlike(L.TYPE_GUIDE_RE), F.when(short, "news").otherwise("guide"))
            .when(p["n"] < 900, "news")
            .otherwise("analysis")
        )

    return let(F.struct(signs.alias("signs"), count.alias("n"), ((F.size(headings) >= 4) & (F.size(numbered) >= 3)).alias("listed")), kind)


def word_policy(source_words: Column, kind: Column) -> Column:
    """struct(min, target, max, allow_expansion, reason) of acceptable output lengths; at most 550 and 1000."""
    w = source_words.cast("double")
    share = lambda x: (w * x).cast("int")
    deep = F.lower(kind).isin("guide", "list", "analysis")
    low = F.when(deep, share(0.75)).when(w <= 350, F.greatest(F.lit(250), share(0.75))).when(w <= 600, share(0.75)).when(w <= 900, share(0.8)).otherwise(share(0.75))
    aim = F.when(~deep & (w <= 900), share(1.0)).otherwise(share(0.9))
    high = F.when(deep, share(1.1)).when(w <= 600, share(1.25)).when(w <= 900, share(1.2)).otherwise(share(1.1))
    high = F.least(high, F.lit(1000))
    reason = (
        F.when(deep, F.concat(F.lit("deep_content_"), F.lower(kind), F.lit("_proportional_to_source")))
        .when(w <= 350, "short_news_no_expansion")
        .when(w <= 600, "medium_news_proportional")
        .when(w <= 900, "long_news_allow_if_below_min")
        .otherwise("very_long_news_preserve_depth")
    )
    return F.struct(
        F.least(low, F.lit(550)).alias("min_acceptable_words"),
        F.least(aim, high).alias("target_words"),
        high.alias("max_recommended_words"),
        (deep | (w > 600)).alias("allow_expansion"),
        reason.alias("reason"),
    )


def needs_validator(output_words: Column, min_words: Column, score: Column, title: Column, meta: Column, content: Column, kind: Column, issues: Column) -> Column:
    """struct(run, reason): whether a second look is worth its price."""
    titled = F.trim(F.coalesce(title, F.lit(""))) != ""
    described = F.length(F.trim(F.coalesce(meta, F.lit("")))) >= 80
    bodied = F.length(F.trim(F.coalesce(content, F.lit("")))) > 100
    enough = output_words >= min_words
    blocking = F.exists(F.coalesce(issues, F.array().cast("array<string>")), lambda i: any_of(i, ("TITLE_MISSING", "TITLE_HAS_HTML", "FORBIDDEN_COMPETITOR", "SOURCES_SKIPPED_IN_CREDIT")))
    fine = titled & bodied & enough & ~blocking & (kind == "news")
    answer = lambda run, reason: F.struct(F.lit(run).alias("run"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return (
        F.when(fine & described & score.isNull(), answer(False, "score_unavailable_but_deterministic_checks_passed"))
        .when(fine & described & (score >= 35), answer(False, "deterministic_checks_passed"))
        .when(fine, answer(False, "short_news_proportional_and_complete"))
        .when(score < 45, answer(True, F.concat(F.lit("low_structural_score score="), score.cast("string"))))
        .when(~enough, answer(True, F.concat(F.lit("output_below_min output="), output_words.cast("string"), F.lit(" min="), min_words.cast("string"))))
        .when(~titled, answer(True, "title_missing"))
        .when(~described, answer(True, "meta_missing_or_short"))
        .when(blocking, answer(True, "blocking_issues"))
        .otherwise(answer(False, "deterministic_checks_passed"))
    )


def draft_decision(content: Column, title: Column, errors: Column) -> Column:
    """struct(allowed, reason): only technical failures stop a draft."""
    critical = F.exists(F.coalesce(errors, F.array().cast("array<string>")), lambda e: any_of(e, ("critical", "CRITICAL", "BLOCKED", "FATAL")))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    answer = lambda ok, reason: F.struct(F.lit(ok).alias("allowed"), F.lit(reason).alias("reason"))
    return (
        F.when(critical, answer(False, "critical_technical_failure"))
        .when(empty(content), answer(False, "invalid_empty_content"))
        .when(empty(title), answer(False, "invalid_empty_title"))
        .otherwise(answer(True, "processable_content"))
    )


def event_score(title: Column, content: Column, tags: Column, source_count: Column) -> Column:
    """struct(score, entity): points for a known name, tags in demand, depth and several sources; of several names the longest, then the first."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(F.coalesce(content, F.lit("")), F.lit(500))))
    names = sorted(L.ENTITIES, key=lambda e: (-len(e), e))
    entity = F.coalesce(*[F.when(F.contains(text, F.lit(e)), F.lit(e)) for e in names])
    demand = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).isin(*L.DEMAND_TAGS))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = points(entity.isNotNull(), 30) + points(demand, 25) + points(entity.isNotNull() & any_of(text, L.DEPTH_WORDS), 15) + points(F.coalesce(source_count, F.lit(1)) > 1, 10)
    return F.struct(score.alias("score"), entity.alias("entity"))


def failure_state(reason: Column, failures: Column, terminal: tuple[str, ...], runaway: tuple[str, ...]) -> Column:
    """Where an item goes after a failed attempt: runaway output and five failures end it for good."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(any_of(r, runaway), "FAILED_PERMANENT").when(any_of(r, terminal), "FAILED").when(F.coalesce(failures, F.lit(0)) >= 5, "FAILED_PERMANENT").otherwise("QUEUED")


#: States that only people assign, and the states of an event's validation and processing.
FORBIDDEN_STATES = ("APPROVED", "PUBLISHED", "PUBLICATION_READY", "SCHEDULED", "LIVE")
VALIDATION_STATES = ("RECEIVED", "VALIDATED", "INVALID", "DUPLICATE_DELIVERY", "REVISION_HASH_CONFLICT", "STALE_REVISION")
PROCESSING_STATES = ("QUEUED", "PROCESSING", "DRAFT_GENERATED", "DRAFT_FAILED", "REPLAY_REQUESTED", "REPLAY_PROCESSING", "REPLAY_COMPLETED", "REPLAY_FAILED")


def state_verdict(state: Column, allowed: tuple[str, ...]) -> Column:
    """OK, FORBIDDEN for a state of publication, UNKNOWN for one that is not allowed."""
    name = F.trim(F.coalesce(state, F.lit("")))
    return F.when(name.isin(*FORBIDDEN_STATES), "FORBIDDEN").when(name.isin(*allowed), "OK").otherwise("UNKNOWN")
