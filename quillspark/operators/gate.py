"""The editorial gate: rules are rows of one array of structs; the verdict is a fold over severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import urls
from quillspark.functions.lexicons import TRUSTED_SINGLE_SOURCES
from quillspark.functions.text import any_of, let, plain_letters
from quillspark.operators.policy import plain

BLOCKING, WARNING, INFO = "BLOCKING", "WARNING", "INFO"
OK_STATUSES = ("OK", "ARTICLE_BODY_OK", "SUCCESS", "EXTRACTED")
PARTIAL_STATUSES = ("PARTIAL", "TOO_SHORT", "PAYWALLED", "BROKEN_ENCODING", "NAVIGATION_NOISE")
CRITICAL_CONFLICTS = ("DATE_CONFLICT", "NUMBER_CONFLICT", "STATUS_CONFLICT", "IDENTITY_CONFLICT", "ATTRIBUTION_CONFLICT")
#: What may not survive in a body.
UNSAFE = {
    "tag <script>": r"(?i)<\s*script\b", "tag <form>": r"(?i)<\s*form\b", "tag <object>": r"(?i)<\s*object\b", "tag <embed>": r"(?i)<\s*embed\b",
    "handler on*=": r"(?i)<[^>]+\son[a-z]+\s*=", "URL javascript:": r"(?i)javascript\s*:", "tag <base>": r"(?i)<\s*base\b",
}
IFRAME_HOSTS = ("youtube.com", "youtube-nocookie.com", "youtu.be", "player.vimeo.com", "open.spotify.com")
IFRAME = r"""(?i)<\s*iframe\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""
FOREIGN = (r"(?i)/wp-content/uploads/", r"(?i)\bwp-image-", r"(?i)<!--\s*/?wp:")
#: Phrases aimed at a model.
INJECTION = (
    r"(?iU)\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"(?iU)\bdisregard\s+(?:all\s+|the\s+)?(?:previous|prior|above)\s+\w+",
    r"(?iuU)\bignore\s+(?:as\s+|todas\s+as\s+)?instru[cç][oõ]es\s+(?:anteriores|acima)\b",
    r"(?iuU)\b(?:you\s+are\s+now|voc[eê]\s+agora\s+[eé])\s+(?:a|an|um|uma)?\s*\w*\s*(?:system|assistant)\b",
    r"(?iuU)(?:^|\s)(?:system|assistant)\s*:\s*(?:you|voc[eê])\b",
    r"(?i)<<<\s*(?:INICIO|FIM)_CONTEUDO_FONTE\s*>>>",
    r"(?iU)\b(?:reveal|show|print)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?)\b",
)
#: For each of these phrases, letters of which one run is in every text that it matches.
INJECTION_NEEDS = (("ignore",), ("disregard",), ("ignore",), ("you", "voc"), ("system", "assistant"), ("conteudo_fonte",), ("reveal", "show", "print"))
MIN_WORDS = {"news": 250, "list": 400, "guide": 600, "analysis": 500, "unknown": 250}
DEFAULTS = {"min_distinct_source_domains": 2, "min_coverage_ratio": 0.75, "min_origins": 2, "prompt_injection_min_signals": 1, "min_body_words": 0}


def unsafe_signals(body: Column) -> Column:
    """What is unsafe in a body, by name."""
    sources = F.regexp_extract_all(body, F.lit(IFRAME), F.lit(1))
    strange = F.filter(sources, lambda s: ~any_of(F.coalesce(urls.domain(s), F.lit("")), IFRAME_HOSTS))
    bare = body.rlike(r"(?i)<\s*iframe\b") & (F.size(sources) == 0)
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(name)) for name, p in UNSAFE.items()], F.when(F.size(strange) > 0, F.lit("iframe")), F.when(bare, F.lit("iframe without src"))))


def injection_signals(*fields: Column) -> Column:
    """Number of different (pattern, match) pairs in the fields."""
    one = lambda f, i, p: F.when(f.rlike(p), F.concat(F.lit(f"{i}:"), F.lower(F.regexp_replace(F.trim(F.regexp_extract(f, p, 0)), r"\s+", " "))))
    # A phrase is only looked for where its letters are.
    of = lambda f: let(F.struct(f.alias("f"), plain_letters(f).alias("low")), lambda t: F.array(*[F.when(any_of(t["low"], needs), one(t["f"], i, p)) for i, (p, needs) in enumerate(zip(INJECTION, INJECTION_NEEDS, strict=True))]))
    return F.size(F.array_distinct(F.array_compact(F.concat(*[of(f) for f in fields]))))


def _empty(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def rules(policy: dict | None = None) -> dict[str, tuple[str, Column]]:
    """code -> (severity, triggered), over draft columns, the factual columns that with_facts() adds and those of read(). A NULL verdict means that the rule failed."""
    t = DEFAULTS | (policy or {})
    c = F.col
    content = lambda f: F.coalesce(c(f"content.{f}"), F.lit(""))
    body, title, subtitle, meta = content("body_html"), content("title"), content("subtitle"), content("meta_description")
    sources, domains, words = c("_sources"), c("_domains"), c("_words")
    status = lambda s: F.upper(F.trim(F.coalesce(s["extraction_status"], F.lit(""))))
    good = F.exists(sources, lambda s: status(s).isin(*OK_STATUSES))
    blank = F.exists(sources, lambda s: status(s) == "")
    partial = F.exists(sources, lambda s: status(s).isin(*PARTIAL_STATUSES))
    n = F.size(sources)
    single = n == 1
    trusted = any_of(F.coalesce(F.get(domains, 0), F.lit("")), policy.get("trusted", TRUSTED_SINGLE_SOURCES) if policy else TRUSTED_SINGLE_SOURCES)
    p = lambda f: c(f"provenance.{f}")
    strings = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    kind = F.coalesce(c("content_type"), F.lit("unknown"))
    floor = F.lit(int(t["min_body_words"])) if t["min_body_words"] else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIN_WORDS.items() for x in kv]), kind), F.lit(MIN_WORDS["unknown"]))
    foreign = F.lit(False)
    for r in FOREIGN:
        foreign = foreign | body.rlike(r)
    blocked = F.exists(strings("content.category_suggestions"), lambda x: F.lower(x).isin(*t.get("blocked_topics", ("politica", "esportes"))))
    return {
        "GATE_MISSING_TITLE": (BLOCKING, _empty(title)),
        "GATE_MISSING_BODY": (BLOCKING, words == 0),
        "GATE_MISSING_SOURCES": (BLOCKING, n == 0),
        "GATE_NO_SUCCESSFUL_EXTRACTION": (BLOCKING, (n > 0) & ~good & ~blank),
        "GATE_MISSING_PROVENANCE": (BLOCKING, _empty(p("input_hash")) | _empty(p("output_hash")) | _empty(p("pipeline_version")) | _empty(p("commit_sha"))),
        "GATE_FORBIDDEN_WORDPRESS_MARKUP": (BLOCKING, foreign | any_of(c("_flat"), ("wp_post_id", "featured_media", "yoast"))),
        "GATE_UNSAFE_HTML": (BLOCKING, F.size(unsafe_signals(body)) > 0),
        "GATE_UNSUPPORTED_TOPIC": (BLOCKING, blocked),
        "GATE_BLOCKING_ERRORS_PRESENT": (BLOCKING, F.size(strings("blocking_errors")) > 0),
        "GATE_INVALID_REVISION_CONTEXT": (BLOCKING, F.coalesce((c("revision") < 1) | (p("input_revision") != c("revision")) | (p("input_event_key") != c("event_key")), F.lit(False))),
        "GATE_MATERIAL_CLAIM_UNSUPPORTED": (BLOCKING, F.coalesce(c("critical_unsupported"), F.lit(0)) > 0),
        "GATE_CRITICAL_FACT_CONFLICT": (BLOCKING, F.coalesce(c("critical_conflicts"), F.lit(0)) > 0),
        "GATE_LEGACY_INPUT_CONTRACT": (WARNING, p("input_contract_version").eqNullSafe("legacy-feed-input-v0")),
        "GATE_MISSING_PROMPT_VERSION": (WARNING, _empty(p("prompt_version"))),
        "GATE_SINGLE_UNTRUSTED_SOURCE": (WARNING, single & ~trusted),
        "GATE_SOURCE_DIVERSITY_LOW": (WARNING, (n >= 2) & (F.size(domains) < int(t["min_distinct_source_domains"]))),
        "GATE_EXTRACTION_WARNINGS": (WARNING, partial & (good | blank)),
        "GATE_EVIDENCE_MISSING": (WARNING, F.when(c("material").isNotNull(), (c("material") > 0) & (c("supporting_links") == 0)).otherwise(F.coalesce(F.size("evidence"), F.lit(0)) <= 0)),
        "GATE_EVIDENCE_CONFLICT": (WARNING, F.when(c("material").isNotNull(), (c("conflicting") > 0) | (c("conflicts") > 0)).otherwise(F.coalesce(F.exists("evidence", lambda e: F.coalesce(e["status"].isin("conflicting", "unsupported", "unverified"), F.lit(False))), F.lit(False)))),
        "GATE_FACTUAL_COVERAGE_LOW": (WARNING, F.coalesce(c("coverage_ratio") < float(t["min_coverage_ratio"]), F.lit(False))),
        "GATE_PARTIAL_SUPPORT_PRESENT": (WARNING, F.coalesce(c("partially_supported") > 0, F.lit(False))),
        "GATE_UNVERIFIED_CLAIMS_PRESENT": (WARNING, F.coalesce(c("unverified") > 0, F.lit(False))),
        "GATE_SOURCE_ORIGIN_DIVERSITY_LOW": (WARNING, (F.size(F.array_distinct(F.transform(sources, lambda s: s["url"]))) >= 2) & F.coalesce(c("origins") < int(t["min_origins"]), F.lit(False))),
        "GATE_CONTENT_TOO_THIN": (WARNING, words < floor),
        "GATE_MISSING_META_DESCRIPTION": (WARNING, _empty(meta)),
        "GATE_SUBTITLE_ISSUE": (WARNING, _empty(subtitle) | (F.lower(F.trim(subtitle)) == F.lower(F.trim(title))) | (~_empty(meta) & (F.lower(F.trim(subtitle)) == F.lower(F.trim(meta)))) | subtitle.rlike("<[a-zA-Z/][^>]*>")),
        "GATE_UNVERIFIED_MEDIA": (WARNING, F.coalesce(F.exists("media_candidates", lambda m: m["status"].eqNullSafe("unverified")), F.lit(False))),
        "GATE_PROMPT_INJECTION_SIGNAL": (WARNING, injection_signals(c("_plain"), body, title, subtitle) >= int(t["prompt_injection_min_signals"])),
        "GATE_REVISION_GAP": (WARNING, F.exists(strings("warnings"), lambda w: F.contains(w, F.lit("REVISION_GAP")))),
        "GATE_TRUSTED_SINGLE_SOURCE": (INFO, single & trusted),
        "GATE_MULTI_SOURCE": (INFO, F.size(domains) >= 2),
        "GATE_V1_INPUT_CONTRACT": (INFO, p("input_contract_version").eqNullSafe("rss-prime-event-v1")),
        "GATE_LOCAL_OUTPUT_ONLY": (INFO, F.lit(True)),
    }


def read(drafts: DataFrame) -> DataFrame:
    """Drafts with what several rules look at, worked out once for each draft: text, number of words, sources with an address, their domains, all as one text."""
    body = F.coalesce(F.col("content.body_html"), F.lit(""))
    sources = F.filter(F.coalesce("sources", F.array().cast("array<struct<url:string,source_id:string,name:string,domain:string,title:string,extraction_status:string,is_primary:boolean>>")), lambda s: ~_empty(s["url"]))
    domain = lambda s: F.coalesce(F.when(~_empty(s["domain"]), s["domain"]), urls.domain(s["url"]))
    flat = F.lower(F.to_json(F.struct("content", "sources", "media_candidates", "warnings")))
    # plain() leaves single spaces, none at the ends: so words are one more than spaces.
    spaces = F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit("")))
    out = drafts.withColumns({"_plain": plain(body), "_flat": flat, "_sources": sources})
    return out.withColumns({"_words": F.when(F.col("_plain") == "", 0).otherwise(spaces + 1), "_domains": F.array_distinct(F.array_compact(F.transform("_sources", domain)))})


FACTS = {"material": "long", "supporting_links": "long", "conflicting": "long", "conflicts": "long", "partially_supported": "long", "unverified": "long", "coverage_ratio": "double", "origins": "long", "critical_unsupported": "long", "critical_conflicts": "long"}


def with_facts(drafts: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Drafts with their factual numbers; without an assessment they are NULL and rules fall back on the draft's own evidence."""
    out = drafts if facts is None else drafts.join(facts, "draft_id", "left")
    for name, kind in FACTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out if "content_type" in out.columns else out.withColumn("content_type", F.lit(None).cast("string"))


def outcome(severities: Column) -> Column:
    return F.when(F.array_contains(severities, BLOCKING), "BLOCKED").when(F.array_contains(severities, WARNING), "REVIEW_REQUIRED").otherwise("CLEAR")


def evaluate(drafts: DataFrame, facts: DataFrame | None = None, policy: dict | None = None, enabled: list[str] | None = None) -> DataFrame:
    """(draft_id, outcome, triggered codes by severity); a rule that could not be evaluated blocks."""
    chosen = {k: v for k, v in rules(policy).items() if enabled is None or k in enabled}
    one = lambda code, sev, hit: let(hit, lambda h: F.when(h.isNull(), F.struct(F.lit(code).alias("code"), F.lit(BLOCKING).alias("severity"))).when(h, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))))
    fired = F.array_compact(F.array(*[one(k, s, h) for k, (s, h) in chosen.items()]))
    by = lambda sev: F.array_sort(F.transform(F.filter("fired", lambda r: r["severity"] == sev), lambda r: r["code"]))
    judged = read(with_facts(drafts, facts)).select("draft_id", fired.alias("fired"))
    return judged.select("draft_id", outcome(F.transform("fired", lambda r: r["severity"])).alias("outcome"), by(BLOCKING).alias("blocking"), by(WARNING).alias("warnings"), by(INFO).alias("info"))
