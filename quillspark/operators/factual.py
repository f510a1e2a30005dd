"""Claims, evidence, links, statuses, conflicts and coverage, all partitioned by draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import ids, values
from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of, at_boundary, comparison_key, let, normal, overlap, plain_letters, sentences, tokens

TOPICAL, STRONG = 0.12, 0.55
CRITICAL_LOCATIONS = ("title", "subtitle", "meta_description", "body:p1")
_UP = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
_MULT = r"milh[oõ]e?s?|bilh[oõ]e?s?|trilh[oõ]e?s?|millions?|billions?|mil"
DATE = r"(?iuU)\b(\d{1,2}\s*de\s+[a-zçã]+\s*(?:de\s+)?\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|[A-Z][a-z]+\s+\d{1,2},\s*\d{4}|[a-zçã]+\s+de\s+\d{4})\b"
NUMBER = rf"(?iuU)((?:R\$|US\$|U\$S|\$|€|£)\s*[\d.,]+(?:\s*(?:{_MULT}))?|[\d.,]+\s*%|[\d.,]+\s*(?:{_MULT})|\b\d{{1,3}}(?:[.,]\d{{3}})+\b)"
QUOTE = "[\"“]([^\"”]{12,300})[\"”]"
ATTRIBUTION = rf"(?U)\b(?i:segundo|de acordo com|conforme|according to)\s+([{_UP}][\w'’\-]*(?:\s+[{_UP}][\w'’\-]*){{0,3}})"
SUBJECT = rf"(?U)^\s*([{_UP}][\w'’\-]*(?:\s+(?:de|da|do|dos|das|of|the)?\s*[{_UP}][\w'’\-]*){{0,4}})"


def material(text: Column, key: Column | None = None) -> Column:
    """Neither menu nor promotion nor opinion, and at least 12 characters of comparison key (given, or made of the text)."""
    low = lambda run: F.exists(F.array(plain_letters(text)), run)
    # A pattern is only looked for where its letters are.
    promo = low(lambda t: F.exists(F.array(*[F.when(any_of(t, needs), text.rlike(p)).otherwise(False) for p, needs in zip(L.NON_MATERIAL, L.NON_MATERIAL_NEEDS, strict=True)]), lambda x: x))
    return (F.length(comparison_key(text) if key is None else key) >= 12) & ~promo


def subject(sentence: Column) -> Column:
    """The run of proper names that a sentence starts with."""
    return F.nullif(normal(F.regexp_extract(sentence, SUBJECT, 1)), F.lit(""))


def segments(drafts: DataFrame) -> DataFrame:
    """(draft_id, location, text) of title, subtitle, summary, meta description and each paragraph of the body."""
    body = F.coalesce("content.body_html", F.lit(""))
    paragraphs = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    bare = lambda c: normal(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    parts = F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.split(body, r"\n{2,}"))
    own = F.array(*[F.struct(F.lit(n).alias("location"), normal(F.col(f"content.{n}")).alias("text")) for n in ("title", "subtitle", "summary", "meta_description")])
    numbered = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("body:p"), (i + 1).cast("string")).alias("location"), bare(p).alias("text")))
    return drafts.select("draft_id", F.posexplode(F.concat(own, numbered)).alias("place", "s")).select("draft_id", "place", "s.location", "s.text").where("text <> ''")


def claims(drafts: DataFrame, most: int = 100) -> DataFrame:
    """Claims by patterns: dates, quantities, quotes, attributions and one status for each sentence; equal claims merge their locations.

    The cap per draft keeps the first by place, as a reader would meet them.
    """
    # The key is made with the sentence: a filter on it below the explosion would make it again.
    keyed = F.transform(sentences(F.col("text")), lambda x: F.struct(x.alias("sentence"), comparison_key(x).alias("folded")))
    s = segments(drafts).select("draft_id", "place", "location", F.posexplode(keyed).alias("nth", "s")).select("draft_id", "place", "location", "nth", "s.sentence", "s.folded")
    s = s.where(material(F.col("sentence"), F.col("folded"))).withColumn("subject", subject(F.col("sentence")))
    row = lambda kind, predicate, value, text: F.struct(F.lit(kind).alias("claim_type") if isinstance(kind, str) else kind.alias("claim_type"), F.lit(predicate).alias("predicate") if isinstance(predicate, str) else predicate.alias("predicate"), value.alias("value"), text.alias("display_text"))
    # Only what has a digit from 0 to 9 has a normal date or number, only what has a double quote a quotation.
    every = lambda pattern, having: F.when(F.col("sentence").rlike(having), F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
    dates = F.transform(every(DATE, "[0-9]"), lambda m: row("DATE", "date", values.normal_date(m), m))
    numbers = F.transform(every(NUMBER, "[0-9]"), lambda m: row("NUMBER", "amount", values.normal_number(m), m))
    quotes = F.transform(every(QUOTE, "[\"“]"), lambda m: row("QUOTE", "quote", comparison_key(m), normal(m)))
    by = let(plain_letters(F.col("sentence")), lambda t: any_of(t, ("segundo", "de acordo com", "conforme", "according to")))
    who = F.when(by, normal(F.regexp_extract("sentence", ATTRIBUTION, 1))).otherwise("")
    attributed = let(who, lambda w: F.when(w != "", row("ATTRIBUTION", "attributed_to", comparison_key(w), w)))
    hit = F.coalesce(*[F.when(F.contains("folded", F.lit(t)) & F.col("folded").rlike(rf"\b{t}\b"), F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"))) for t, k, p in L.STATUS_TERMS])
    status = let(hit, lambda h: F.when(h.isNotNull(), row(h["k"], h["p"], h["p"], F.col("sentence"))))
    found = F.filter(F.concat(dates, numbers, quotes, F.array_compact(F.array(attributed, status))), lambda c: c["value"].isNotNull() & (c["value"] != ""))
    flat = s.select("draft_id", "place", "nth", "location", "sentence", "subject", F.posexplode(found).alias("k", "c")).select("*", "c.*").drop("c")
    key = comparison_key(F.col("subject"))
    named = flat.withColumn("normalized_subject", key).withColumn("claim_id", ids.claim_id(F.col("draft_id"), F.col("claim_type"), key, F.col("predicate"), F.col("value"), F.col("display_text")))
    at = F.struct("place", "nth", "k")
    merged = named.groupBy("draft_id", "claim_id").agg(F.min(at).alias("at"), *[F.min_by(c, at).alias(c) for c in ("claim_type", "predicate", "value", "display_text", "normalized_subject")], F.array_sort(F.collect_set("location")).alias("locations"))
    return merged.withColumn("_n", F.row_number().over(Window.partitionBy("draft_id").orderBy("at"))).where(F.col("_n") <= most).drop("_n", "at").withColumn("is_material", F.lit(True))


def evidence(sources: DataFrame, most: int = 12, excerpt: int = 500) -> DataFrame:
    """sources (draft_id, url, domain, source_name, content, is_primary) -> excerpts: the first sentences of at least 40 characters."""
    from quillspark.functions import urls

    bare = normal(F.regexp_replace(F.coalesce("content", F.lit("")), "<[^>]+>", " "))
    s = sources.select("*", F.posexplode(F.slice(sentences(bare), 1, most)).alias("nth", "sentence")).where(F.length("sentence") >= 40)
    cut = at_boundary(F.col("sentence"), excerpt)
    e = s.withColumn("excerpt", cut["text"]).withColumn("normalized_excerpt", comparison_key(F.col("excerpt")))
    hedged = F.col("normalized_excerpt").rlike(r"\b(rumor|rumores|suposto|supostamente|boato|alegadamente|allegedly|reportedly)\b")
    strength = F.when(hedged, "WEAK").when(F.coalesce("is_primary", F.lit(False)), "PRIMARY").otherwise("SECONDARY")
    e = e.select(
        "draft_id", ids.evidence_id(F.col("url"), F.col("normalized_excerpt")).alias("evidence_id"), "url", "excerpt", "normalized_excerpt", strength.alias("strength"),
        urls.origin_key(F.col("url"), F.col("domain"), F.col("source_name")).alias("origin"), "nth",
    )
    return e.withColumn("_n", F.row_number().over(Window.partitionBy("draft_id", "evidence_id").orderBy("nth"))).where("_n = 1").drop("_n", "nth")


def _listed(table: dict, value: Column, excerpt: Column, whole_word: bool) -> Column:
    out = F.lit(False)
    for key, terms in table.items():
        found = excerpt.rlike(r"\b(?:" + "|".join(terms) + r")\b") if whole_word else F.greatest(*[F.contains(excerpt, F.lit(t)) for t in terms], F.lit(False))
        out = out | ((value == key) & found)
    return F.coalesce(out, F.lit(False))


def relate(pairs: DataFrame) -> DataFrame:
    """Adds similarity and relation to pairs of claims and excerpts; pairs that are not about the same thing go. A contradiction outranks support."""
    c = F.col
    similarity = let(comparison_key(c("display_text")), lambda k: overlap(k, c("normalized_excerpt")))
    about = (c("normalized_subject") != "") & F.contains(c("normalized_excerpt"), c("normalized_subject"))
    date, number = values.normal_date(c("excerpt")), values.normal_number(c("excerpt"))
    p = pairs.withColumns({"similarity": similarity, "_about": F.coalesce(about, F.lit(False)), "_date": date, "_number": number})
    against = (
        F.when(c("claim_type") == "DATE", values.dates_conflict(c("value"), c("_date")))
        .when(c("claim_type") == "NUMBER", values.numbers_conflict(c("value"), c("_number")))
        .when(c("claim_type").isin("STATUS", "RELEASE", "AVAILABILITY"), _listed(L.STATUS_OPPOSITES, c("value"), c("normalized_excerpt"), False))
        .otherwise(False)
    )
    said = F.contains(c("normalized_excerpt"), F.lower("value")) | (F.lower("_date") == F.lower("value")) | (F.lower("_number") == F.lower("value")) | _listed(L.STATUS_SYNONYMS, c("value"), c("normalized_excerpt"), True)
    said = F.coalesce(said, F.lit(False)) & (F.coalesce("value", F.lit("")) != "")
    relation = (
        F.when(F.coalesce(against, F.lit(False)), "CONTRADICTS")
        .when(said & (c("_about") | (c("similarity") >= TOPICAL)), "SUPPORTS")
        .when(said, "PARTIALLY_SUPPORTS")
        .when((F.coalesce("value", F.lit("")) == "") & (c("similarity") >= STRONG), "PARTIALLY_SUPPORTS")
        .otherwise("MENTIONS")
    )
    return p.where((c("similarity") >= TOPICAL) | c("_about")).withColumn("relation", relation).drop("_about", "_date", "_number")


def links(claim: DataFrame, excerpt: DataFrame, most: int = 10) -> DataFrame:
    """Claims against excerpts of the same draft. All contradictions stay; others fill what is left of the cap, the most similar first.

    A pair can only relate if it shares a word or the subject is in the excerpt, and a subject is made of words: so pairs meet on
    (draft, word) and never as a product of a draft's claims and excerpts.
    """
    words = lambda df, key, text: df.select("draft_id", key, F.explode(tokens(text)).alias("word"))
    a = words(claim, "claim_id", F.concat_ws(" ", comparison_key(F.col("display_text")), F.col("normalized_subject")))
    b = words(excerpt, "evidence_id", F.col("normalized_excerpt"))
    meet = a.join(b, ["draft_id", "word"]).select("draft_id", "claim_id", "evidence_id").distinct()
    pairs = meet.join(claim, ["draft_id", "claim_id"]).join(excerpt, ["draft_id", "evidence_id"])
    rated = relate(pairs)
    own = Window.partitionBy("draft_id", "claim_id")
    bad = F.col("relation") == "CONTRADICTS"
    ranked = rated.withColumns({"_bad": F.count_if(bad).over(own), "_n": F.row_number().over(own.orderBy(bad, F.desc("similarity"), "evidence_id"))})
    kept = ranked.where(bad | (F.col("_n") <= F.greatest(F.lit(0), most - F.col("_bad"))))
    return kept.select("draft_id", "claim_id", "evidence_id", "relation", "strength", "origin", F.bround("similarity", 6).alias("similarity"), ids.link_id(F.col("claim_id"), F.col("evidence_id"), F.col("relation")).alias("link_id"))


def orphans(link: DataFrame, claim: DataFrame, excerpt: DataFrame) -> DataFrame:
    """Links that point at nothing: there must be none."""
    return link.join(claim.select("claim_id").distinct(), "claim_id", "left_anti").unionByName(link.join(excerpt.select("evidence_id").distinct(), "evidence_id", "left_anti"))


def statuses(claim: DataFrame, link: DataFrame) -> DataFrame:
    """Claims with status and supporting origins: a contradiction wins, mentions alone verify nothing, no link is no support."""
    has = lambda r: F.bool_or(F.col("relation") == r)
    supports = F.col("relation").isin("SUPPORTS", "PARTIALLY_SUPPORTS")
    by = link.groupBy("draft_id", "claim_id").agg(has("CONTRADICTS").alias("_c"), has("SUPPORTS").alias("_s"), has("PARTIALLY_SUPPORTS").alias("_p"), F.count_distinct(F.when(supports, F.col("origin"))).alias("origins"))
    status = F.when(F.col("_c").isNull(), "UNSUPPORTED").when(F.col("_c"), "CONFLICTING").when(F.col("_s"), "SUPPORTED").when(F.col("_p"), "PARTIALLY_SUPPORTED").otherwise("UNVERIFIED")
    return claim.join(by, ["draft_id", "claim_id"], "left").withColumn("status", status).withColumn("origins", F.coalesce("origins", F.lit(0))).drop("_c", "_s", "_p")


def incompatible(kind: Column, left: Column, right: Column) -> Column:
    return F.when(left == right, False).when(kind.isin("DATE", "RELEASE"), values.dates_conflict(left, right)).when(kind == "NUMBER", values.numbers_conflict(left, right)).otherwise(True)


def conflicts(claim: DataFrame, link: DataFrame, excerpt: DataFrame) -> DataFrame:
    """Claims of one subject and predicate with incompatible values, and claims that an excerpt contradicts; one row for each identity."""
    m = claim.where("is_material")
    usable = m.where("value <> '' and normalized_subject <> '' and predicate <> ''").select("draft_id", "claim_type", "normalized_subject", "predicate", "claim_id", "value")
    key = ["draft_id", "claim_type", "normalized_subject", "predicate"]
    other = usable.withColumnsRenamed({"claim_id": "other_id", "value": "other_value"})
    pairs = usable.join(other, key).where(F.col("claim_id") < F.col("other_id")).where(incompatible(F.col("claim_type"), F.col("value"), F.col("other_value")))
    kind = F.concat(F.col("claim_type"), F.lit("_CONFLICT"))
    two = pairs.select("draft_id", kind.alias("conflict_type"), F.col("normalized_subject").alias("subject"), F.array("value", "other_value").alias("values"), F.array("claim_id", "other_id").alias("claim_ids"))
    said = link.where("relation = 'CONTRADICTS'").join(excerpt.select("draft_id", "evidence_id", "excerpt", "normalized_excerpt"), ["draft_id", "evidence_id"]).join(m.select("draft_id", "claim_id", "claim_type", "value", "display_text", "normalized_subject"), ["draft_id", "claim_id"])
    theirs = F.when(F.col("claim_type").isin("DATE", "RELEASE"), values.normal_date(F.col("excerpt"))).when(F.col("claim_type") == "NUMBER", values.normal_number(F.col("excerpt"))).otherwise(F.left("normalized_excerpt", F.lit(80)))
    own = F.coalesce(F.when(F.col("value") != "", F.col("value")), F.col("display_text"))
    one = said.groupBy("draft_id", "claim_id", "claim_type", "normalized_subject", own.alias("own")).agg(F.array_sort(F.collect_list(F.nullif(theirs, F.lit("")))).alias("theirs"))
    one = one.select("draft_id", kind.alias("conflict_type"), F.col("normalized_subject").alias("subject"), F.concat(F.array("own"), "theirs").alias("values"), F.array("claim_id").alias("claim_ids"))
    every = two.unionByName(one).withColumn("conflict_id", ids.conflict_id(F.col("conflict_type"), F.col("subject"), F.col("values"), F.col("claim_ids")))
    # In as many tasks as a shuffle has: pairs are many more than claims, and a table of distinct ones below the join would hold what few tasks make of all claims.
    tasks = int(claim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(tasks, "draft_id", "conflict_id").dropDuplicates(["draft_id", "conflict_id"])


def coverage(claim: DataFrame, minimum: float = 0.75) -> DataFrame:
    """One row for each draft with material claims: counts by status, the ratio (half for partial support) and whether a person must look."""
    n = lambda s: F.count_if(F.col("is_material") & (F.col("status") == s))
    g = claim.groupBy("draft_id").agg(
        F.count_if("is_material").alias("material"), n("SUPPORTED").alias("supported"), n("PARTIALLY_SUPPORTED").alias("partially_supported"), n("UNSUPPORTED").alias("unsupported"),
        n("CONFLICTING").alias("conflicting"), n("UNVERIFIED").alias("unverified"),
        F.count_if(F.col("is_material") & (F.col("status") == "UNSUPPORTED") & F.arrays_overlap("locations", F.array(*[F.lit(x) for x in CRITICAL_LOCATIONS]))).alias("critical_unsupported") if "locations" in claim.columns else F.lit(0).alias("critical_unsupported"),
    )
    ratio = F.when(F.col("material") > 0, F.bround((F.col("supported") + 0.5 * F.col("partially_supported")) / F.col("material"), 6)).otherwise(0.0)
    review = (F.col("material") == 0) | (ratio < minimum) | (F.col("unsupported") + F.col("conflicting") + F.col("unverified") > 0)
    return g.withColumn("coverage_ratio", ratio).withColumn("review_required", review)


def assess(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """Factual numbers of each draft, as the gate reads them."""
    c, e = claims(drafts), evidence(sources)
    k = links(c, e)
    with_status = statuses(c, k)
    cov = coverage(with_status)
    clash = conflicts(with_status, k, e).groupBy("draft_id").agg(F.count("*").alias("conflicts"), F.count_if(F.col("conflict_type").isin("DATE_CONFLICT", "NUMBER_CONFLICT", "STATUS_CONFLICT", "RELEASE_CONFLICT", "AVAILABILITY_CONFLICT")).alias("critical_conflicts"))
    support = k.groupBy("draft_id").agg(F.count_if(F.col("relation").isin("SUPPORTS", "PARTIALLY_SUPPORTS")).alias("supporting_links"))
    origins = e.groupBy("draft_id").agg(F.count_distinct("origin").alias("origins"))
    out = drafts.select("draft_id").join(cov, "draft_id", "left").join(clash, "draft_id", "left").join(support, "draft_id", "left").join(origins, "draft_id", "left")
    return out.na.fill(0)
