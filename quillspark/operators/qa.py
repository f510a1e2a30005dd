"""Checks of titles and texts: points, penalties and lists of findings, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import any_of, fold, squeeze

#: Sequences of phrases that must all occur, then single phrases; the first that is found names the finding.
CTA_SEQUENCES = (
    ("thank you for reading", "subscribe"), ("thank you for reading this post", "subscribe"), ("thank you for reading this article", "subscribe"), ("thanks for reading", "subscribe"),
    ("thanks for visiting", "subscribe"), ("thank you for visiting", "subscribe"), ("obrigado por ler", "inscreva"), ("obrigada por ler", "inscreva"),
)
CTA_PHRASES = (
    "thank you for reading this post don t forget to subscribe", "thank you for reading don t forget to subscribe", "thanks for reading don t forget to subscribe", "please subscribe", "subscribe now", "subscribe to our",
    "don t forget to subscribe", "dont forget to subscribe", "thanks for reading", "thank you for reading", "obrigado por ler", "obrigada por ler", "nao esqueca de se inscrever", "nao deixe de se inscrever",
    "se inscreva", "inscreva se", "cadastre se", "stay tuned", "follow us",
)
ACTION_VERBS = (
    "anuncia", "lança", "critica", "vence", "fecha", "retorna", "cancela", "adia", "confirma", "nega", "revela", "descobre", "desenvolve", "cria", "assina", "acusa", "investiga", "aprova", "rejeita", "promete", "ameaça", "realiza",
    "completa", "inaugura", "publica", "exibe", "produz", "dirige", "estreia", "arrecada", "conquista", "bate", "muda", "transforma", "rompe", "estabelece", "garante", "expõe", "convida", "proíbe", "libera", "quebra",
)
VAGUE_WORDS = ("pode", "talvez", "alguns", "muitos", "diz-se", "parece", "supostamente", "provavelmente", "possivelmente", "alegadamente", "aparentemente", "segundo relatos", "rumores", "boatos")
STOP_WORDS = ("o", "a", "um", "uma", "de", "do", "da", "em", "e", "é", "por", "para", "com", "sem", "se", "não", "mas", "ou", "quando", "onde", "como", "que")
ENTITIES = {"&#8216;": "'", "&#8217;": "'", "&#8220;": '"', "&#8221;": '"', "&#8211;": "-", "&#8212;": "-", "&quot;": '"', "&apos;": "'", "&mdash;": "-", "&ndash;": "-"}
CLICKBAIT = ("Você não vai acreditar", "Você precisa ver", "Isto é incrível", "Não sabíamos sobre", "Ninguém esperava", "O que aconteceu foi", "Prepare-se para")
GENERIC_H2 = (
    "impacto e recepção da obra", "a visão original", "o futuro da franquia", "expectativas para a nova temporada", "desenvolvimento da trama", "o que esperar", "detalhes da produção", "uma nova fase", "tudo sobre a novidade",
    "o impacto da decisão",
)
LEADS = r"(?iu)^(A franquia|A produção|Os fãs|O universo de|A obra|O título chega|A novidade|Em uma revelação|A espera)\b"
TOPIC_CATEGORY = {
    "movies": "Filmes", "filmes": "Filmes", "movie": "Filmes", "tv": "Séries", "series": "Séries", "séries": "Séries", "shows": "Séries", "news": "Notícias", "noticias": "Notícias", "notícias": "Notícias",
}
#: Title findings as (code, error?, pattern).
TITLE_RULES = (
    ("infinitive", False, r"(?iuU)\b(?:falar|dizer|contar|revelar|demonstrar|mostrar|deixar|fazer)\b"),
    ("agreement", True, r"(?iuU)\bos serie\b"),
    ("accent", True, r"(?iuU)\bgratis\b"),
    ("government", False, r"(?iuU)\bficou de lado\b"),
    ("sensational", True, r"(?iuU)\b(?:surpreendente|impressionante|explode|bomba|nerfado|morto|mata|matou)\b"),
    ("empty_term", False, r"(?iuU)\bsucesso\s+surpreendentes?\b"),
    ("question", False, r"\?\s*$"),
    ("two_colons", True, ":[^:]*:"),
    ("weak_phrase", True, r"(?iuU)\b(?:veja|entenda|descubra|saiba)\b"),
    ("platform_first", False, r"(?iuU)(?:Netflix|Disney|HBO|Prime|Paramount|Max)\s+(?:revela|anuncia|apresenta|libera)"),
    ("slang", False, r"(?iuU)\b(?:nerfado|nerf)\b"),
    ("repeated_marks", True, r"\?[^?]*\?|![^!]*!"),
    ("vague_count", False, r"(?iuU)\bvários\s+(?:filmes|séries|games|títulos)\b"),
)


def cta_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def cta(text: Column) -> Column:
    """The first forbidden call to action that a text holds, or NULL."""
    key = cta_key(text)
    both = [F.when(F.contains(key, F.lit(a)) & F.contains(key, F.lit(b)), F.lit(f"{a} + {b}")) for a, b in CTA_SEQUENCES]
    return F.coalesce(*both, *[F.when(F.contains(key, F.lit(p)), F.lit(p)) for p in CTA_PHRASES])


def title_findings(title: Column) -> Column:
    """struct(errors, warnings, status) of a title. The error for length is below 30 characters."""
    upper = F.length(F.regexp_replace(title, r"[^\p{Lu}]", ""))
    more = [("too_short", True, F.length(title) < 30), ("too_long", False, F.length(title) > 65), ("capitals", False, upper > 0.3 * F.length(title))]
    every = [*more, *[(code, bad, title.rlike(p)) for code, bad, p in TITLE_RULES]]
    pick = lambda want: F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, bad, cond in every if bad == want]))
    errors, warnings = pick(True), pick(False)
    return F.struct(errors.alias("errors"), warnings.alias("warnings"), F.when(F.size(errors) > 0, "ERRO").when(F.size(warnings) > 0, "AVISO").otherwise("VÁLIDO").alias("status"))


def corrected_title(title: Column) -> Column:
    for pattern, put in ((r"\bgratis\b", "de graça"), (r"\bvários\b", "múltiplos"), (r"\bsucesso surpreendente\b", "sucesso"), (r"\bexplode nas redes\b", "viralizando"), (r"\b(?:nerfado|nerf)\b", "ajustado")):
        title = F.regexp_replace(title, f"(?iuU){pattern}", put)
    return squeeze(title)


def clean_entities(title: Column) -> Column:
    for entity, sign in ENTITIES.items():
        title = F.replace(title, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(title, r"&#\d+;", ""), "&[a-z]+;", "")


def without_clickbait(title: Column) -> Column:
    for start in CLICKBAIT:
        title = F.regexp_replace(title, f"(?iu)^{start}", "")
    return F.trim(title)


def keyword(title: Column) -> Column:
    """The first word of three letters or more that is no stop word."""
    bare = F.transform(F.split(F.lower(title), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    return F.get(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)), F.lit(0))


def title_score(title: Column) -> Column:
    """0 to 100: penalties for length, late keyword, no verb, vague words, entities, clickbait and capitals; points for numbers and structure."""
    t = F.trim(title)
    n, lower = F.length(t), F.lower(title)
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    early = F.exists(F.slice(words, 1, 5), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))
    verb = any_of(lower, ACTION_VERBS)
    less = lambda cond, k: F.when(cond, k).otherwise(0)
    score = (
        F.lit(100)
        - F.when(n < 40, 15).when(n < 50, 5).when(n > 100, 15).when(n > 70, 3).otherwise(0)
        - less(~early & (F.size(words) > 5), 10)
        - less(~verb, 5)
        - less(any_of(lower, VAGUE_WORDS), 10)
        - less(any_of(title, tuple(ENTITIES)), 10)
        - less(title.rlike("(?iu)Você (não|precisa|não vai acreditar)"), 15)
        - less((title == F.upper(title)) & (title != lower) & (F.length(title) > 5), 5)
        + less(title.rlike(r"\d{4}|\d+%|US\$"), 5)
        + less(verb & early, 5)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def style(title: Column, html: Column, had_quotes: Column, vague: tuple[str, ...] = ()) -> Column:
    """Counts of stylistic findings in a text."""
    plain = squeeze(F.regexp_replace(html, "<[^>]+>", " "))
    heads = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h2\b[^>]*>(.*?)</h2>"), F.lit(1)), lambda h: F.lower(squeeze(F.regexp_replace(h, "<[^>]+>", " "))))
    lead = squeeze(F.regexp_replace(F.regexp_extract(html, r"(?is)<p\b[^>]*>(.*?)</p>", 1), "<[^>]+>", " "))
    words = F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
    count = lambda p: F.regexp_count(html, F.lit(f"(?iu)\\Q{p}\\E"))
    return F.struct(
        sum((count(p) for p in vague), F.lit(0)).alias("vague_phrases"),
        F.size(F.filter(heads, lambda h: h.isin(*GENERIC_H2))).alias("generic_h2"),
        lead.rlike(LEADS).cast("int").alias("suspicious_lead"),
        (had_quotes & ~html.rlike("[\"“”„]")).cast("int").alias("missing_quotes"),
        ((words > 400) & (F.size(heads) == 0)).cast("int").alias("missing_h2"),
    )


def length_points(words: Column, low: Column, target: Column) -> Column:
    """Points for length against the policy: 30 from the target on, a share of it from 25 above the minimum, less below."""
    near = F.greatest(F.lit(25), F.least(F.lit(30), F.bround(30 * words / F.when(target > 0, target)).cast("int")))
    return F.when(words >= target, 30).when(words >= low, near).otherwise(F.least(F.lit(24), F.bround(25 * words / F.when(low > 0, low)).cast("int")))


def category(topic: Column, suggestions: Column, allowed: tuple[str, ...] = ("Filmes", "Séries", "Notícias")) -> Column:
    """A suggestion that is a category already, else the topic's category, else NULL."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    named = F.transform(F.coalesce(suggestions, F.array().cast("array<string>")), lambda s: F.element_at(table({a.lower(): a for a in allowed}), F.lower(squeeze(s))))
    mapped = F.element_at(table(TOPIC_CATEGORY), F.lower(squeeze(topic)))
    return F.coalesce(F.get(F.array_compact(named), F.lit(0)), F.when(mapped.isin(*allowed), mapped))


def entity_kind(entity: Column) -> Column:
    studio = any_of(F.lower(entity), ("bros", "studios", "pictures", "universe", "netflix", "video", "disney", "max", "warner", "marvel", "sony", "paramount", "universal", "dc"))
    return (
        F.when(entity.rlike("^(19|20)[0-9]{2}$"), "data")
        .when(studio, "estudio")
        .when(F.contains(entity, F.lit(":")) | entity.rlike("['’]"), "obra")
        .when(F.size(F.split(F.trim(entity), r"\s+")) >= 2, "pessoa")
        .otherwise("entidade")
    )


def nearest_entity(candidates: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """candidates (scope, name) against known (scope, canonical) -> (scope, name, canonical, distance, action).

    Names meet on scope, number of words and first letter, so the comparison never is a product; of equally near ones the first by
    spelling. One or two edits are corrected, three or four are a warning.
    """
    shape = lambda c: [F.size(F.split(c, " ")).alias("_words"), F.left(fold(c), F.lit(1)).alias("_first")]
    a = candidates.select(*scope, "name", *shape(F.col("name"))).distinct()
    b = known.select(*scope, "canonical", *shape(F.col("canonical"))).distinct()
    near = a.join(b, [*scope, "_words", "_first"]).where(F.abs(F.length("name") - F.length("canonical")) <= 2)
    rated = near.withColumn("distance", F.levenshtein(fold(F.col("name")), fold(F.col("canonical"))))
    best = rated.withColumn("_n", F.row_number().over(Window.partitionBy(*scope, "name").orderBy("distance", "canonical"))).where("_n = 1")
    action = F.when(F.col("distance") == 0, "SAME").when(F.col("distance") <= 2, "FIX").when(F.col("distance") <= 4, "WARN").otherwise("NONE")
    return best.select(*scope, "name", "canonical", "distance", action.alias("action"))


def internal_links(articles: DataFrame, links: DataFrame, stopwords: list[str], most: int = 6) -> DataFrame:
    """articles (id, text) against links (url, title, keywords text): best `most` by shared words, then title. Meets on words."""
    from quillspark.functions.text import link_tokens

    a = articles.select("id", F.explode(link_tokens(F.col("text"), stopwords)).alias("word"))
    b = links.select("url", "title", F.explode(link_tokens(F.concat_ws(" ", "title", "keywords"), stopwords)).alias("word"))
    scored = a.join(b, "word").groupBy("id", "url", "title").agg(F.count("*").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "title", "url"))).where(F.col("rank") <= most)
