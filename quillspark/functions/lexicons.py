"""Word lists that results depend on."""

from __future__ import annotations

TRUSTED_SINGLE_SOURCES = ("deadline.com", "variety.com", "hollywoodreporter.com", "ign.com", "gamespot.com", "polygon.com", "marvel.com", "dc.com", "nintendo.com", "playstation.com", "xbox.com", "steam")
LIVE_SIGNALS = ("/ao-vivo/", "aovivo.", "/live/", "/tempo-real/", "ao vivo")
OPINION_SIGNALS = ("/blog/", "/coluna/", "coluna-do-", "/opiniao/", "/opinião/", "opinião:")
MOJIBAKE = ("�", "\\ufffd", "S\\xefo", "D\\xf3lar", "j\\xe1", "ir\\xe3o", "Bras\\xedlia", "Sïo", "jï¿½", "irï¿½o", "Brasï¿½lia", "Ã£", "Ã¡", "Ã©", "Ã­", "Ã³", "Ãº", "Ã§")
PAYWALL_SIGNALS = ("assine", "assinante", "conteúdo exclusivo", "conteudo exclusivo", "para continuar lendo", "login", "entre ou cadastre-se", "paywall", "subscribe", "subscription", "já sou assinante", "ja sou assinante")
NAVIGATION_SIGNALS = ("publicidade", "mais lidas", "últimas:", "ultimas:", "assine", "entrar", "newsletter", "cookies")
ENTITIES = (
    "marvel", "avengers", "spider-man", "batman", "superman", "dc comics", "x-men", "thor", "iron man", "deadpool", "justice league", "flash", "aquaman", "pantera negra", "homem-aranha", "vingadores", "liga da justiça",
    "star wars", "the mandalorian", "andor", "ahsoka", "jedi", "guerra nas estrelas",
    "gta", "grand theft auto", "the witcher", "zelda", "elden ring", "call of duty", "god of war", "cyberpunk", "resident evil", "final fantasy", "hogwarts legacy", "mortal kombat", "assassin's creed", "red dead redemption",
    "game of thrones", "the last of us", "stranger things", "the boys", "house of the dragon", "wednesday", "euphoria", "succession", "the bear", "obi-wan kenobi", "loki",
    "harry potter", "senhor dos anéis", "indiana jones", "missão impossível", "john wick", "oppenheimer", "barbie", "duna", "dune", "avatar", "jurassic", "transformers", "velozes e furiosos",
    "one piece", "dragon ball", "naruto", "attack on titan", "demon slayer", "jujutsu kaisen", "my hero academia", "fullmetal alchemist", "death note", "bleach", "chainsaw man", "spy x family",
)
DEMAND_TAGS = ("trailer", "confirmado", "estreia", "temporada", "sequel", "remake", "reboot", "confirmed", "announced", "teaser", "data de lançamento", "lançamento", "renovado", "cancelado", "renewed", "cancelled", "release date")
DEPTH_WORDS = ("saga", "universe", "universo", "temporada", "season", "franquia", "franchise", "trilogy", "trilogia")

LIST_RE = r"(?iuU)\b(\d{1,2}\s*(melhores?|piores?|filmes?|s[eé]ries?|personagens?|motivos?|raz[oõ]es?|momentos?|coisas?|fatos?|cenas?|epis[oó]dios?|jogos?|quotes?|frases?|cita[cç][oõ]es?)|melhores?\s+\w+|piores?\s+\w+|ranking|lista\s+d[eo]|top\s+\d+|selecion[ao]|subestimad|esquecid|explicad|ordem\s+correto?|vale\s+assistir|val[ae]\s+a\s+pena|quotes?|frases?|cita[cç][oõ]es?)\b"
GUIDE_RE = r"(?iuU)\b(como\s+\w+|guia\b|entenda\s+|explica[cç][aã]o|ordem\s+cronol|cronologia|para\s+iniciante|passo\s+a\s+passo|tutorial)\b"
ANALYSIS_RE = r"(?iuU)\b(an[aá]lise|review|resenha|avalia[cç][aã]o|opini[aã]o|acredito\s+que|minha\s+vis[aã]o|coluna)\b"
NEWS_RE = r"(?iuU)\b(lan[cç]amento|atualiza[cç][aã]o|demiss[aã]o|declara[cç][aã]o|trailer|rumor|an[uú]ncio|data\s+de\s+lançamento|confirmado|confirma|revela|estreia|cancelado|renovado|estreia\s+em)\b"

NON_MATERIAL = (
    r"(?iuU)\b(clique|click)\s+(aqui|here)\b",
    r"(?iuU)\b(leia|veja|confira|saiba|assista)\s+(mais|tamb[eé]m|agora)\b",
    r"(?iuU)\b(read|see|watch|check)\s+(more|also|now)\b",
    r"(?iuU)\b(inscreva|subscribe|siga|follow us|newsletter)\b",
    r"(?iuU)\b(n[aã]o perca|don'?t miss|stay tuned)\b",
    r"(?iuU)\b(vale a pena|imperd[ií]vel|melhor de todos|obra[- ]prima)\b",
    r"(?iuU)\b(na minha opini[aã]o|acredito que|acho que|in my opinion)\b",
    r"(?iuU)\b(recomendamos|recomendo|we recommend)\b",
)
#: For each of these patterns, letters of which one run is in every text that it matches.
NON_MATERIAL_NEEDS = (
    ("clique", "click"), ("leia", "veja", "confira", "saiba", "assista"), ("read", "see", "watch", "check"), ("inscreva", "subscribe", "siga", "follow us", "newsletter"),
    ("perca", "miss", "stay tuned"), ("vale a pena", "imperd", "melhor de todos", "prima"), ("na minha opini", "acredito que", "acho que", "in my opinion"), ("recomend", "recommend"),
)
#: Term, claim type, predicate; the first term that a sentence holds decides.
STATUS_TERMS = (
    ("renovada", "STATUS", "renewed"), ("renovado", "STATUS", "renewed"), ("renewed", "STATUS", "renewed"),
    ("cancelada", "STATUS", "cancelled"), ("cancelado", "STATUS", "cancelled"), ("cancelled", "STATUS", "cancelled"), ("canceled", "STATUS", "cancelled"),
    ("confirmada", "STATUS", "confirmed"), ("confirmado", "STATUS", "confirmed"), ("confirmed", "STATUS", "confirmed"),
    ("adiada", "STATUS", "delayed"), ("adiado", "STATUS", "delayed"), ("delayed", "STATUS", "delayed"),
    ("estreia", "RELEASE", "releases"), ("estreou", "RELEASE", "released"), ("lancamento", "RELEASE", "releases"), ("premieres", "RELEASE", "releases"),
    ("disponivel", "AVAILABILITY", "available"), ("available", "AVAILABILITY", "available"), ("indisponivel", "AVAILABILITY", "unavailable"),
)
STATUS_SYNONYMS = {
    "renewed": ("renewed", "renovada", "renovado", "renovacao"),
    "cancelled": ("cancelled", "canceled", "cancelada", "cancelado", "cancelamento"),
    "confirmed": ("confirmed", "confirmada", "confirmado", "confirmou"),
    "delayed": ("delayed", "adiada", "adiado", "adiamento", "remarcada", "remarcado"),
    "released": ("released", "estreou", "lancado", "lancada"),
    "releases": ("releases", "estreia", "estreara", "lancamento", "premieres"),
    "available": ("available", "disponivel", "disponibilizada", "disponibilizado"),
    "unavailable": ("unavailable", "indisponivel", "removida", "removido"),
}
STATUS_OPPOSITES = {
    "renewed": ("cancelled", "canceled", "cancelada", "cancelado"),
    "cancelled": ("renewed", "renovada", "renovado"),
    "available": ("unavailable", "indisponivel", "removido", "retirado"),
    "unavailable": ("available", "disponivel"),
    "confirmed": ("desmentiu", "negou", "denied", "rumor"),
    "delayed": ("mantida", "mantido", "on schedule"),
}

#: Signs of the editorial type of an article.
TYPE_LIST_RE = r"(?iuU)\b(\d{1,2}\s*(melhores?|piores?|filmes?|s[eé]ries?|personagens?|motivos?|raz[oõ]es?|momentos?|coisas?|fatos?|cenas?|epis[oó]dios?)|melhores?\s+\w+|piores?\s+\w+|ranking|lista\s+d[eo]|top\s+\d+|selecion[ao]|subestimad|esquecid|explicad|ordem\s+correto?|vale\s+assistir|val[ae]\s+a\s+pena)\b"
TYPE_GUIDE_RE = r"(?iuU)\b(como\s+\w+|guia\b|entenda\s+|explica[cç][aã]o|ordem\s+cronol|cronologia|para\s+iniciante|passo\s+a\s+passo|tutorial)\b"
TYPE_REVIEW_RE = r"(?iuU)\b(an[aá]lise|review|resenha|avalia[cç][aã]o|nota\s+\d|\d\s*/\s*10|\d\.\d\s*/\s*10|estrelas?|pontua[cç][aã]o)\b"
TYPE_OPINION_RE = r"(?iuU)\b(opini[aã]o|acredito\s+que|eu\s+acho|minha\s+vis[aã]o|coluna|editorial|carta\s+ao\s+leitor)\b"
