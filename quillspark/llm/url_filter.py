"""URL verdicts: longest rule for a host and path, else the reputation of the host by empirical Bayes.

Labelled pages give each host a number of outcomes and of bad ones. Rates are shrunk level by level: the suffix
towards the mean of all pages, the registered domain towards its suffix, the host towards its domain. How strongly is
estimated from the data at each level: the beta-binomial prior's strength is the moment estimate over that level's
members (how much more their bad counts vary than chance alone would let them). A host is blocked when the lower
bound of its posterior rate of bad pages lies above the limit, so hosts with few labels are never blocked on
their own account, but may inherit their domain's name.

Everything is done by host: pages are counted by host first, rules and reputations meet the distinct hosts by their
dot-separated endings (dealt over salts, since most hosts end alike), and what is known of a host is joined back to
its pages. A host with more than a thousandth of all pages is cut into pieces for that; only the list of such hosts,
of which there are fewer than a thousand, is broadcast.

Edge cases: a null url or one without :// has an empty host and path, no rule fits it, and it is allowed; hosts
without labels have their domain's posterior, or their suffix's, or the prior mean; equal rules of
different verdicts block; null rules and outcomes are ignored; repeated rows get a verdict each;
empty tables of pages, rules or outcomes are served; further columns of pages with other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

#: Endings under which names are registered one label deeper. A parameter; this much covers the most used ones.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.ar", "com.mx", "co.in", "co.za", "co.kr", "com.cn", "com.tw", "com.tr")

#: A host with more than one page in so many is hot: its pages are dealt to pieces. There are fewer hot hosts than this.
HOT = 1000
#: Copies of what is known by name, over which hosts with a common ending are dealt.
SALTS = 16


def split(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z in lower case) and path of a URL; both empty without ://."""
    parts = lambda group: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.translate(parts(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), parts(2)


def endings(host: Column) -> Column:
    """The host and everything that is left of it when labels are taken from the front."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def suffix(host: Column, deeper: tuple[str, ...] = SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*deeper), last).otherwise(F.substring_index(host, ".", -1))


def domain(host: Column, deeper: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    return F.when(F.substring_index(host, ".", -2).isin(*deeper), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


#: Least and greatest share of variance between members that a moment estimate may give; the strength is 1 / rho - 1,
#: so a prior weighs as much as 3 to 999 pages, and one bad page alone does not block a host.
RHO = (0.001, 0.25)


def strength(members: DataFrame) -> float:
    """Strength of a level's beta prior from (n, bad, mean): the moment estimate over members; one row comes home."""
    spread = F.col("mean") * (1 - F.col("mean"))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) - F.col("n") * spread)
    r = members.agg((over / F.sum(F.col("n") * (F.col("n") - 1) * spread)).alias("rho")).first()
    rho = RHO[0] if r["rho"] is None else min(max(r["rho"], RHO[0]), RHO[1])
    return 1 / rho - 1


def reputations(outcomes: DataFrame, z: float = 1.645, deeper: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, float]:
    """Posteriors (name, depth 3 host, 2 domain, 1 suffix, post, bound) from outcomes (host, n, bad), and the mean of all pages.

    `bound` lies z standard deviations below the posterior mean `post`.
    """
    real = outcomes.where("host <> '' and n > 0").withColumn("suffix", suffix(F.col("host"), deeper)).withColumn("domain", domain(F.col("host"), deeper))
    hosts = written(real.groupBy("suffix", "domain", F.col("host").alias("name")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "outcomes")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    # A half page of each kind, so that a mean is never 0 or 1.
    base = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    def level(members: DataFrame) -> DataFrame:
        """Posterior (name, post, bound) of members (name, n, bad, mean of the level above)."""
        m = strength(members)
        a, b = F.col("mean") * m + F.col("bad"), (1 - F.col("mean")) * m + F.col("n") - F.col("bad")
        mean = a / (a + b)
        bound = mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))
        return members.select("name", mean.alias("post"), bound.alias("bound"))

    suffixes = hosts.groupBy(F.col("suffix").alias("name")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(base))
    suffixes = written(level(suffixes), "suffixes")
    above = suffixes.select(F.col("name").alias("suffix"), F.col("post").alias("mean"))
    domains = hosts.groupBy("suffix", F.col("domain").alias("name")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(level(domains.join(above, "suffix")), "domains")
    above = domains.select(F.col("name").alias("domain"), F.col("post").alias("mean"))
    hosts = level(hosts.join(above, "domain"))
    named = [t.select("name", F.lit(depth).alias("depth"), "post", "bound") for depth, t in ((3, hosts), (2, domains), (1, suffixes))]
    return named[0].unionByName(named[1]).unionByName(named[2]), base


def judge(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, limit: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", deeper: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bad_bound) of every page.

    rules: (host, path, verdict allow or block); outcomes: (host, n labelled pages, bad of them). Of the rules that fit, the
    longest wins, then the one with the longer host, then block. bad_rate and bad_bound are the posterior of the host.
    """
    host, path = split(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    counts = written(named.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hosts = counts.withColumn("pieces", F.expr(f"cast(n * {HOT} div {max(total, 1)} + 1 as int)"))

    posteriors, base = reputations(outcomes, z, deeper)
    rank = F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("blocks"), "path", F.concat("host", "path").alias("rule"), "verdict")
    real = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    known = real.select(F.col("host").alias("name"), rank.alias("rule"), F.lit(None).cast("struct<depth int, post double, bound double>").alias("rate"))
    known = known.unionByName(posteriors.select("name", F.struct("depth", "post", "bound").alias("rate")), allowMissingColumns=True)
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ended = hosts.select("host", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(endings(F.col("host"))).alias("name"))
    own = F.expr("rate is null or name = case rate.depth when 3 then host when 2 then _domain else _suffix end")
    met = ended.withColumn("_domain", domain(F.col("host"), deeper)).withColumn("_suffix", suffix(F.col("host"), deeper)).where("host <> ''").join(salted, ["name", "salt"]).where(own)
    facts = met.groupBy("host").agg(F.collect_list("rule").alias("rules"), F.max("rate").alias("rate"))

    info = hosts.join(facts, "host", "left").withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).select("host", "piece", "rules", "rate")
    hot = hosts.where("pieces > 1").select("host", "pieces")
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = named.join(F.broadcast(hot), "host", "left").withColumn("piece", F.pmod(F.monotonically_increasing_id(), pieces).cast("int"))
    fits = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    rate, bound = F.coalesce("rate.post", F.lit(base)), F.coalesce("rate.bound", F.lit(0.0))
    by_rate = F.when(bound > limit, "block").otherwise("allow")
    out = dealt.join(info, ["host", "piece"]).withColumn("fit", fits)
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_rate).alias("verdict"),
        rate.alias("bad_rate"), bound.alias("bad_bound"),
    )


def outcomes_of_labels(pages: DataFrame, labels: DataFrame, number: str = r"^/[A-Za-z]+/([0-9]+)", url_col: str = "url") -> DataFrame:
    """(host, n, bad) from labels of documents (doc_id, quality, toxic) that pages show: the document's number stands in the path.

    A page is bad if its document is marked as of low quality or toxic. Labels of one document are taken together.
    """
    host, path = split(F.col(url_col))
    shown = pages.select(host.alias("host"), F.regexp_extract(path, number, 1).try_cast("long").alias("doc_id")).where("doc_id is not null")
    shown = shown.groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return shown.join(marks, "doc_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"))


def keep(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """Pages that are allowed, whole rows; verdicts depend on the url alone, so they are joined by url once each."""
    judged = judge(pages.select(F.col(url_col).alias("url"), F.col(url_col).alias("key")).distinct(), rules, outcomes, id_col="key", **options)
    return pages.join(judged.where("verdict = 'block'").select(F.col("key").alias(url_col)), url_col, "left_anti").select(*[f"`{c}`" for c in pages.columns])
