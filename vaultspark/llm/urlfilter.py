"""URL filtering by rules and empirical-Bayes host reputation, with DataFrame functions only.

Reputation. Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and public suffix. Each
level shrinks its success rate to that of the level above with the strength of a beta-binomial prior, which the
method of moments takes from the spread of the level's own groups: suffixes shrink to the overall rate, domains to
their suffix, hosts to their domain. A host's posterior is a beta distribution; a page is blocked if the upper bound
mean + z * sd of its host's posterior lies below `floor`: only hosts that are surely bad go, unknown ones stay.

Rules. A rule is (verdict, "host/path"). It fits its host and all subdomains where the url's path starts with its
path; the longest fitting rule wins (of equal length: the one with the longer host, then the first in order). A url
that a rule fits gets the rule's verdict, others the reputation's. At most RULE_LIMIT rules make one expression; more
are a table that is joined to the suffixes of the different hosts.

Counts are summed before they are shuffled; host tables are joined by the engine's own choice of strategy (they are
broadcast only below its size threshold), and only one-row tables of prior strengths are broadcast always.

Defined cases: null urls and such without "://" have an empty host and path and count as one host; pages without
outcome count nowhere; null outcomes count as none; repeated rows count each; with no outcomes at all the rate is one
half with the weakest prior, and nothing is blocked; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public suffixes of two labels that are told apart; others are the last label. A parameter of every function.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "co.nz", "co.in", "co.za", "com.mx", "com.cn")
FLOOR, Z = 0.5, 1.6448536269514722
#: The least and the most strength of a prior, in outcomes.
STRENGTHS = (1.0, 1000.0)
RULE_LIMIT = 500

LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(url.isNull() | (at == 0), "").otherwise(host)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(url.isNull() | (at == 0), "").otherwise(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def suffix_and_domain(host: Column, long_suffixes=LONG_SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain of a host, without port and user; addresses stay whole."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    whole = (F.size(labels) < 2) | bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.when(two.isin(*long_suffixes), 2).otherwise(1)
    suffix = F.when(whole, bare).otherwise(F.array_join(F.slice(labels, -n, n), "."))
    depth = F.least(n + 1, F.size(labels))
    domain = F.when(whole, bare).otherwise(F.array_join(F.slice(labels, -depth, depth), "."))
    return suffix, domain


def _ordered(rules) -> list[tuple[str, str]]:
    """Rules by how they win: the longest first, of these the one with the longer host."""
    return sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The winning rule and its verdict, or nulls."""
    order = _ordered(rules)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in reversed(order):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def rules_joined(split: DataFrame, rules) -> DataFrame:
    """(host, path, rule, verdict) of the different hosts and paths that a rule fits; for any number of rules."""
    rows = [(r[1].partition("/")[0], i, "".join(r[1].partition("/")[1:]), r[1], r[0]) for i, r in enumerate(_ordered(rules))]
    table = split.sparkSession.createDataFrame(rows, "name string, place int, start string, rule string, says string")
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = split.select("host", "path").distinct().withColumn("name", F.explode(names)).join(table, "name").filter(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("place", "rule", "says")).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.says").alias("verdict"))


def strength(groups: DataFrame, least: float = STRENGTHS[0], most: float = STRENGTHS[1]) -> DataFrame:
    """One row: the prior strength that the spread of groups (n, s) shows, by the method of moments."""
    t = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("N"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("S"), F.count(F.lit(1)).cast("double").alias("G"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("N2"), F.coalesce(F.sum((F.col("s") * F.col("s")) / F.col("n")), F.lit(0.0)).alias("Q"))
    p = F.col("S") / F.col("N")
    spread = F.col("Q") - F.col("S") * F.col("S") / F.col("N")
    v = p * (1 - p)
    below = v * (F.col("N") - F.col("N2") / F.col("N") - (F.col("G") - 1))
    rho = (spread - v * (F.col("G") - 1)) / below
    k = F.when((F.col("N") <= 0) | (F.col("G") < 2), least).when((v <= 0) | (below <= 0) | (rho <= 0), most).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), 1 / rho - 1)))
    return t.select(k.alias("k"))


def reputations(outcomes: DataFrame, *, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """Per host with outcomes: suffix, domain, host, n, s, and the posterior's a and b. outcomes: host, good (1, 0)."""
    good = F.when(F.col("good").isNotNull(), (F.col("good") > 0).cast("long"))
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("s"))
    suffix, domain = suffix_and_domain(F.col("host"), long_suffixes)
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain)


def _shrunk(level: DataFrame, above: DataFrame | None, keys: list[str], prior: DataFrame) -> DataFrame:
    """Adds the posterior mean of a level, shrunk to `m` of the level above."""
    joined = level.join(above, keys) if keys else level.crossJoin(F.broadcast(above))  # above is one row there
    return joined.crossJoin(F.broadcast(prior)).withColumn("m", (F.col("s") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k")))


def posteriors(pages: DataFrame, outcomes: DataFrame, *, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """Per host of pages (column host): mean and sd of its posterior. outcomes: host, good."""
    hosts = reputations(outcomes, long_suffixes=long_suffixes)
    add = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    domains = hosts.groupBy("suffix", "domain").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    total = hosts.agg(((F.coalesce(F.sum("s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    k = {name: strength(df) for name, df in zip(LEVELS, (suffixes, domains, hosts))}
    by_suffix = _shrunk(suffixes, total, [], k["suffix"]).select("suffix", F.col("m").alias("ms"))
    by_domain = domains.join(by_suffix, "suffix").crossJoin(F.broadcast(k["domain"])).select("domain", ((F.col("s") + F.col("k") * F.col("ms")) / (F.col("n") + F.col("k"))).alias("md"))

    suffix, domain = suffix_and_domain(F.col("host"), long_suffixes)
    seen = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("suffix", suffix).withColumn("domain", domain)
    known = seen.join(hosts.select("host", "n", "s"), "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left")
    known = known.crossJoin(F.broadcast(total.withColumnRenamed("m", "m0"))).crossJoin(F.broadcast(k["host"]))
    prior = F.coalesce("md", "ms", "m0")
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))
    a, b = s + F.col("k") * prior, n - s + F.col("k") * (1 - prior)
    mean = a / (a + b)
    return known.select("host", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (a + b + 1)).alias("sd"), n.alias("n"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=(), *, key: str = "page_id", url: str = "url", floor: float = FLOOR, z: float = Z, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """Per page: key, host, path, rule, verdict and upper (the posterior's upper bound). outcomes: key, good."""
    split = pages.select(F.col(key).alias("k_"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    told = outcomes.select(F.col(key).alias("k_"), "good").filter(F.col("good").isNotNull())
    labelled = split.select("k_", "host").join(told, "k_").select("host", "good")
    hosts = posteriors(split, labelled, long_suffixes=long_suffixes)
    upper = F.col("mean") + F.lit(z) * F.col("sd")
    if len(rules) > RULE_LIMIT:
        split = split.join(rules_joined(split, rules), ["host", "path"], "left")
        rule, verdict = F.col("rule"), F.col("verdict")
    else:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(upper < F.lit(floor), "block").otherwise("allow")
    return split.join(hosts, "host", "left").select(F.col("k_").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), upper.alias("upper"))
