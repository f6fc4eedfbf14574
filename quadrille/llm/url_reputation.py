"""URL filters: rules first, then empirical-Bayes host reputation from labelled outcomes.

Outcomes (bad or not) of labelled pages are counted by host, registered domain and suffix. The
rate of every level is shrunk towards that of the level above: a beta prior with the mean of the
parent's posterior and a strength estimated from how much rates differ between units of a level
(method of moments over all units). A page is blocked if the lower bound of its host's posterior
badness reaches the limit. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a two-letter country label with a short second level."""
    long = host.rlike(r"\.(co|com|org|net|gov|edu|ac)\.[a-z]{2}$")
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """rules (verdict, host/path) -> columns rule and verdict of the longest that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame, mean: str) -> float:
    """Method of moments for the prior strength a + b of rates around their prior means."""
    n, rate, m = F.col("n"), F.col("bad") / F.col("n"), F.col(mean)
    got = units.where("n >= 2").agg(
        F.sum(n * (rate - m) ** 2).alias("between"), F.sum(m * (1 - m)).alias("within"), F.sum(n * m * (1 - m)).alias("scale"), F.count("*").alias("k")
    ).first()
    if not got["k"] or not got["scale"]:
        return 2.0
    excess = max(got["between"] - got["within"], 0.0) / got["scale"]
    return min(1000.0, max(1.0, (1 - excess) / excess if excess > 1e-3 else 1000.0))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes (host, bad 0/1) -> (level host/domain/suffix, key, n, bad, a, b) with posterior beta parameters."""
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": F.substring_index("host", ".", -1)})
    up = lambda df, key, *more: df.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)

    def posterior(df, prior):
        df = df.withColumn("m", prior)
        k = _strength(df, "m")
        return df.withColumns({"a": F.col("m") * k + F.col("bad"), "b": (1 - F.col("m")) * k + F.col("n") - F.col("bad")})

    suffixes = posterior(suffixes, F.lit(float(mean)))
    above = lambda df, key: df.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("p"))
    domains = posterior(domains.join(above(suffixes, "suffix"), "suffix"), F.col("p"))
    hosts = posterior(hosts.join(above(domains, "domain"), "domain"), F.col("p"))
    pick = lambda df, key: df.select(F.lit(key).alias("level"), F.col(key).alias("key"), "n", "bad", "a", "b")
    overall = hosts.sparkSession.createDataFrame([("all", "", int(total["n"] or 0), int(total["bad"] or 0), float(mean * 2), float((1 - mean) * 2))], "level string, key string, n long, bad long, a double, b double")
    return pick(hosts, "host").union(pick(domains, "domain")).union(pick(suffixes, "suffix")).union(overall)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages (page_id, url) -> (page_id, host, path, rule, verdict, bad_low, level), one row for each page.

    rules: (allow or block, host/path); the longest that fits decides. Else the page is judged by
    the most specific level with labelled outcomes: blocked if mean - z * deviation of the
    posterior badness is at least limit. outcomes (host, bad) default to the pages that a rule
    decides, which are the labelled ones. A null url or one without :// has an empty host and
    path, no rule, and the overall prior's verdict. Repeated pages stay; other columns are not
    looked at; an empty table gives an empty table.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if outcomes is None:
        outcomes = rows.where("ruled is not null").select("host", (F.col("ruled") == "block").cast("int").alias("bad"))
    reputation = host_reputation(outcomes)
    a, b = F.col("a"), F.col("b")
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    bounds = reputation.select("level", "key", low.alias("low"))
    # distinct hosts carry the bounds, so that a hot host is looked up once
    hosts = rows.select("host").distinct().withColumns({"domain": registered_domain(F.col("host")), "suffix": F.substring_index("host", ".", -1)})
    for level in ("host", "domain", "suffix"):
        found = bounds.where(F.col("level") == level).select(F.col("key").alias(level), F.col("low").alias(f"{level}_low"))
        hosts = hosts.join(found, level, "left")
    overall = bounds.where("level = 'all'").first()["low"]
    hosts = hosts.select(
        "host",
        F.coalesce("host_low", "domain_low", "suffix_low", F.lit(overall)).alias("bad_low"),
        F.when(F.col("host_low").isNotNull(), "host").when(F.col("domain_low").isNotNull(), "domain").when(F.col("suffix_low").isNotNull(), "suffix").otherwise("all").alias("level"),
    )
    out = rows.join(hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad_low") >= limit, "block").otherwise("allow")).alias("verdict"), "bad_low", "level")
