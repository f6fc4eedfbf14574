"""Link discovery and ranking. Links: from_url, pos, anchor_text, url."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

TOP_LINKS, TOP_FOLLOW_UP = 5, 2


def same_site_links(raw: DataFrame) -> DataFrame:
    """raw (from_url, pos, href, text, visible) -> links: resolved, http(s), on the site of from_url, the first of each URL.

    Invisible, empty, fragment, javascript, mailto and tel links go; null visible counts as visible.
    """
    href = T.collapse(F.coalesce("href", F.lit("")))
    kept = raw.where(F.coalesce("visible", F.lit(True)) & (href != "") & ~F.lower(href).rlike("^(?:#|javascript:|mailto:|tel:)"))
    url = T.strip_fragment(T.resolve(F.col("from_url"), href))
    links = kept.select("from_url", "pos", T.collapse(F.coalesce("text", F.lit(""))).alias("anchor_text"), url.alias("url"))
    links = links.where(T.is_http(F.col("url")) & (T.scope_key(F.col("from_url")) != "") & (T.scope_key(F.col("url")) == T.scope_key(F.col("from_url"))))
    first = F.row_number().over(W.partitionBy("from_url", "url").orderBy("pos"))
    return links.withColumn("rn", first).where("rn = 1").drop("rn")


def page_links(raw: DataFrame, captures: DataFrame) -> DataFrame:
    """raw anchors and captures (source_url, body_text) -> links: of each page the anchors, then the URLs in its text, each in its order; of equal
    URLs the first of both. pos counts from 0 over what is kept."""
    shown = captures.select(F.col("source_url").alias("from_url"), F.posexplode(T.text_urls(F.col("body_text"))).alias("pos", "href"))
    shown = shown.select("from_url", (F.col("pos") + F.lit(1 << 40)).alias("pos"), "href", F.col("href").alias("text"), F.lit(True).alias("visible"))
    both = raw.select("from_url", F.col("pos").cast("long").alias("pos"), "href", "text", "visible").unionByName(shown)
    return same_site_links(both).withColumn("pos", F.row_number().over(W.partitionBy("from_url").orderBy("pos")) - 1)


def with_words(links: DataFrame) -> DataFrame:
    """Adds a, u and both: anchor text, URL and the two in plain words."""
    return T.staged(links, {"a": T.plain_words(F.col("anchor_text")), "u": T.plain_words(F.col("url"))}, {"both": F.concat_ws(" ", T.filled(F.col("a")), T.filled(F.col("u")))})


def link_score() -> Column:
    """Over the columns of with_words."""
    a, u, both = F.col("a"), F.col("u"), F.col("both")
    has = lambda patterns: T.says(both, patterns)
    admissions, decision, fees, english, faq = map(has, (V.TOPIC_ADMISSIONS, V.TOPIC_DECISION, V.TOPIC_FEES, V.TOPIC_ENGLISH, V.TOPIC_FAQ))
    topic = admissions | fees | english
    bonus = [(admissions & decision, 3), (fees, 3), (english, 2), (faq & topic, 1), (has([p for p, _ in V.LINK_NEGATIVE]) & ~topic, -2)]
    score = T.weighted(a, V.LINK_POSITIVE, 2) - T.weighted(a, V.LINK_NEGATIVE, 2) + T.weighted(u, V.LINK_POSITIVE) - T.weighted(u, V.LINK_NEGATIVE)
    return reduce(lambda s, b: s + F.when(b[0], b[1]).otherwise(0), bonus, score)


def with_follow_up_score(links: DataFrame, missing: Column) -> DataFrame:
    """Adds score. missing: array of field names. 0 unless a pattern of a missing field, or of FAQs, is there."""
    a, u, both = F.col("a"), F.col("u"), F.col("both")
    found = T.says(both, [p for p, _ in V.FOLLOW_UP_SHARED])
    score = T.weighted(a, V.FOLLOW_UP_SHARED, 2) + T.weighted(u, V.FOLLOW_UP_SHARED)
    parts = {}
    for field, patterns in V.FOLLOW_UP.items():
        parts[f"w_{field}"] = F.when(F.array_contains(missing, field), F.when(T.says(both, [p for p, _ in patterns]), T.weighted(a, patterns, 2) + T.weighted(u, patterns)).otherwise(-1)).otherwise(-1)
        found = found | (F.col(f"w_{field}") >= 0)
        score = score + F.greatest(F.col(f"w_{field}"), F.lit(0))
    parts["general"] = F.least(F.greatest(link_score(), F.lit(0)), F.lit(6))
    parts["bad"] = T.weighted(a, V.LINK_NEGATIVE, 2) + T.weighted(u, V.LINK_NEGATIVE)
    out = T.staged(with_words(links), parts, {"score": F.when(found, score + F.col("general") - F.col("bad")).otherwise(0)})
    return out.drop("a", "u", "both", *parts)


def rank_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.length("url"), F.col("url"), F.lower("anchor_text")]


def _ranked(scored: DataFrame, by: str, k: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*rank_order(), "pos")))
    return ranked.withColumn("selected", (F.col("score") > 0) & (F.col("rank") <= k))


def rank_links(links: DataFrame, by: str = "from_url", k: int = TOP_LINKS) -> DataFrame:
    """links with score, rank and selected (the k best with a positive score of each source). Links are dealt out before they are
    scored, as their files may be few; the ranks keep to the same key."""
    return _ranked(with_words(links.repartition(by)).withColumn("score", link_score()).drop("a", "u", "both"), by, k)


def rank_follow_up(links: DataFrame, missing: Column, by: str = "from_url", k: int = TOP_FOLLOW_UP) -> DataFrame:
    return _ranked(with_follow_up_score(links.repartition(by), missing), by, k)
