"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations.

For every window of a test item the two terms that are rarest in the corpus are its key terms. The postings
(term, document, position) of all key terms in the training texts are stored as a table, the index. From the
rarest term on, its list is intersected with that of the second rarest by document and position: at the window's
own offset for exact phrases, within a distance for proximity. What is left is compared term by term with the
text around, which gives the exact run of equal terms; runs of a full window are hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stage, within

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of texts whose A-Z still stand
BROADCAST_ROWS = 200_000


def raw_terms(text: Column) -> Column:
    """Terms of a text in order, letters as they are; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS, -1), ""), F.array().cast("array<string>"))


def ascii_lower(term: Column) -> Column:
    """A-Z lower-cased, other letters untouched; lower() does just that to plain ASCII, and faster."""
    return F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def terms(text: Column) -> Column:
    return F.transform(raw_terms(text), ascii_lower)


def term_hash(term: Column) -> Column:
    """A key for joins on longs. It folds all case, so equal terms have equal keys; what it brings together is compared after."""
    return F.xxhash64(F.lower(term))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast behind a size check; beyond it the join shuffles."""
    return F.broadcast(df) if within(df, BROADCAST_ROWS) else df


def corpus_frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each term of vocabulary (term), in any case, occurs in all of docs (text)."""
    keyed = vocabulary.select("term", term_hash(F.col("term")).alias("h"))
    every = docs.select(F.explode(F.split(F.lower("text"), SEPARATORS, -1)).alias("t")).select(F.xxhash64("t").alias("h"))
    found = every.join(_small(keyed.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("df"))
    return keyed.join(found, "h", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def window_keys(items: DataFrame, frequencies: DataFrame, width: int) -> DataFrame:
    """items (item_id, words) -> (item_id, q, tid, off2, tid2, before, after, need): one row for each different key position.

    q is where the rarest term of a window stands, before and after the item's terms around it (at most width - 1),
    need the run of equal terms that makes a hit; the second rarest term of the window stands off2 further on.
    """
    placed = items.select("item_id", F.posexplode("words").alias("q", "term")).join(_small(frequencies), "term")
    ranked = placed.select("item_id", F.struct("df", "term", "q").alias("t"), "q")
    windows = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("at"))
    inside = windows.select("item_id", "at", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + width, F.size("words")) - 1)).alias("q")).join(ranked, ["item_id", "q"])
    best = inside.groupBy("item_id", "at").agg(F.slice(F.array_sort(F.collect_list("t")), 1, 2).alias("two"))
    two = lambda i: F.try_element_at("two", F.lit(i))
    keys = best.select("item_id", two(1)["q"].alias("q"), two(1)["term"].alias("term"), F.coalesce(two(2)["q"], two(1)["q"]).alias("q2"), F.coalesce(two(2)["term"], two(1)["term"]).alias("term2"))
    keys = keys.distinct().join(items, "item_id")
    reach = F.lit(width - 1)
    from_ = F.greatest(F.col("q") - reach, F.lit(0))
    return keys.select(
        "item_id", "q", "term", "term2", F.xxhash64("term").alias("tid"), (F.col("q2") - F.col("q")).alias("off2"), F.xxhash64("term2").alias("tid2"),
        F.slice("words", from_ + 1, F.col("q") - from_).alias("before"),
        F.slice("words", F.col("q") + 2, reach).alias("after"),
        F.least(F.lit(width), F.size("words")).alias("need"),
    )


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """docs (doc_id, raw terms words), vocabulary (term) -> the positional inverted index (tid, doc_id, pos) of those terms.

    tid is a hash of the lower-cased term; terms are compared before it is given, so that another term never has it.
    """
    keyed = vocabulary.select(F.col("term").alias("key_term"), term_hash(F.col("term")).alias("h"), F.xxhash64("term").alias("tid"))
    each = docs.select("doc_id", F.posexplode("words").alias("pos", "raw")).select("doc_id", "pos", "raw", term_hash(F.col("raw")).alias("h"))
    hits = each.join(_small(keyed), "h").where(ascii_lower(F.col("raw")) == F.col("key_term"))
    return hits.select("tid", "doc_id", "pos")


def near(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """pairs (tid, tid2, ...) -> pairs with doc_id, pos, pos2: the places where both terms stand at most slop apart.

    The list of tid is intersected with that of tid2 by document and stretch of slop + 1 positions, of which the two
    are in the same or in neighbouring ones; no document is met as a whole.
    """
    left = index.join(_small(pairs), "tid")
    left = left.withColumn("stretch", F.explode(F.array(*[F.floor(F.col("pos") / (slop + 1)) + d for d in (-1, 0, 1)])))
    right = index.select(F.col("tid").alias("tid2"), "doc_id", F.col("pos").alias("pos2"), F.floor(F.col("pos") / (slop + 1)).alias("stretch"))
    return left.join(right, ["doc_id", "tid2", "stretch"]).where(F.abs(F.col("pos") - F.col("pos2")) <= slop).drop("stretch")


def _equal_run(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    apart = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.element_at(apart, 1)


def phrase_hits(docs: DataFrame, met: DataFrame, keys: DataFrame, reach: int) -> DataFrame:
    """docs (doc_id, raw terms words), met (item_id, q, doc_id, pos): key terms whose second term is in place
    -> (item_id, doc_id, first, last): runs of document positions that hold a whole window of the item.

    Only documents with such a place are read; what goes on of them are the reach terms around it.
    """
    from_ = F.greatest(F.col("pos") - reach, F.lit(0))
    around = docs.join(_small(met), "doc_id").select(
        "item_id", "q", "doc_id", "pos",
        F.transform(F.slice("words", from_ + 1, F.col("pos") - from_), ascii_lower).alias("own_before"),
        F.transform(F.slice("words", F.col("pos") + 2, F.lit(reach)), ascii_lower).alias("own_after"),
    )
    both = around.join(_small(keys.select("item_id", "q", "before", "after", "need").dropDuplicates(["item_id", "q"])), ["item_id", "q"])
    back, ahead = _equal_run(F.reverse("own_before"), F.reverse("before")), _equal_run(F.col("own_after"), F.col("after"))
    runs = both.select("item_id", "doc_id", "pos", "need", back.alias("back"), ahead.alias("ahead"))
    runs = runs.where(F.col("back") + 1 + F.col("ahead") >= F.col("need"))
    return runs.select("item_id", "doc_id", (F.col("pos") - F.col("back")).alias("first"), (F.col("pos") + F.col("ahead")).alias("last"))


def proximity_hits(docs: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """docs (doc_id, words), pairs (left, right) -> (left, right, doc_id, pos, at): places where the two different terms stand at most slop apart."""
    vocabulary = pairs.select(F.col("left").alias("term")).union(pairs.select("right")).distinct()
    keyed = pairs.select("left", "right", F.xxhash64("left").alias("tid"), F.xxhash64("right").alias("tid2"))
    met = near(stage(build_index(docs, vocabulary), "index"), keyed, slop)
    return met.where("pos != pos2").select("left", "right", "doc_id", "pos", F.col("pos2").alias("at"))


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near), one row for each row of docs.

    A window is width consecutive terms of an item; an item of fewer, but not none, is one window.
    A document term inside any occurrence of a window is hit; contaminated means n_hit > 0 and share *
    n_hit >= n_words. n_near counts the items of which the two rarest terms of a window stand at most width apart
    somewhere in the document, whether the window is there or not. Null and empty texts have no terms. Rows that share a doc_id are told
    apart by their text; equal rows get equal results. Several texts of one item_id are windows of that item; items without an id
    hit words like others, count as one item together, and add nothing to the list of ids. A term that stands in very many places is spread over the tasks
    by document and position, and the item side is broadcast behind a size check. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    indexed = docs.select(key.alias("doc_id"), raw_terms(F.col("text")).alias("words"))
    item = F.xxhash64(F.col("item_id").cast("string"), F.col("item_id").isNull(), F.xxhash64("text"))  # two texts may share an id
    items = items.select(item.alias("item_id"), F.col("item_id").cast("string").alias("name"), terms(F.col("text")).alias("words")).where(F.size("words") > 0)
    names = stage(items.select("item_id", "name").distinct(), "names")
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    frequencies = stage(corpus_frequencies(docs, vocabulary), "frequencies")
    keys = stage(window_keys(items.drop("name").dropDuplicates(["item_id"]), frequencies, width), "keys")
    index = stage(build_index(indexed.where("doc_id is not null"), keys.select("term").union(keys.select("term2")).distinct()), "index")
    met = stage(near(index, keys.select("item_id", "q", "tid", "off2", "tid2"), width).select("item_id", "q", "doc_id", "pos", (F.col("pos2") == F.col("pos") + F.col("off2")).alias("exact")).distinct(), "met")
    hits = stage(phrase_hits(indexed, met.where("exact").drop("exact"), keys, width - 1).distinct(), "hits")

    # positions covered by the union of runs, by gaps and islands over each document's runs
    spans = hits.select("doc_id", "first", "last").distinct()
    order = W.partitionBy("doc_id").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(reached, F.lit(-1))))
    covered = spans.select("doc_id", fresh.alias("new")).groupBy("doc_id").agg(F.sum("new").cast("long").alias("n_hit"))
    of = lambda rows: rows.select("doc_id", "item_id").distinct().join(_small(names), "item_id").select("doc_id", F.struct("name").alias("name")).distinct()
    named = of(hits).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("name.name")).alias("ids"))
    close = of(met).groupBy("doc_id").agg(F.count("*").alias("n_near"))
    found = close.join(covered, "doc_id", "left").join(named, "doc_id", "left")
    found = found.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.h").alias("h"), "n_hit", "n_items", "ids", "n_near")
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(raw_terms(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (base["h"] == found["h"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", count("n_hit"), count("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), count("n_near"),
    )
