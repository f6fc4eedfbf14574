"""What every filter of a chain does in every order, from one count of the sets of filters that rows fail.

The rows of a part are counted once by their mask (bit i: fails filter i). A subset-zeta transform of those counts gives,
for each set of filters, the rows that survive all of it; whatever a step of an order does is then the difference
between two neighbouring sets, for all rows as for the labelled ones. Only the count of masks reads rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage

MOST_FILTERS = 6  # 720 orders


def zeta(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Turns column (array of 2^bits) into sums over subsets: at m, the sum of what was at every s that is a subset of m."""
    for bit in range(bits):
        df = df.withColumn(column, F.transform(column, _with_neighbour(column, F.lit(1 << bit))))
    return df


def _with_neighbour(column: str, bit: Column):
    return lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(F.col(column), i - bit)).otherwise(0)


def mask_counts(rows: DataFrame, measures: list[str], bits: int) -> DataFrame:
    """rows (part, mask, measures) -> one row for each part: rows and each measure as an array by mask."""
    few = rows.groupBy("part", "mask").agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in measures])
    masks = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    names = ["rows", *measures]
    each = few.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names).alias("n")))).alias("by_mask"))  # 2^bits entries at most
    at = lambda name: lambda m: F.coalesce(F.try_element_at("by_mask", m)[name], F.lit(0).cast("long"))
    return each.select("part", *[F.transform(masks, at(c)).alias(c) for c in names])


def audit_filters(rows: DataFrame, filters: list[str], measures: list[str]) -> DataFrame:
    """rows (part, mask, measures of 0 and 1) -> (part, filter_order, step, filter, kept, removed, redundant, unique_fails, <measure>_lost, shapley).

    One row for each part, order of the filters and step, zeros included. kept: rows left after the step; removed: those it takes;
    redundant: those that fail its filter and were taken before; unique_fails: those that fail its filter alone;
    <measure>_lost: removed rows with the measure; shapley: what the filter removes, summed over all orders.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    full = (1 << k) - 1
    parts = mask_counts(rows, measures, k)
    parts = parts.withColumn("unique", F.col("rows"))
    for c in ("rows", *measures):
        parts = zeta(parts, c, k)
    # rows that fail no filter of a set s are those whose mask is a subset of what s leaves out
    left = lambda s, c="rows": F.get(F.col(c), F.lit(full) - s)

    def share(bit: int) -> Column:
        others = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.lit(bit)) == 0)
        ways = lambda s: F.factorial(F.bit_count(s)) * F.factorial(F.lit(k - 1) - F.bit_count(s))
        return F.aggregate(others, F.lit(0).cast("long"), lambda total, s: total + ways(s) * (left(s) - left(s + F.lit(bit))))

    parts = parts.withColumn("shapley", F.array(*[share(1 << i) for i in range(k)]))
    orders = F.array(*[F.array(*map(F.lit, o)) for o in permutations(range(k))])
    steps = parts.withColumn("order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumn("own", F.get("order", F.col("step") - 1))
    place = lambda i: F.array_position("order", F.lit(i))
    steps = steps.withColumn("bit", F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("own")))
    steps = steps.withColumn("before", reduce(lambda a, b: a + b, [F.when(place(i) < F.col("step"), 1 << i).otherwise(0) for i in range(k)]))
    before, after, bit = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    removed = left(before) - left(after)
    name = F.array(*map(F.lit, filters))
    return steps.select(
        "part", F.array_join(F.transform("order", lambda i: F.get(name, i)), "").alias("filter_order"), "step", F.get(name, F.col("own")).alias("filter"), left(after).alias("kept"), removed.alias("removed"),
        (left(F.lit(0)) - left(bit) - removed).alias("redundant"), F.get("unique", bit).alias("unique_fails"), *[(left(before, m) - left(after, m)).alias(f"{m}_lost") for m in measures], F.get("shapley", F.col("own")).alias("shapley"),
    )


# ---- the five filters of documents ----
FILTERS = ["A", "B", "C", "D", "E"]


def failed_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) and labels (doc_id, quality, toxic) -> (part, mask, good, toxic), one row for each row of docs.

    Words are maximal runs `[^\\x20\\x09-\\x0D]+`, a null text is empty, a null lang the part ''. A: under 100 words. B: distinct words
    under 80 % of them. C: over 10 % of the code points are A-Z. D: holds one of #$%&*|. E: the text of any smaller doc_id. Rows of
    one text and one doc_id don't fail E for each other; a row without a doc_id neither fails E nor makes another fail.
    Of several labels of a doc_id any 1 counts; other columns are not looked at; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    n = F.size("words").cast("long")
    fails = {
        1: n < 100,
        2: 100 * F.size(F.array_distinct("words")) < 80 * n,
        4: 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long"),
        8: F.col("text").rlike(r"[#$%&*|]"),
    }
    mask = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0) for v, c in fails.items()])
    judged = stage(words.select("doc_id", "part", mask.alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "judged")
    first = judged.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))  # copies meet as one row a task
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # by text and doc_id together, so that the copies of one text are spread
    out = judged.join(first, ["sha", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return out.select("part", (F.col("own") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents, by lang, with the good and the toxic documents that each step loses."""
    return audit_filters(failed_filters(docs, labels), FILTERS, ["good", "toxic"])
