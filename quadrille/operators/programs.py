"""From pages to one record for each programme: completeness, hints, eligibility, arg-best with provenance, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

FLAGS = [f"foundation_{k}" for k in V.FOUNDATIONS]


def has(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def completeness() -> Column:
    points = {"program_name": 2, "department": 1, "duration": 1, "deadline": 2, "tuition": 2, "english_requirement": 2, "academic_requirement": 2}
    score = reduce(lambda s, f: s + F.when(has(f), points[f]).otherwise(0), points, F.lit(0))
    score = score + F.least(F.size("prerequisite_keywords"), F.lit(3))
    return reduce(lambda s, f: s + F.col(f).cast("int"), FLAGS, score)


def hint_score(field: str, hint: Column) -> Column:
    """hint: text in plain words. Keywords count by substring, each entry of the list on its own."""
    return reduce(lambda s, kw: s + F.when(hint.contains(kw[0]), kw[1]).otherwise(0), V.HINTS[field], F.lit(0))


def eligible(field: Column, value: Column) -> Column:
    """Whether a value may be chosen for a field."""
    v, low = value, F.lower(value)  # a collapsed column
    month = v.rlike(rf"(?i)\b{V.MONTH}\b") & v.rlike(V.YEAR)
    deadline = ~T.matches(low, V.DEADLINE_VALUE_REJECTED) & (~low.contains("http") | month) & (month | T.matches(v, V.DEADLINE_VALUE_ACCEPTED, True))
    department = T.any_of(low, ["department", "school", "faculty", "college", "institute"]) & (T.words(v) >= 3)
    duration = low.rlike(V.UNITS) | (T.any_of(low, ["full-time", "part-time"]) & T.any_of(low, ["year", "month"]))
    tuition = (
        T.has_currency(v) & ~T.matches(low, V.TUITION_VALUE_REJECTED) & (F.coalesce(F.array_max(T.amounts(v)), F.lit(50_000)) >= 50_000)
        & ~(low.contains("government-funded programmes") & ~low.contains("master of") & ~low.contains("mdasc"))
    )
    by_field = F.when(field == "deadline", deadline).when(field == "department", department).when(field == "duration", duration).when(field == "tuition", tuition).otherwise(True)
    return F.coalesce((v != "") & by_field, F.lit(False))


def specificity(field: Column, value: Column) -> Column:
    v = value
    plus = lambda c, n: F.when(c, n).otherwise(0)
    length, words = F.length(v), T.words(v)
    return (
        F.when(field == "program_name", plus(v.rlike(V.PROGRAM_WORD), 20) + words + length)
        .when(field == "department", plus(T.any_of(F.lower(v), ["department", "school", "faculty", "college"]), 20) + words + length)
        .when(field == "duration", plus(v.rlike(r"(?i)\byears?\b|\bmonths?\b"), 20) + words + length)
        .when(field == "deadline", plus(v.rlike(V.YEAR), 20) + plus(v.rlike(rf"(?i)\b{V.MONTH}\b"), 10) + length)
        .when(field == "tuition", plus(T.has_currency(v), 20) + F.length(F.regexp_replace(v, "[^0-9]", "")) + length)
        .when(field.isin("english_requirement", "academic_requirement"), words * 2 + length)
        .otherwise(length)
    )


def with_hints(pages: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Adds hint (plain words): hint_text of the page's source_url, else its title and URL; and completeness."""
    default = F.concat_ws(" ", "page_title", "source_url")
    if hints is not None:
        pages = pages.join(hints.select("source_url", "hint_text").dropDuplicates(["source_url"]), "source_url", "left")
        default = F.coalesce("hint_text", default)
    return T.staged(pages, {"hint": T.plain_words(default)}, {"completeness": completeness()})


def page_order() -> Column:
    """Smaller is better: the most complete page, then by the fields it has, then its URL."""
    return F.struct(
        (-completeness()).alias("a"), *[(-has(f).cast("int")).alias(f) for f in ("department", "duration", "deadline", "tuition", "english_requirement", "academic_requirement")],
        (-F.size("prerequisite_keywords")).alias("k"), (-has("program_name").cast("int")).alias("p"), F.col("source_url").alias("u"),
    )


def best_pages(pages: DataFrame, by: str = "program_code") -> DataFrame:
    """The most complete page of each programme: (by, source_url, page_title, completeness)."""
    best = pages.groupBy(by).agg(F.min_by(F.struct("source_url", "page_title", completeness().alias("completeness")), page_order()).alias("__best"))
    return best.select(by, "__best.*")


def field_candidates(pages: DataFrame, by: str = "program_code") -> DataFrame:
    """pages of with_hints -> one row for each page and scalar field, with its scores, eligible, and selected (one by programme and field)."""
    long = pages.select(
        by, "source_url", "page_title", "completeness",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), hint_score(f, F.col("hint")).alias("hint_score")) for f in V.AGGREGATED_FIELDS])).alias("__x"),
    ).select(by, "source_url", "page_title", "completeness", "__x.*")
    bare = F.col("bare")
    long = T.staged(long, {"bare": T.collapse("value")}, {"eligible": eligible(F.col("field"), bare)}, {"specificity": F.when(F.col("eligible"), specificity(F.col("field"), bare)).otherwise(0)}).drop("bare")
    name = F.col("field") == "program_name"
    one, two = F.when(name, F.col("specificity")).otherwise(F.col("hint_score")), F.when(name, F.col("hint_score")).otherwise(F.col("specificity"))
    order = [F.desc("eligible"), F.desc(one), F.desc(two), F.desc("completeness"), F.desc(F.length("value")), F.col("source_url"), F.col("value")]
    rank = F.row_number().over(W.partitionBy(by, "field").orderBy(*order))
    return long.withColumn("selected", F.col("eligible") & (rank == 1))


def merged_keywords(pages: DataFrame, by: str = "program_code") -> DataFrame:
    """Ordered union of keywords over pages by hint, completeness and URL: (by, prerequisite_keywords, keyword_sources)."""
    each = pages.select(by, "source_url", F.struct((-hint_score("prerequisite_keywords", F.col("hint"))).alias("h"), (-F.col("completeness")).alias("c"), F.col("source_url").alias("u")).alias("page"), F.posexplode("prerequisite_keywords").alias("pos", "keyword"))
    first = each.groupBy(by, "keyword").agg(F.min(F.struct("page", "pos")).alias("at"))  # the page that contributes it
    out = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "keyword"))).alias("all"))
    return out.select(by, F.transform("all", lambda x: x["keyword"]).alias("prerequisite_keywords"), F.array_distinct(F.transform("all", lambda x: x["at"]["page"]["u"])).alias("keyword_sources"))


def merged_foundations(pages: DataFrame, by: str = "program_code") -> DataFrame:
    """Each flag over all pages; sources are the pages that first turned a flag on, ranked by the academic hint."""
    page = F.struct((-hint_score("academic_requirement", F.col("hint"))).alias("h"), (-F.col("completeness")).alias("c"), F.col("source_url").alias("u"))
    out = pages.groupBy(by).agg(*[F.max(f).alias(f) for f in FLAGS], *[F.min(F.when(F.col(f), page)).alias(f"s_{f}") for f in FLAGS])
    sources = F.array_distinct(F.transform(F.array_sort(F.array_compact(F.array(*[F.col(f"s_{f}") for f in FLAGS]))), lambda s: s["u"]))
    return out.select(by, *FLAGS, sources.alias("foundation_sources"))


SPECIAL = {f: f"special_{f}" for f in V.AGGREGATED_FIELDS}


def judged(pages: DataFrame) -> DataFrame:
    """Adds the specificity of each scalar field, null where its value may not be chosen; it depends on the extracted fields alone."""
    bare = {f: F.col(f"bare_{f}") for f in SPECIAL}
    special = {name: F.when(eligible(F.lit(f), bare[f]), specificity(F.lit(f), bare[f])) for f, name in SPECIAL.items()}
    return T.staged(pages, {f"bare_{f}": T.collapse(f) for f in SPECIAL}, special).drop(*[f"bare_{f}" for f in SPECIAL])


def aggregate_programs(pages: DataFrame, hints: DataFrame | None = None, by: str = "program_code") -> DataFrame:
    """pages (by, source_url, page_title, fields) -> one record for each programme, with the source of every field.

    Pages, judged before or here, are dealt out by programme once and every part of a record is a least candidate, first of the pages of a programme
    with the same keywords, then of the programme; so keywords are merged over their different lists, however many pages a programme has.
    """
    pages = with_hints(pages if set(SPECIAL.values()) <= set(pages.columns) else judged(pages), hints)
    hinted = {f: f"hint_{f}" for f in [*V.AGGREGATED_FIELDS, "prerequisite_keywords"]}
    scores = [hint_score(f, F.col("hint")).alias(name) for f, name in hinted.items()]
    dealt = pages.select(by, "source_url", "page_title", "completeness", *V.AGGREGATED_FIELDS, *SPECIAL.values(), "prerequisite_keywords", *FLAGS, *scores).repartition(by)
    worst = F.lit(2**31 - 1)
    done = F.coalesce(-F.col("completeness"), worst)

    def candidate(f: str) -> Column:
        one, two = (SPECIAL[f], hinted[f]) if f == "program_name" else (hinted[f], SPECIAL[f])
        made = F.struct((-F.col(one)).alias("a"), (-F.col(two)).alias("b"), done.alias("c"), (-F.length(f)).alias("l"), F.col("source_url").alias("url"), F.col(f).alias("value"))
        return F.when(F.col(SPECIAL[f]).isNotNull(), made)

    ranked = lambda f: F.struct((-F.col(hinted[f])).alias("h"), (-F.col("completeness")).alias("c"), F.col("source_url").alias("u"))
    page = F.struct(page_order().alias("o"), F.col("page_title").alias("page_title"), F.col("completeness").alias("completeness"))
    parts = {"page": page, **{f: candidate(f) for f in V.AGGREGATED_FIELDS}, **{f"s_{f}": F.when(F.col(f), ranked("academic_requirement")) for f in FLAGS}}
    lists = dealt.groupBy(by, "prerequisite_keywords").agg(*[F.min(c).alias(n) for n, c in parts.items()], *[F.max(f).alias(f) for f in FLAGS], F.min(ranked("prerequisite_keywords")).alias("at"))
    said = F.array_sort(F.collect_list(F.when(F.size("prerequisite_keywords") > 0, F.struct("at", "prerequisite_keywords"))))
    out = lists.groupBy(by).agg(*[F.min(n).alias(n) for n in parts], *[F.max(f).alias(f) for f in FLAGS], said.alias("said"))
    # a list is a source if it holds a keyword that no list before it holds
    before = lambda i: F.flatten(F.transform(F.slice("said", F.lit(1), i), lambda w: w["prerequisite_keywords"]))
    new = F.filter("said", lambda w, i: F.size(F.array_except(w["prerequisite_keywords"], before(i))) > 0)
    sources = F.array_distinct(F.transform(F.array_sort(F.array_compact(F.array(*[F.col(f"s_{f}") for f in FLAGS]))), lambda s: s["u"]))
    return out.select(
        by, F.col("page.o.u").alias("source_url"), "page.page_title", "page.completeness",
        *[c for f in V.AGGREGATED_FIELDS for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.url").alias(f"{f}_source"))],
        F.array_distinct(F.flatten(F.transform("said", lambda w: w["prerequisite_keywords"]))).alias("prerequisite_keywords"),
        F.transform(new, lambda w: w["at"]["u"]).alias("keyword_sources"), *FLAGS, sources.alias("foundation_sources"),
    )


def missing_fields(fields: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~has(f), f) for f in fields]))
