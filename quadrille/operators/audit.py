"""How each field of a record was decided, and the debug report of a run, as nested ordered rows.

A group holds the inspected pages of one run, whose number the run bounds (seeds, five links, two or six further pages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .programs import FLAGS, field_candidates, hint_score, with_hints
from .record_state import unpivoted
from .runs import Run

# The names of the strategies.
BY_NAME, BY_HINT = "prefer_non_null_value_then_program_specificity_then_page_hint", "prefer_non_null_value_then_field_hint_then_specificity"
STRATEGIES = {f: BY_HINT for f in V.AGGREGATED_FIELDS} | {"program_name": BY_NAME, "prerequisite_keywords": "merge_unique_keywords_from_ranked_pages", "foundation_mentions": "merge_true_flags_from_ranked_pages"}


def _merged(pages: DataFrame, by: str, field: str, items: Column, value: Column, hint: Column) -> DataFrame:
    """Candidates of a merged field: a page is selected if it is the first, by hint, completeness and URL, with one of its items."""
    rows = pages.select(by, "source_url", "page_title", "completeness", items.alias("items"), value.alias("value"), hint.alias("hint_score"))
    place = F.struct((-F.col("hint_score")).alias("h"), (-F.col("completeness")).alias("c"), F.col("source_url").alias("u"))
    first = rows.select(by, F.explode("items").alias("item"), place.alias("place")).groupBy(by, "item").agg(F.min("place").alias("place"))
    first = first.select(by, F.col("place.u").alias("source_url")).distinct().withColumn("first", F.lit(True))
    out = rows.join(first, [by, "source_url"], "left")
    return out.select(
        by, F.lit(field).alias("field"), "source_url", "page_title", "value", "hint_score", F.size("items").alias("specificity"), "completeness", (F.size("items") > 0).alias("eligible"), F.coalesce("first", F.lit(False)).alias("selected")
    )


def decision_candidates(pages: DataFrame, hints: DataFrame | None = None, by: str = "program_code") -> DataFrame:
    """One row for each page and field (the seven scalar ones and the two merged ones) with its scores, eligible and selected."""
    pages = pages if {"hint", "completeness"} <= set(pages.columns) else with_hints(pages, hints)
    scalar = field_candidates(pages, by).select(by, "field", "source_url", "page_title", "value", "hint_score", "specificity", "completeness", "eligible", "selected")
    words = F.col("prerequisite_keywords")
    keywords = _merged(pages, by, "prerequisite_keywords", F.array_distinct(words), F.array_join(words, ", "), hint_score("prerequisite_keywords", F.col("hint")))
    on = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f.removeprefix("foundation_"))) for f in FLAGS]))
    flags = _merged(pages, by, "foundation_mentions", on, F.array_join(on, ", "), hint_score("academic_requirement", F.col("hint")))
    return scalar.unionByName(keywords).unionByName(flags)


def decisions(candidates: DataFrame, by: str = "program_code") -> DataFrame:
    """(by, field, strategy, selected_value, source_urls, candidates): the candidates of a field in the order they are shown in, which is
    selected, eligible, hint score, URL."""
    order = F.struct((-F.col("selected").cast("int")).alias("s"), (-F.col("eligible").cast("int")).alias("e"), (-F.col("hint_score")).alias("h"), F.col("source_url").alias("u"))
    shown = F.struct("source_url", "page_title", "value", "hint_score", F.col("specificity").cast("int").alias("specificity_score"), F.col("completeness").alias("completeness_score"), "eligible", "selected")
    out = candidates.groupBy(by, "field").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), shown.alias("c")))).alias("all"))
    out = out.select(by, "field", F.transform("all", lambda x: x["c"]).alias("candidates"))
    chosen = F.filter("candidates", lambda c: c["selected"])
    merged = F.col("field").isin("prerequisite_keywords", "foundation_mentions")
    strategy = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])[F.col("field")]
    return out.select(by, "field", strategy.alias("strategy"), F.when(~merged, F.try_element_at(chosen, F.lit(1))["value"]).alias("selected_value"), F.array_distinct(F.transform(chosen, lambda c: c["source_url"])).alias("source_urls"), "candidates")


def debug_report(run: Run, mode: str) -> DataFrame:
    """One row for each record of a run: run_mode, the outcome, and arrays of its pages, links, sources, decisions and changes."""
    key = run.key
    listed = lambda df, name, order: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (key, *order)]))).alias(name))
    pages = run.pages.drop("hint")
    nested = [
        listed(pages, "inspected_pages", ["position", "source_url"]),
        listed(run.candidates, "candidate_links", ["discovery_stage", "attempt", "from_url", "url"]),
        listed(run.sources, "follow_up_sources", ["attempt", "from_url"]),
        listed(decisions(decision_candidates(run.pages, by=key), key), "aggregation_decisions", ["field"]),
        listed(run.changes, "changes", ["field"]),
        listed(unpivoted(run.records, key), "final_result", ["field"]),
    ]
    out = run.records.select(key, "source_url", "page_title").join(run.outcomes.withColumnRenamed("source_url", "follow_up_source_url"), key, "left")
    for part in nested:
        out = out.join(part, key, "left")
    return out.withColumn("run_mode", F.lit(mode))
