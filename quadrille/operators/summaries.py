"""Printed summaries as ordered lines, and benchmarks of runs against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation
from .runs import Run


def rate(value: Column) -> Column:
    """Three digits, or a word where there is no rate."""
    return F.when(value.isNotNull(), F.format_string("%.3f", value.cast("double"))).otherwise("score_not_meaningful")


def listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("none")


def lines(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows -> (key, position, line): 'name: value' for each value, in their order; null is empty."""
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in values.items()]
    return rows.select(key, F.posexplode(F.array(*parts)).alias("position", "line"))


def run_summary(run: Run, mode: str) -> DataFrame:
    """The summary of every record of a run."""
    pages = run.pages.groupBy(run.key).agg(F.count("*").alias("pages"), F.count_if(F.col("stage") == "official_seed_page").alias("seeds"), F.count_if(~F.col("stage").isin("seed", "official_seed_page")).alias("further"))
    rows = run.records.select(run.key, "source_url", "page_title").join(pages, run.key, "left").join(run.outcomes.withColumnRenamed("source_url", "looked_on"), run.key, "left")
    flag = lambda c: F.initcap(c.cast("string"))
    values = {"run_mode": F.lit(mode), run.key: F.col(run.key), "source_url": F.col("source_url"), "page_title": F.col("page_title")}
    if run.key == "program_code":
        values |= {"seed_pages_inspected": F.col("seeds")}
    values |= {
        "candidate_pages_inspected": F.col("further"), "follow_up_triggered": flag(F.coalesce(F.col("looked_on").isNotNull(), F.lit(False))), "follow_up_candidates_found": F.col("found"),
        "follow_up_candidates_fetched": F.col("fetched"), "follow_up_fields_supplemented": flag(F.coalesce(F.size("updated") > 0, F.lit(False))), "follow_up_update_reason": F.col("reason"),
    }
    return lines(rows, run.key, values)


def benchmark(run: Run, chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each chosen target: the evaluation of its record, or skipped_missing_gold_label, or not_run where the run rejected it."""
    codes = chosen.select("program_code")
    gold = labels.join(codes, "program_code", "left_semi")
    defaults = evaluation.coverage_defaults(chosen).withColumnRenamed("coverage", "default_coverage")
    none = F.expr("map()").cast("map<string,boolean>")
    gold = gold.join(defaults, "program_code").withColumn("coverage", F.map_zip_with(F.coalesce("coverage", none), "default_coverage", lambda k, own, other: F.coalesce(own, other)))
    summary = evaluation.summarize(evaluation.field_results(run.records, gold), gold)
    out = codes.join(gold.select("program_code", "label_status"), "program_code", "left").join(summary, "program_code", "left")
    status = F.when(F.col("label_status").isNull(), "skipped_missing_gold_label").otherwise(F.coalesce("benchmark_status", F.lit("not_run")))
    return out.withColumn("benchmark_status", status)


# What a status means.
MESSAGES = {
    "skipped_due_to_incomplete_gold_label": "Gold label is still marked as incomplete/template and contains no scored fields.",
    "incomplete_gold_label": "Gold label is not yet in a completed state; field-level comparisons are partial and aggregate scores are not meaningful.",
    "score_not_meaningful": "Gold label contains no scored fields, so aggregate benchmark scores are not meaningful.",
    "skipped_missing_gold_label": "Gold label not found for program code.",
    "not_run": "The run of the programme was rejected.",
}


def benchmark_summary(results: DataFrame) -> DataFrame:
    status = F.col("benchmark_status")
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[status]
    return lines(
        results, "program_code",
        {
            "program_code": F.col("program_code"), "benchmark_status": status, "gold_label_status": F.col("label_status"), "required_field_count": F.col("required"), "scored_field_count": F.size("scored_fields"),
            "real_scored_fields": listed(F.col("scored_fields")), "skipped_fields_due_to_missing_truth": listed(F.col("skipped_fields")), "score_not_meaningful": F.initcap((status != "completed").cast("string")),
            "benchmark_message": message, "overall_field_score": rate(F.col("overall_field_score")), "exact_match_rate": rate(F.col("exact_match_rate")), "field_coverage_rate": rate(F.col("field_coverage_rate")), "missing_fields": listed(F.col("missing_fields")),
        },
    )
