"""Records against gold labels: normalisation, status, scores, summaries. Long form: one row for each programme and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _tidy(value: Column) -> Column:
    for old, new in V.REPLACED.items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.regexp_replace(T.collapse(value), r"\s+([,.;:])", "$1")


def normalize_scalar(value: Column) -> Column:
    return casefold(T.filled(F.trim(_tidy(value))))


def with_normalized(df: DataFrame, field: Column, **values: str) -> DataFrame:
    """Adds, for each new column name, the normal form of a column for its field."""
    for new, value in values.items():
        source, plain = F.col("__source"), F.col("__plain")
        dated = F.regexp_replace(source, rf"(?i)\b({V.MONTH})\s+0([1-9])(?=,\s*\d{{4}}\b)", "$1 $2")
        dated = F.regexp_replace(dated, rf"(?i)\b0([1-9])\s+({V.MONTH})(?=\s+\d{{4}}\b)", "$1 $2")
        english = plain.contains("english language requirement") & plain.contains("higher degree") & T.any_of(plain, ["satisfy", "applicable to higher degrees", "admission requirements", "admissions requirements"])
        courses = plain.contains("calculus") & plain.contains("algebra") & plain.contains("programming") & plain.contains("statistics")
        courses = courses & T.any_of(plain, ["at least one", "should have completed", "shall have taken", "should have taken"])
        normal = (
            F.when(field == "program_name", normalize_scalar(F.regexp_replace(source, r"\s*\(([A-Z][A-Z0-9&/\-]{1,15})\)\s*$", "")))
            .when(field == "deadline", normalize_scalar(dated))
            .when((field == "english_requirement") & english, "university higher degree english language requirement")
            .when((field == "academic_requirement") & courses, "course_background_calculus_algebra_programming_statistics")
            .otherwise(plain)
        )
        df = T.staged(df, {"__source": _tidy(F.col(value))}, {"__plain": normalize_scalar(source)}, {new: normal}).drop("__source", "__plain")
    return df


def normalize_keywords(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(values, normalize_scalar))))


def long_fields(records: DataFrame, suffix: str) -> DataFrame:
    """(program_code, field, value_<suffix>) of the scalar fields."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(f"value_{suffix}")) for f in V.SCALAR_FIELDS])
    return records.select("program_code", F.explode(each).alias("__x")).select("program_code", "__x.*")


def _status(no_gold: Column, complete: Column, no_value: Column, expected: Column, equal: Column) -> Column:
    return (
        F.when(no_gold & ~complete, "skipped_due_to_missing_gold_truth")
        .when(no_gold & no_value, "expected_null")
        .when(no_gold, "extraction_error")
        .when(no_value & expected, "field_left_null")
        .when(no_value, "missing_source_coverage")
        .when(equal, "matched")
        .otherwise("extraction_error")
    )


def compare_scalars(records: DataFrame, gold: DataFrame) -> DataFrame:
    """records and gold (program_code, scalar fields; gold also label_status and coverage map<string, boolean>)
    -> (program_code, field, extracted, gold, status, score, exact_match, coverage_expected)."""
    truth = long_fields(gold, "gold").join(gold.select("program_code", "label_status", "coverage"), "program_code")
    met = truth.join(long_fields(records, "extracted"), ["program_code", "field"])
    met = with_normalized(met, F.col("field"), e="value_extracted", g="value_gold")
    met = met.withColumns({"ga": T.amounts(F.lower("value_gold")), "ea": T.amounts(F.lower("value_extracted")), "complete": F.col("label_status").isin(V.READY_STATUSES), "expected": F.coalesce(F.try_element_at("coverage", F.col("field")), F.lit(False))})
    ga, ea = F.col("ga"), F.col("ea")
    contained = (F.col("field") == "tuition") & (F.size(ga) > 0) & (F.size(F.array_except(ga, ea)) == 0)
    equal = F.coalesce((F.col("e") == F.col("g")) | contained, F.lit(False))
    status = _status(F.col("g").isNull(), F.col("complete"), F.col("e").isNull(), F.col("expected"), equal)
    out = met.withColumn("status", status)
    exact = F.col("status").isin("matched", "expected_null")
    return out.select("program_code", "field", F.col("value_extracted").alias("extracted"), F.col("value_gold").alias("gold"), "status", exact.cast("double").alias("score"), exact.alias("exact_match"), F.col("expected").alias("coverage_expected"))


def compare_keywords(records: DataFrame, gold: DataFrame) -> DataFrame:
    """The same for prerequisite_keywords as sets, with precision, recall and f1."""
    met = gold.select("program_code", "label_status", "coverage", normalize_keywords(F.col("prerequisite_keywords")).alias("g")).join(
        records.select("program_code", normalize_keywords(F.col("prerequisite_keywords")).alias("e")), "program_code"
    )
    empty = F.array().cast("array<string>")
    met = met.withColumns({"g": F.coalesce("g", empty), "e": F.coalesce("e", empty), "complete": F.col("label_status").isin(V.READY_STATUSES), "expected": F.coalesce(F.try_element_at("coverage", F.lit("prerequisite_keywords")), F.lit(False))})
    both = F.size(F.array_intersect("e", "g")).cast("double")
    met = met.withColumn("status", _status(F.size("g") == 0, F.col("complete"), F.size("e") == 0, F.col("expected"), F.col("e") == F.col("g")))
    rated = (F.size("e") > 0) & (F.size("g") > 0)

    def rate(value):
        return F.when(F.col("status") == "skipped_due_to_missing_gold_truth", None).when(F.col("status") == "expected_null", 1.0).when(rated, value).otherwise(0.0)

    f1 = 2 * both / (F.size("e") + F.size("g"))
    return met.select(
        "program_code", F.lit("prerequisite_keywords").alias("field"), F.col("e").alias("extracted_keywords"), F.col("g").alias("gold_keywords"), "status",
        F.coalesce(rate(f1), F.lit(0.0)).alias("score"), F.col("status").isin("matched", "expected_null").alias("exact_match"), F.col("expected").alias("coverage_expected"),
        rate(both / F.size("e")).alias("precision"), rate(both / F.size("g")).alias("recall"), rate(f1).alias("f1"),
    )


def field_results(records: DataFrame, gold: DataFrame) -> DataFrame:
    """All six fields in one long frame, with has_gold and has_extracted."""
    scalar = compare_scalars(records, gold)
    scalar = scalar.select("program_code", "field", "status", "score", "exact_match", normalize_scalar(F.col("gold")).isNotNull().alias("has_gold"), normalize_scalar(F.col("extracted")).isNotNull().alias("has_extracted"))
    sets = compare_keywords(records, gold)
    sets = sets.select("program_code", "field", "status", "score", "exact_match", (F.size("gold_keywords") > 0).alias("has_gold"), (F.size("extracted_keywords") > 0).alias("has_extracted"))
    return scalar.unionByName(sets)


def summarize(results: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each programme: counts, rates (null unless the benchmark is complete and something is required), field lists, status."""
    place = F.array_position(F.array(*map(F.lit, V.EVALUATED_FIELDS)), F.col("field"))
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(place.alias("p"), "field")))), lambda x: x["field"])
    out = results.groupBy("program_code").agg(
        F.count_if("has_gold").alias("required"), F.count_if(F.col("has_gold") & F.col("has_extracted")).alias("covered"),
        F.count_if(F.col("has_gold") & F.col("exact_match")).alias("matched"), F.count_if("has_extracted").alias("populated"),
        F.sum(F.when(F.col("has_gold"), F.col("score"))).alias("total"), names(F.col("has_gold")).alias("scored_fields"),
        names(F.col("status").isin("field_left_null", "missing_source_coverage")).alias("missing_fields"),
        names(F.col("status") == "skipped_due_to_missing_gold_truth").alias("skipped_fields"),
    ).join(gold.select("program_code", "label_status"), "program_code")
    status = benchmark_status(F.col("label_status"), F.col("required"))
    rate = lambda c: F.when(F.col("benchmark_status") == "completed", F.col(c) / F.col("required"))
    out = out.withColumn("benchmark_status", status)
    return out.select("program_code", "benchmark_status", "required", "covered", "matched", "populated", rate("total").alias("overall_field_score"), rate("covered").alias("field_coverage_rate"), rate("matched").alias("exact_match_rate"), "scored_fields", "missing_fields", "skipped_fields")


def benchmark_status(label_status: Column, required: Column) -> Column:
    ready = label_status.isin(V.READY_STATUSES)
    return (
        F.when(~ready & (required == 0), "skipped_due_to_incomplete_gold_label").when(~ready, "incomplete_gold_label").when(required == 0, "score_not_meaningful").otherwise("completed")
    )


def status_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("program_code", "status").agg(F.count("*").alias("n"))


def coverage_defaults(targets: DataFrame) -> DataFrame:
    """targets (program_code, seed_pages) -> (program_code, coverage map): a field is covered if a seed page intends it."""
    fields = F.array_distinct(F.flatten(F.transform("seed_pages", lambda p: p["intended_fields"])))
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), F.coalesce(F.array_contains(fields, f), F.lit(False)).alias("v")) for f in V.EVALUATED_FIELDS])
    return targets.select("program_code", F.map_from_entries(pairs).alias("coverage"))


def gold_draft(targets: DataFrame, records: DataFrame) -> DataFrame:
    """A label to be completed by hand, from the extracted record."""
    return targets.select("program_code", "university").join(records, "program_code", "left").select(
        "program_code", "university", F.lit("official_seed").alias("mode"), F.lit("manual_template_pending").alias("label_status"), *V.SCALAR_FIELDS, "prerequisite_keywords"
    )
