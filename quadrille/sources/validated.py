"""JSON inputs read with their types checked: what is right as rows, what is not as rejects with a reason for each file or item.

Files are read whole and parsed to variants, so a number where a text belongs is seen as such and not turned into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

REJECTS = "file string, item string, reason string"
TARGET = "university string, program_code string, program_name string, tier string, seed_pages array<struct<page_type:string,url:string,priority:int,intended_fields:array<string>>>"
SEED_KEYS, TARGET_KEYS = ["page_type", "url", "priority"], ["university", "program_code", "program_name", "tier"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, json): each file as a variant, null where it is no JSON."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("json"))


def kind(variant: Column, path: str = "$") -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, VOID for null, a number's type; null where there is nothing."""
    at = F.try_variant_get(variant, path, "variant")
    return F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0)


def _first_reason(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for wrong, reason in reversed(checks):
        out = F.when(F.coalesce(wrong, F.lit(True)), reason).otherwise(out)
    return out


def _missing(variant: Column, path: str) -> Column:
    return kind(variant, path).isNull()


def read_targets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registry files {"targets": [...]} -> (targets, rejects). A target needs its four texts and a list of seed pages that have
    a type, a URL and a whole number as priority; intended_fields may be left out."""
    docs = files(spark, path)
    whole = _first_reason((F.col("json").isNull(), "no JSON"), (~kind(F.col("json"), "$.targets").eqNullSafe(F.lit("ARRAY")), "no list of targets"))
    docs = docs.withColumn("reason", whole)
    items = docs.where("reason is null").select("file", F.posexplode(F.try_variant_get("json", "$.targets", "array<variant>")).alias("pos", "t"))
    t, seeds = F.col("t"), F.try_variant_get("t", "$.seed_pages", "array<variant>")
    bad_seed = F.exists(seeds, lambda s: reduce(lambda a, b: a | b, [F.try_variant_get(s, f"$.{k}", "string").isNull() for k in SEED_KEYS]) | F.try_variant_get(s, "$.priority", "int").isNull())
    bad_list = F.exists(seeds, lambda s: F.try_variant_get(s, "$.intended_fields", "array<string>").isNull() & F.try_variant_get(s, "$.intended_fields", "variant").isNotNull())
    checks = [(~kind(t).eqNullSafe(F.lit("OBJECT")), "a target is no object"), *[(_missing(t, f"$.{k}"), f"no {k}") for k in TARGET_KEYS]]
    checks += [(F.coalesce(F.size(seeds), F.lit(0)) <= 0, "no seed pages"), (bad_seed, "a seed page without page_type, url or a whole priority"), (bad_list, "intended_fields is no list")]
    items = items.withColumn("reason", _first_reason(*checks))
    pages = F.transform(
        seeds,
        lambda s: F.struct(
            *[F.try_variant_get(s, f"$.{k}", "string").alias(k) for k in SEED_KEYS[:2]], F.try_variant_get(s, "$.priority", "int").alias("priority"),
            F.coalesce(F.try_variant_get(s, "$.intended_fields", "array<string>"), F.array().cast("array<string>")).alias("intended_fields"),
        ),
    )
    good = items.where("reason is null").select(*[F.try_variant_get("t", f"$.{k}", "string").alias(k) for k in TARGET_KEYS], pages.alias("seed_pages"))
    name = F.coalesce(F.try_variant_get("t", "$.program_code", "string"), F.concat(F.lit("#"), F.col("pos").cast("string")))
    rejects = docs.where("reason is not null").select("file", F.lit(None).cast("string").alias("item"), "reason")
    return good, rejects.unionByName(items.where("reason is not null").select("file", name.alias("item"), "reason"))


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label files, one label each -> (labels, rejects). Scalar fields are texts or null, keywords a list or null; of the
    coverage only the known fields count; mode and label_status have defaults."""
    docs = files(spark, path)
    j = F.col("json")
    scalar = lambda f: F.coalesce(kind(j, f"$.fields.{f}"), F.lit("VOID")).isin("STRING", "VOID")
    checks = [(j.isNull(), "no JSON"), *[(_missing(j, f"$.{k}"), f"no {k}") for k in ("program_code", "university")], (~kind(j, "$.fields").eqNullSafe(F.lit("OBJECT")), "fields is no object")]
    checks += [(~scalar(f), f"{f} is neither a text nor null") for f in V.SCALAR_FIELDS]
    checks += [(~F.coalesce(kind(j, "$.fields.prerequisite_keywords"), F.lit("VOID")).isin("ARRAY", "VOID"), "prerequisite_keywords is no list")]
    checks += [(~F.coalesce(kind(j, "$.coverage_expectations"), F.lit("OBJECT")).isin("OBJECT"), "coverage_expectations is no object")]
    docs = docs.withColumn("reason", _first_reason(*checks))
    text = lambda p: F.try_variant_get("json", p, "string")
    truth = lambda f: F.coalesce(F.try_variant_get("json", f"$.coverage_expectations.{f}", "boolean"), text(f"$.coverage_expectations.{f}").isNotNull() & (text(f"$.coverage_expectations.{f}") != ""))
    known = F.array_compact(F.array(*[F.when(kind(F.col("json"), f"$.coverage_expectations.{f}").isNotNull(), F.struct(F.lit(f).alias("k"), truth(f).alias("v"))) for f in V.EVALUATED_FIELDS]))
    good = docs.where("reason is null").select(
        text("$.program_code").alias("program_code"), text("$.university").alias("university"), F.coalesce(text("$.mode"), F.lit("official_seed")).alias("mode"), F.coalesce(text("$.label_status"), F.lit("manual")).alias("label_status"),
        text("$.notes").alias("notes"), F.map_from_entries(known).alias("coverage"), *[text(f"$.fields.{f}").alias(f) for f in V.SCALAR_FIELDS],
        F.coalesce(F.try_variant_get("json", "$.fields.prerequisite_keywords", "array<string>"), F.array().cast("array<string>")).alias("prerequisite_keywords"), "file",
    )
    return good, docs.where("reason is not null").select("file", F.lit(None).cast("string").alias("item"), "reason")
