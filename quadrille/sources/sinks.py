"""Writers: JSON, CSV and Markdown, partitioned by run mode where there are several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reports import EXPORT_COLUMNS, markdown_row

FORMATS = ["json", "csv", "markdown"]


def parse_formats(raw: str) -> list[str]:
    """Comma-separated formats, each once, in the order given."""
    wanted = list(dict.fromkeys(x.strip().lower() for x in raw.split(",") if x.strip()))
    if unknown := [x for x in wanted if x not in FORMATS]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    if not wanted:
        raise ValueError("no format given")
    return wanted


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def artifact_id(*columns: Column) -> Column:
    """Eight hex digits that depend on the row only, so that a repeated run writes the same names."""
    return F.lower(F.substring(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"), 1, 8))


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_exports(rows: DataFrame, path: str, formats: list[str]) -> list[str]:
    """rows of export_rows to path/<format>; returns the folders written."""
    for kind in formats:
        out = f"{path}/{kind}"
        if kind == "json":
            rows.write.mode("overwrite").json(out)
        elif kind == "csv":
            rows.write.mode("overwrite").option("header", True).csv(out)
        else:
            rows.select(markdown_row(EXPORT_COLUMNS).alias("value")).write.mode("overwrite").text(out)
    return [f"{path}/{k}" for k in formats]


def write_batch(rows: DataFrame, path: str, mode: str, batch: str) -> str:
    """rows as JSON under path/run_mode=<mode>/batch=<batch>. A batch that is written again takes its own place only, so a repeated run leaves
    the same rows and the batches of other runs stay."""
    named = rows.drop("run_mode", "batch").withColumns({"run_mode": F.lit(mode), "batch": F.lit(batch)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_mode", "batch").json(path)
    return path


def named(rows: DataFrame, *key: str, suffix: Column | None = None) -> DataFrame:
    """rows with artifact_name: the slug of their first key column, digits that depend on the key only, and a suffix."""
    parts = [slug(F.col(key[0]).cast("string")), artifact_id(*[F.col(k).cast("string") for k in key]), *([slug(suffix)] if suffix is not None else [])]
    return rows.withColumn("artifact_name", F.concat(F.concat_ws("-", *parts), F.lit(".json")))


def write_run(run, store: DataFrame, path: str, mode: str, batch: str) -> dict[str, str]:
    """The artifacts of a run: raw captures, processed records, debug reports and rejects -> folder of each."""
    from ..operators.audit import debug_report

    place = F.concat_ws("-", F.regexp_replace("stage", "_", "-"), F.col("position").cast("string"))
    pages = run.pages.select(run.key, "position", "stage", "source_url", "page_title").join(store.groupBy("source_url").agg(F.min("body_text").alias("body_text")), "source_url")
    found = {
        "raw": named(pages, run.key, "source_url", suffix=place),
        "processed": named(run.records, run.key),
        "debug": named(debug_report(run, mode), run.key),
        "rejects": run.rejects,
    }
    return {kind: write_batch(rows, f"{path}/{kind}", mode, batch) for kind, rows in found.items()}
