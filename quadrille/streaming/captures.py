"""Line extraction over a folder of captures as it grows: the narrow part of the batch plan, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

SCHEMA = "source_url STRING, page_title STRING, body_text STRING, captured_at TIMESTAMP"


def stream_amounts(spark: SparkSession, folder: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Stream of (window, n_pages, n_amounts, max_amount) from JSON captures; late pages count until the watermark passes."""
    pages = spark.readStream.schema(SCHEMA).json(folder)
    text = T.normalize(F.concat_ws("\n", "page_title", "body_text"))
    found = pages.select("captured_at", T.amounts(text).alias("amounts"))
    return (
        found.withWatermark("captured_at", late).groupBy(F.window("captured_at", window).alias("window"))
        .agg(F.count("*").alias("n_pages"), F.sum(F.size("amounts")).alias("n_amounts"), F.max(F.array_max("amounts")).alias("max_amount"))
    )


def stream_deadlines(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (source_url, deadline): the first date on a page that names a deadline."""
    pages = spark.readStream.schema(SCHEMA).json(folder)
    text = T.normalize(F.concat_ws(" ", "page_title", "body_text"))
    return pages.select("source_url", text.alias("text")).where(T.any_of(F.lower("text"), V.DEADLINE_LABELS) & T.has_date(F.col("text"))).select("source_url", T.extract_date(F.col("text")).alias("deadline"))
