"""The newest export of every programme, kept as files arrive in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import EXPORT_COLUMNS


def stream_latest(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (program_code, stem, the other columns of an export): of each programme the export with the largest file stem so far.

    The state store holds one row for each programme, its newest export; a file that comes late with a smaller stem changes
    nothing. Blank codes go. To be written in update or complete mode.
    """
    rows = spark.readStream.schema(", ".join(f"{c} string" for c in EXPORT_COLUMNS)).option("maxFilesPerTrigger", files_per_batch).option("multiLine", True).json(folder)
    rows = rows.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).where(F.trim(F.coalesce("program_code", F.lit(""))) != "")
    others = [c for c in EXPORT_COLUMNS if c != "program_code"]
    newest = rows.groupBy("program_code").agg(F.max(F.struct("stem", *others)).alias("newest"))
    return newest.select("program_code", "newest.*")
