"""Cutting lineage by a table in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset one in the warehouse, which goes when a local program ends; on a
    cluster the warehouse has to be in a shared store, as a local folder is another one on each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quadrille-staged"
    if not spark.sparkContext.master.startswith("local"):
        if own.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    elif own not in _own:
        _own.add(own)
        atexit.register(shutil.rmtree, own.removeprefix("file:"), ignore_errors=True)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/quadrille/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
