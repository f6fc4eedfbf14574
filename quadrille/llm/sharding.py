"""Sharding by vector bin packing over bytes, tokens and rows.

Rows with equal texts form a group, placed as one. Each group goes to the shard where the dot
product of its demand with the shard's residual capacity is highest. The few groups beyond a grain of a
shard (a number bounded by shards and grain) are placed first, together, largest first; one that no shard
has room for, so that the law could not hold, is dealt out row by row in pieces of the grain. The many small
groups are dealt to workers by hash; each worker packs its own, largest first, into its share of what is left,
so nothing but large groups ever meets in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stage

DIMS = ["bytes", "tokens", "rows"]


def place(demands: np.ndarray, residual: np.ndarray, slack: float = 0.0, spill: bool = True) -> np.ndarray:
    """Shard of each demand (n, 3), in the given order; residual (shards, 3) is used up in place.

    It is the one with the highest dot product among the shards with room for the bytes (the first dimension) but for slack.
    Where there is none: the one with most room, or -1 without spill.
    """
    out = np.full(len(demands), -1, np.int32)
    for i, d in enumerate(demands):
        # capacities count relative to what a shard has left in all, so no dimension drowns another
        worth = np.where(residual[:, 0] >= d[0] - slack, residual @ d, -np.inf)
        best = int(np.argmax(worth))
        if worth[best] == -np.inf:
            if not spill:
                continue
            best = int(np.argmax(residual[:, 0]))
        out[i] = best
        residual[best] -= d
    return out


def _packing(shards: int, capacity: np.ndarray, workers: int, totals: np.ndarray):
    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        demand = np.stack([t.column(c).to_numpy() for c in DIMS], axis=1) / totals
        key, worker = t.column("gkey").to_numpy(), t.column("worker").to_numpy()
        for w in np.unique(worker):
            own = np.flatnonzero(worker == w)
            own = own[np.lexsort((key[own], -demand[own].sum(axis=1)))]
            # this worker's share of what the large groups left, shifted so that its groups just fit
            share = capacity / workers
            share = share + (demand[own].sum(axis=0) - share.sum(axis=0)) / shards
            shard = place(demand[own], share)
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(shard)], names=["gkey", "shard"])

    return run


def n_words(text):
    """Words [^\\x20\\x09-\\x0D]+ of a column."""
    bare = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = 40, grain: int = 64, groups_per_worker: int = 20_000, slots_per_bucket: int = 250_000) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, shard, slot), one row for each row of docs.

    size: UTF-8 bytes of the text plus 16; a null text has no bytes and the checksum of none, and is of the group
    of empty texts. Shards are near equal in bytes, and as equal as the groups allow in tokens (words) and rows. Rows with equal
    texts share a shard, whatever their doc_id, unless no shard has room for them (but for 1/grain of a shard): only such
    groups are split, row by row, so copies of a text that is a third of all rows spread over all shards, under one doc_id as well. A single text
    larger than a shard stays whole. Slots run gaplessly from 0 in each shard. Repeated rows are placed as they are; other columns are not
    looked at; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        n_words(text).alias("tokens"),
        F.xxhash64(text, F.octet_length(text)).alias("gkey"),
        F.monotonically_increasing_id().alias("uid"),  # fixed once it is staged
    )
    rows = stage(rows, "rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = rows.agg(*sums).first()
    if not totals["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total = np.array([max(1.0, float(totals[c])) for c in DIMS])
    groups = rows.groupBy("gkey").agg(*sums)
    part = F.greatest(*[F.col(c) / float(t) for c, t in zip(DIMS, total)]) * (shards * grain)
    groups = stage(groups.withColumn("grains", F.ceil(part).cast("int")), "groups")

    # at most 3 * shards * grain groups are this large
    large = groups.where("grains > 1").orderBy(F.desc("bytes"), "gkey").collect()
    demands = np.array([[g[c] for c in DIMS] for g in large], float).reshape(-1, 3) / total
    whole = place(demands, np.full((shards, 3), 1.0 / shards), 1 / (shards * grain), spill=False)
    pieces = spark.createDataFrame([(g["gkey"], g["grains"] if at < 0 and g["rows"] > 1 else 1) for g, at in zip(large, whole)], "gkey long, pieces int")
    keyed = rows.join(F.broadcast(pieces), "gkey", "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("uid"), "pieces")).otherwise(0).cast("int"))
    parts = keyed.where("pieces is not null").groupBy("gkey", "piece").agg(*sums).orderBy(F.desc("bytes"), "gkey", "piece").collect()  # as bounded as large
    demands = np.array([[p[c] for c in DIMS] for p in parts], float).reshape(-1, 3) / total
    residual = np.full((shards, 3), 1.0 / shards)
    placed = place(demands, residual, 1 / (shards * grain))  # a single text larger than any room goes where most is
    fixed = spark.createDataFrame([(p["gkey"], p["piece"], int(s)) for p, s in zip(parts, placed)], "gkey long, piece int, shard int")

    n_small = groups.count() - len(large)
    workers = max(1, -(-n_small // groups_per_worker))
    small = groups.where("grains <= 1").withColumn("worker", F.pmod(F.xxhash64("gkey", F.lit(1)), F.lit(workers)).cast("int"))
    small = small.select("gkey", *DIMS, "worker").repartition(workers, "worker").mapInArrow(_packing(shards, residual, workers, total), "gkey long, shard int")
    columns = ["doc_id", "size", "text_crc32", "uid", "shard"]
    out = keyed.where("pieces is not null").join(F.broadcast(fixed), ["gkey", "piece"]).select(*columns)
    out = out.union(keyed.where("pieces is null").join(small, "gkey").select(*columns))
    buckets = max(8, -(-totals["rows"] // (shards * slots_per_bucket)))
    out = stage(out.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(2)), F.lit(buckets)).cast("int")), "placed")
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    first = counts.select("shard", "bucket", (F.sum("c").over(W.partitionBy("shard").orderBy("bucket")) - F.col("c")).alias("start"))
    local = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "uid"))
    out = out.withColumn("local", local).join(first, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("local") - 1).alias("slot"))
