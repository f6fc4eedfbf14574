"""N-gram Jaccard join: prefixes of token combinations.

Tokens are the distinct k-word shingles of a document, in a global order from rare to
frequent. Two sets that reach the threshold differ in at most tau = n - ceil(t * n) tokens of
either side, so a long enough prefix must agree somewhere. Rare tokens are indexed singly.
Frequent tokens fall into sub-classes by hash and are indexed as 2-token combinations inside a
sub-class; the prefix is extended until (rare tokens) + sum(max(0, tokens of a sub-class - 1))
exceeds tau, so that by the pigeonhole principle two linked sets share a rare token or two
frequent tokens of one sub-class. The number of sub-classes follows the size band of a set; a
set is indexed for its own band and the one below, so two linked sets always meet in one band.
Frequencies come from a count sketch over every shingle of every document: each task adds up its own,
and slices of it are summed in two steps, so that what is moved is a fixed part of the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, in_steps, mix, set_id, shingle_set, stage, within
from .linking import BITS, FACTS_SCHEMA, SET_SCHEMA, fact_arrays, link_components, set_batch, shared_signatures, wide_map

BUCKETS, SLICE, FANIN = 1 << 20, 4096, 64
SEEN, STEP = 300_000, 250
BAND = 1.25
PER_SUBCLASS = 4
BROADCAST_IDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased (bytes.lower and bytes.split do just that)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


PROFILE_SCHEMA = f"rid long, doc_id long, cls long, {FACTS_SCHEMA}, slice int, lane int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the least number of bytes each; the length tells which."""
    most = counts.max()
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint64).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.uint64}[len(raw) // SLICE])


def _profile(k: int):
    """Per document its class, set size and parity map; at the end of a task the sketch of its shingles."""
    names = ["rid", "doc_id", "cls", "n", *BITS, "slice", "lane", "counts"]

    def run(batches):
        cache, sketch = WordHash(), np.zeros(BUCKETS, np.int64)
        for batch in in_steps(batches, STEP):
            sets = [shingle_set(words_of(t.as_py()), k, cache) for t in batch.column("text")]
            for h in sets:
                np.add.at(sketch, (h % np.uint64(BUCKETS)).astype(np.int64), 1)
            m = len(sets)
            facts, _ = fact_arrays(sets)
            cls = pa.array([set_id(h) if len(h) else None for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), cls, *facts, *[pa.nulls(m, pa.int32())] * 2, pa.nulls(m, pa.binary())], names=names)
        parts = [i for i in range(0, BUCKETS, SLICE) if sketch[i : i + SLICE].any()]
        m, lane = len(parts), TaskContext.get().partitionId() % FANIN
        none = [*[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * 4]
        yield pa.RecordBatch.from_arrays([*none, pa.array([i // SLICE for i in parts], pa.int32()), pa.array([lane] * m, pa.int32()), pa.array([_packed(sketch[i : i + SLICE]) for i in parts], pa.binary())], names=names)

    return run


def _summed(batches):
    """Rows (slice, lane, counts) sorted by slice, lane -> one row for each, with the sum."""
    at, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["slice", "lane", "counts"])
    for batch in batches:
        for i, lane, raw in zip(batch.column("slice").to_pylist(), batch.column("lane").to_pylist(), batch.column("counts").to_pylist()):
            if at != (i, lane):
                if at is not None:
                    yield row()
                at, total = (i, lane), np.zeros(SLICE, np.uint64)
            total += _unpacked(raw)
    if at is not None:
        yield row()


def shingle_loads(slices: DataFrame) -> np.ndarray:
    """(slice, lane, counts) of all tasks -> the BUCKETS counts of the whole corpus, a fixed number of bytes."""
    lanes = slices.repartition("slice", "lane").sortWithinPartitions("slice", "lane").mapInArrow(_summed, "slice int, lane int, counts binary")
    whole = lanes.withColumn("lane", F.lit(0)).repartition("slice").sortWithinPartitions("slice", "lane").mapInArrow(_summed, "slice int, lane int, counts binary")
    out = np.zeros(BUCKETS, np.int64)
    for r in whole.collect():  # at most BUCKETS / SLICE rows
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _unpacked(bytes(r["counts"]))
    return out


def tau_of(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den


def signatures(hashes: np.ndarray, sketch: np.ndarray, frequent: float, num: int, den: int) -> np.ndarray:
    """All index keys of one set; none for sets that link with equal sets only."""
    n = len(hashes)
    if n * den < num * (n + 1) and (n - 1) * den < num * n:  # no set of another size or content can reach num/den
        return np.empty(0, np.uint64)
    load = sketch[(hashes % np.uint64(len(sketch))).astype(np.int64)]
    order = np.lexsort((hashes, load))
    hashes, load = hashes[order], load[order]
    rare, tau = int(np.searchsorted(load, frequent, side="right")), tau_of(n, num, den)
    if rare > tau:
        return hashes[: tau + 1]
    out, tail, band = [hashes[:rare]], hashes[rare:], int(math.log(n) / math.log(BAND))
    for scheme in (band - 1, band):
        subs = max(1, tau_of(int(BAND**scheme) + 1, num, den) // PER_SUBCLASS)
        sub = (mix(tail) % np.uint64(subs)).astype(np.int64)
        first_seen = np.zeros(len(tail), bool)
        first_seen[np.unique(sub, return_index=True)[1]] = True
        reach = np.searchsorted(rare + np.cumsum(~first_seen), tau + 1) + 1
        head, sub = tail[:reach], sub[:reach]
        by = np.lexsort((head, sub))
        head, sub = head[by], sub[by]
        for d in range(1, int(np.bincount(sub).max(initial=0))):
            same = sub[d:] == sub[:-d]
            if not same.any():
                break
            out.append(mix(head[:-d][same] * np.uint64(3) + mix(head[d:][same] + np.uint64(scheme + 7))))
    return np.unique(np.concatenate(out))


def _posting(k: int, sketch, frequent: float, num: int, den: int):
    def run(batches):
        cache, counts, seen = WordHash(), sketch.value, set()
        for batch in in_steps(batches, STEP):
            sigs, ids = [], []
            for text in batch.column("text"):
                hashes = shingle_set(words_of(text.as_py()), k, cache)
                if not len(hashes) or (cls := set_id(hashes)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                got = signatures(hashes, counts, frequent, num, den)
                if len(got):
                    sigs.append(got.view(np.int64))
                    ids.append(np.full(len(got), cls, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "cls"])

    return run


def _sets(k: int, maps: bool):
    def run(batches):
        cache = WordHash()
        for batch in in_steps(batches, STEP):
            rows = []
            for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist()):
                hashes = shingle_set(words_of(text), k, cache)
                if set_id(hashes) != cls:  # another row with the same hash
                    continue
                rows.append((cls, wide_map(hashes) if maps else hashes))
                if len(rows) >= 200:
                    yield set_batch(rows)
                    rows = []
            if rows:
                yield set_batch(rows)

    return run


def ngram_jaccard_components(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (doc_id, n_shingles, component_id), one row for each input row.

    Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of
    at least num/den; component_id is the smallest doc_id reachable by links. A text of fewer
    than k words is one shingle; null, empty and blank texts have an empty set, link with
    nothing and keep their own doc_id. Rows without a doc_id link by their texts like all others; component_id is
    the smallest doc_id that is there, and null if there is none. Repeated rows stay repeated; rows with equal sets are one
    class; different texts may share a doc_id. Very long texts are read whole. Other columns are not looked at. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    profile = stage(docs.mapInArrow(_profile(k), PROFILE_SCHEMA), "profile")
    rows = profile.where("slice is null").select("rid", "doc_id", "n", "cls", *BITS)
    counts = shingle_loads(profile.where("slice is not null").select("slice", "lane", "counts"))
    frequent = 4 * counts.mean() + 64

    sketch = spark.sparkContext.broadcast(counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
    shared = shared_signatures(docs.select("text").mapInArrow(_posting(k, sketch, frequent, num, den), "sig long, cls long"))

    classes = stage(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("rid").alias("rid"), *[F.min(c).alias(c) for c in ("n", *BITS)]), "classes")

    def fetch(wanted, maps):
        side = stage(classes.join(wanted, "cls").select("cls", "rid"), "wanted")
        side = F.broadcast(side) if within(side, BROADCAST_IDS) else side
        return docs.join(side, "rid").select("cls", "text").mapInArrow(_sets(k, maps), SET_SCHEMA).dropDuplicates(["cls"])

    found = link_components(shared, classes.drop("first", "rid"), fetch, num, den, wide=True, load=sketch)
    classes = classes.select("cls", "first")

    named = found.join(classes.withColumnRenamed("cls", "node"), "node")
    heads = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = named.join(heads, "label").select(F.col("node").alias("cls"), "component_id")
    by_class = classes.join(by_class, "cls", "left").select("cls", F.coalesce("component_id", "first").alias("component_id"))
    out = rows.join(by_class, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
