"""Shared plumbing of the training-data operators: tables, staging, hashing of words and shingles."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import stage as stage

MASK = (1 << 64) - 1
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class WordHash(dict):
    """Word (bytes) -> 64-bit hash, remembered up to `bound` words."""

    def __init__(self, bound: int = 120_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def in_steps(batches, rows: int):
    """Record batches in slices of at most so many rows; unused memory goes back to the system at the end of a task, as the worker lives on."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * MIX_B
    return h ^ (h >> np.uint64(29))


def window_hashes(words: list[bytes], k: int, cache: WordHash) -> np.ndarray:
    """Hashes of the k-word windows in order; of the whole sequence if there are fewer words, none of no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.array(list(map(cache.__getitem__, words)), dtype=np.uint64)
    width = min(k, n)
    out = ids[: n - width + 1] * MIX_A
    for j in range(1, width):
        out = (out ^ (out >> np.uint64(32))) * MIX_A + ids[j : n - width + 1 + j]
    return mix(out + np.uint64(width))


def shingle_set(words: list[bytes], k: int, cache: WordHash) -> np.ndarray:
    """The distinct k-word shingles as a sorted array of 64-bit hashes."""
    return np.unique(window_hashes(words, k, cache))


def shingle_pool(words: list[bytes], sizes: np.ndarray, k: int, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(pool, counts): shingle_set of many sequences of at least one word, which follow one another in words, made at once; the sets follow one another too."""
    ids = np.zeros(len(words) + k, np.uint64)
    ids[: len(words)] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    counts = np.maximum(sizes - k + 1, 1)
    ends, width = np.cumsum(counts), np.repeat(np.minimum(sizes, k), counts)
    starts = ends - counts
    at = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - starts, counts)
    out, short = ids[at] * MIX_A, bool((sizes < k).any())
    for j in range(1, k):
        more = (out ^ (out >> np.uint64(32))) * MIX_A + ids[at + j]
        out = np.where(width > j, more, out) if short else more
    out = mix(out + width.astype(np.uint64))
    for a, b in zip(starts.tolist(), ends.tolist()):
        out[a:b].sort()
    keep = np.r_[True, out[1:] != out[:-1]]
    keep[starts] = True
    return out[keep], np.add.reduceat(keep.astype(np.int64), starts)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def set_id(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def set_ids(pool: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """set_id of the sets of a pool."""
    ends = np.cumsum(counts)
    raw = memoryview(pool.tobytes())
    found = (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((8 * (ends - counts)).tolist(), (8 * ends).tolist()))
    return np.fromiter(found, np.uint64, len(counts)).view(np.int64)


def within(few: DataFrame, bound: int) -> bool:
    """Whether few has at most bound rows: the check before any broadcast of data that could grow."""
    return few.limit(bound + 1).count() <= bound
