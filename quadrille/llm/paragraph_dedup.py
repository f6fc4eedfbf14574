"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of a text. A line's set of k-word shingles (the whole line if shorter) is
MinHashed; band keys of few rows and many bands find pairs of the wanted similarity with high
recall. Colliding paragraphs are verified by exact Jaccard similarity and clustered into
components. Windows of min_words words, in lines or across them, add the exact repeats that lines
do not show. Neighbouring words that repeat elsewhere form one run; each word is a copy or at its first
place, and passages of min_words and more of a run are reported, copies as removed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHash, set_id, set_ids, shingle_pool, shingle_set, stage, within
from .linking import BITS, FACTS_SCHEMA, SET_SCHEMA, link_components, pool_facts, set_batch, shared_signatures
from .word_windows import repeated_windows

BROADCAST_IDS = 1_000_000
PERMUTATIONS = 30
SEEN, LEVELS = 300_000, 3


def tune_bands(similarity: float, recall: float = 0.99, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the similarity still collides with the recall."""
    best = (permutations, 1)
    for rows in range(1, 9):
        bands = permutations // rows
        if bands and 1 - (1 - similarity**rows) ** bands >= recall:
            best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows)
    return best


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


def _line_words(text: str | None) -> list[tuple[int, list[bytes]]]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
    return [(i, w) for i, line in enumerate(raw) if (w := line.split())]


PASSAGE_SCHEMA = "doc_id long, first_line int, last_line int, n_words long, component_id long, removed boolean, first_word int, last_word int"
STEP = 200_000


def band_names(bands: int) -> list[str]:
    return [f"k{b}" for b in range(bands)]


def line_schema(bands: int) -> str:
    return f"doc_id long, line int, at int, n_words int, cls long, {FACTS_SCHEMA}, " + ", ".join(f"{k} long" for k in band_names(bands))


def band_keys(pool: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) MinHash keys of the sets of a pool, none of them empty."""
    if not len(counts):
        return np.empty((0, bands), np.int64)
    seeds, starts = _seeds(bands * rows), np.cumsum(counts) - counts
    out = np.empty((len(counts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(counts), b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            h = pool * seeds[j]
            h ^= h >> np.uint64(32)
            key = (key ^ (key >> np.uint64(29))) * seeds[0] + np.minimum.reduceat(h, starts)
        out[:, b] = key
    return out.view(np.int64)


def _lines(k: int, bands: int, rows: int, least: int):
    """One row for each line with a word: doc_id, line number, words before and in it, class and facts of its shingle
    set; band keys where the line has `least` words and its class is new to the task."""

    def told(doc, at, before, n, words, cache, seen):
        pool, counts = shingle_pool(words, np.array(n), k, cache)
        facts, names = pool_facts(pool, counts)
        cls = set_ids(pool, counts)
        new = []
        for i, (c, size) in enumerate(zip(cls.tolist(), n)):
            if size >= least and c not in seen:
                seen.add(c)
                new.append(i)
        keys, mask = np.zeros((len(n), bands), np.int64), np.ones(len(n), bool)
        mask[new] = False
        keys[new] = band_keys(pool[np.repeat(~mask, counts)], counts[~mask], bands, rows)
        columns = [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(before, pa.int32()), pa.array(n, pa.int32()), pa.array(cls), *facts]
        columns += [pa.array(np.ascontiguousarray(keys[:, b]), pa.int64(), mask=mask) for b in range(bands)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "at", "n_words", "cls", *names, *band_names(bands)])

    def run(batches):
        cache, seen = WordHash(), set()
        for batch in batches:
            doc, n, words, at, before = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                past = 0
                for i, own in _line_words(text.as_py()):
                    doc.append(doc_id)
                    at.append(i)
                    before.append(past)
                    n.append(len(own))
                    past += len(own)
                    words += own
                if len(words) >= STEP:
                    if len(seen) >= SEEN:
                        seen.clear()
                    yield told(doc, at, before, n, words, cache, seen)
                    doc, n, words, at, before = [], [], [], [], []
            if doc:
                yield told(doc, at, before, n, words, cache, seen)

    return run


def _sets(k: int):
    def run(batches):
        cache = WordHash()
        for batch in batches:
            rows = []
            for cls, line, text in zip(*(batch.column(c).to_pylist() for c in ("cls", "line", "text"))):
                raw = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
                hashes = shingle_set(raw[line].split(), k, cache) if line < len(raw) else np.empty(0, np.uint64)
                if set_id(hashes) == cls:
                    rows.append((cls, hashes))
            if rows:
                yield set_batch(rows)

    return run


def _edges(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each stretch of true values."""
    turn = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).tolist()
    return list(zip(turn[::2], turn[1::2]))


def _of_document(rows: dict[str, np.ndarray], min_words: int):
    """(first line, last line, words, head, removed, first word, last word) of the passages of one document."""
    own, hit = np.flatnonzero(rows["line"] >= 0), np.flatnonzero(rows["hit"])
    starts, numbers = rows["at"][own], rows["line"][own]
    at, to, copy, head = rows["at"][hit], rows["at"][hit] + rows["n"][hit], rows["copied"][hit], rows["head"][hit]
    total = int(to.max())
    repeats, copied, heads = np.zeros(total, bool), np.zeros(total, bool), np.full(total, np.iinfo(np.int64).max)
    for a, b, c, h in zip(at.tolist(), to.tolist(), copy.tolist(), head.tolist()):
        repeats[a:b] = True
        if c:
            copied[a:b] = True
        np.minimum(heads[a:b], h, out=heads[a:b])
    gone = [x for x in _edges(copied) if x[1] - x[0] >= min_words]
    for a, b in gone:
        repeats[a:b] = False
    for removed, some in ((True, gone), (False, _edges(repeats))):
        for a, b in some:
            if b - a >= min_words:
                docs, words = np.unique(heads[a:b], return_counts=True)
                first, last = (int(numbers[np.searchsorted(starts, x, "right") - 1]) for x in (a, b - 1))
                yield first, last, b - a, int(docs[np.argmax(words)]), removed, a, b - 1


MARKS = ["doc_id", "at", "n", "line", "hit", "head", "copied"]


def _passages(min_words: int):
    """Of rows of MARKS sorted by doc_id, at: the passages of every document. line is -1 for stretches of windows."""

    def told(rows, doc_id):
        if rows["hit"].any():
            for out in _of_document(rows, min_words):
                yield doc_id, *out

    def batch_of(found):
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
        names = ["doc_id", "first_line", "last_line", "n_words", "component_id", "removed", "first_word", "last_word"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=names)

    def run(batches):
        held: list[dict[str, np.ndarray]] = []  # rows of the last document so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in MARKS}
            cut = np.flatnonzero(np.diff(rows["doc_id"])) + 1
            bounds, found = [0, *cut.tolist(), batch.num_rows], []
            for lo, hi in zip(bounds, bounds[1:]):
                part = {c: v[lo:hi] for c, v in rows.items()}
                if held and held[-1]["doc_id"][0] != part["doc_id"][0]:
                    found += told({c: np.concatenate([h[c] for h in held]) for c in MARKS}, int(held[-1]["doc_id"][0]))
                    held = []
                held.append(part)
            yield batch_of(found)
        if held:
            yield batch_of(list(told({c: np.concatenate([h[c] for h in held]) for c in MARKS}, int(held[-1]["doc_id"][0]))))

    return run


def document_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) -> the same with a key for each different text in place of doc_id, and (key, doc_id) of the keys
    that are no doc_id, or None. The key is the doc_id, but where several texts share one it is a hash of both."""
    ids = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = stage(ids.where("lo != hi").select("doc_id", F.lit(True).alias("several")), "several")
    if several.isEmpty():
        return docs, None
    key = F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = docs.join(several, "doc_id", "left").select(key.alias("key"), "doc_id", "text", "several")
    return keyed.select(F.col("key").alias("doc_id"), "text"), keyed.where("several").select("key", "doc_id").distinct()


def repeated_passages(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, min_words: int = 50, recall: float = 0.99) -> DataFrame:
    """docs (doc_id, text) -> PASSAGE_SCHEMA: one row for each passage of at least min_words words that repeats in other places.

    Words repeat if they lie in a window of min_words words (A-Z lower-cased, in a line or across lines) that has another
    place, or in a line whose set of distinct k-word shingles (the whole line if shorter) has a Jaccard similarity
    of at least num/den with a line elsewhere, over any chain of such lines; places are in other documents or in the same
    one without overlap. The head is the first place by doc_id and position; words are copies if a window or line
    that holds them has an earlier head. Of each run of neighbouring repeating words, every stretch of min_words
    copies and more is a passage with removed true; what is left between them (first places, with shorter copies, which stay) is one
    with removed false if it has min_words. component_id is the doc_id of the head that most words of the passage have,
    first_word and last_word count the words of the text from 0.
    Null and empty texts have no lines; rows without a doc_id are left out; very long texts are read whole;
    repeated rows are one document. Different texts under one doc_id are documents of their own, which count as later or earlier
    by a hash; their passages come under that doc_id. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs, names = document_keys(docs)
    bands, rows = tune_bands(num / den, recall)
    keys = band_names(bands)
    lines = stage(docs.mapInArrow(_lines(k, bands, rows, k + 1), line_schema(bands)), "lines")

    place = F.struct("doc_id", "line")
    classes = stage(lines.groupBy("cls").agg(F.min(place).alias("first"), F.max(place).alias("last"), *[F.min(c).alias(c) for c in ("n", *BITS, *keys)]), "classes")
    shared = shared_signatures(classes.where(F.col(keys[0]).isNotNull()).select(F.explode(F.array(*keys)).alias("sig"), "cls"))

    def fetch(wanted, maps):
        side = stage(classes.join(wanted, "cls").select("cls", "first.*"), "wanted")
        side = F.broadcast(side) if within(side, BROADCAST_IDS) else side
        return docs.join(side, "doc_id").select("cls", "line", "text").mapInArrow(_sets(k), SET_SCHEMA).dropDuplicates(["cls"])

    found = link_components(shared, classes.select("cls", "n", *BITS), fetch, num, den, levels=LEVELS)
    classes = classes.select("cls", "first", "last")
    lines = lines.select("doc_id", "line", "at", "n_words", "cls")

    labelled = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"), F.max("last").alias("last")).where("head != last").drop("last")
    repeats = stage(labelled.select("cls", "label").join(heads, "label").select("cls", "head"), "repeats")
    earlier = (F.col("head.doc_id") != F.col("doc_id")) | (F.col("head.line") != F.col("line"))
    marked = lines.join(repeats, "cls", "left").select(
        "doc_id", "at", F.col("n_words").alias("n"), "line", F.col("head").isNotNull().alias("hit"), F.coalesce("head.doc_id", "doc_id").alias("head"), F.coalesce(earlier, F.lit(False)).alias("copied")
    )
    windows = repeated_windows(docs, min_words).select("doc_id", "at", "n", F.lit(-1).alias("line"), F.lit(True).alias("hit"), "head", "copied")
    marked = marked.union(windows).repartition("doc_id").sortWithinPartitions("doc_id", "at", "line")
    out = marked.mapInArrow(_passages(min_words), PASSAGE_SCHEMA)
    if names is None:
        return out
    for column in ("doc_id", "component_id"):
        own = names.select(F.col("key").alias(column), F.col("doc_id").alias("own"))
        out = out.join(own, column, "left").withColumn(column, F.coalesce("own", column)).drop("own")
    return out.select(*[c.split()[0] for c in PASSAGE_SCHEMA.split(", ")])
