"""Grouping of spelling variants by rolling-hash deletion keys.

A word's key with one letter left out is its prefix hash up to that letter plus the hash of its suffix, moved by one:
with prefix sums of a polynomial hash all deletion keys of a batch of words are a few NumPy operations. Keys
are dealt out by their leading bits and sorted, so equal keys are neighbours. Words of one key that lack the same letter place
differ by a replacement there; a word whose own key is another's deletion key differs by an insertion. Equal keys
are held against the strings. Groups are summed up (size, the two largest words), never listed as pairs.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_steps, mix, stage

# What a run of letters is, and which runs lose a letter.
RUN = re.compile("[a-zÀ-ÿ]+")
DROP = 199
BASE = np.uint64(0x9E3779B97F4A7C15)
RADIX_BITS = 12
HELD = 100_000


def occurrences(doc_id: int | None, text: bytes):
    """The words of a text, in order: runs with A-Z lowered; one whose checksum with the doc_id is a multiple of DROP loses a letter."""
    seed = zlib.crc32((f"{doc_id}:" if doc_id is not None else ":").encode())
    known: dict[str, str] = {}
    for run in RUN.findall(text.lower().decode()):  # of bytes, lower() changes A-Z only
        word = known.get(run)
        if word is None:
            h, word = zlib.crc32(run.encode(), seed), run
            if h % DROP == 0:
                at = h % len(run)
                word = run[:at] + run[at + 1 :]
            known[run] = word
        yield word


def _counting(least: int):
    def run(batches):
        held: dict[str, int] = {}

        def out():
            words = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return words

        for batch in in_steps(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word in occurrences(doc_id, text.as_py() or b""):
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + 1
                        if len(held) >= HELD:
                            yield out()
        yield out()

    return run


def count_words(docs: DataFrame, least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """docs (doc_id, text) -> (word, n), counted in the tasks before they meet."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = few.mapInArrow(_counting(least_letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word's keys: (word's index, place left out or -1 for none, key, whether the letter before is another)."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - first[of]
    power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, BASE))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * power[place])])  # modulo 2^64; differences are prefix hashes
    moved = np.concatenate([[np.uint64(0)], np.cumsum(letters * np.where(place > 0, power[np.maximum(place - 1, 0)], np.uint64(0)))])
    prefix = sums[np.arange(len(letters))] - sums[first][of]
    suffix = moved[(first + size)[of]] - moved[np.arange(1, len(letters) + 1)]
    own = sums[first + size] - sums[first]
    key = mix(np.concatenate([prefix + suffix, own]) + np.concatenate([size[of] - 1, size]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    other = np.ones(len(letters), bool)
    other[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    rows = np.concatenate([of, np.arange(len(words))])
    return rows, np.concatenate([place, np.full(len(words), -1)]), key, np.concatenate([other, np.ones(len(words), bool)])


def _keying(batches):
    for batch in in_steps(batches, 4096):
        if not batch.num_rows:
            continue
        rows, place, key, first = deletion_keys(batch.column("word").to_pylist())
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array((key >> np.uint64(64 - RADIX_BITS)).astype(np.int32)), batch.column("word").take(take), batch.column("n").take(take), pa.array(place.astype(np.int32)), pa.array(first)],
            names=["key", "radix", "word", "n", "place", "first"],
        )


def _near(group: list[tuple]):
    """Rows (word, n, place, first) of one key -> (word, number of words near it, the largest of them and its n), for what meets in this key."""
    by_string: dict[str, list[tuple]] = {}
    for word, n, place, first in group:
        by_string.setdefault(word if place < 0 else word[:place] + word[place + 1 :], []).append((word, n, place, first))
    for same in by_string.values():  # more than one only where keys collide
        if len(same) < 2:
            continue
        own = next(((w, n) for w, n, place, _ in same if place < 0), None)
        longer = [(-n, w) for w, n, place, first in same if place >= 0 and first]  # one row for each word and string
        if own and longer:
            best = min(longer)
            yield own[0], len(longer), best[1], -best[0]
            for _, w in longer:
                yield w, 1, own[0], own[1]
        by_place: dict[int, list[tuple]] = {}
        for w, n, place, _ in same:
            if place >= 0:
                by_place.setdefault(place, []).append((-n, w))
        for members in by_place.values():
            if len(members) > 1:
                one, two = sorted(members)[:2]
                for m in members:
                    best = two if m == one else one
                    yield m[1], len(members) - 1, best[1], -best[0]


def _meeting(batches):
    """Rows sorted by key; a group that goes on in the next batch is carried over. A key's words are bounded by the letters that can stand at a place."""
    carried: list[tuple] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        found = []
        if last is not None and keys[0] != last:
            found += _near(carried)
            carried = []
        alone = ends - starts == 1
        alone[0] = alone[-1] = False
        columns = [batch.column(c) for c in ("word", "n", "place", "first")]
        for lo, hi in zip(starts[~alone].tolist(), ends[~alone].tolist()):
            rows = list(zip(*(c.slice(lo, hi - lo).to_pylist() for c in columns)))
            if lo == 0:
                rows = carried + rows
            if hi == len(keys):
                carried, last = rows, keys[-1]
            else:
                found += _near(rows)
        yield _batch(found)
    yield _batch(list(_near(carried)))


def _batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), distinct -> (word, n_near, best, best_n) of those that have a near word: one inserted, deleted or replaced letter.
    best: the near word of largest n, of equals the smallest in code-point order."""
    keys = words.select("word", "n").mapInArrow(_keying, "key long, radix int, word string, n long, place int, first boolean")
    found = keys.repartition("radix").sortWithinPartitions("key").mapInArrow(_meeting, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", F.col("top.w").alias("best"), (-F.col("top.m")).alias("best_n"))


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, factor: int = 5) -> DataFrame:
    """docs (doc_id, text) -> (word, form, root, n, n_near, form_n), one row for each word met least_n times.

    form: the near word of largest n if that is at least factor times the word's; root: where the forms lead to, the word itself if it
    has none. A null text has no words; in the checksum a row without a doc_id has an empty one. Texts are read whole; repeated rows count each; other
    columns are not looked at; an empty table gives an empty table.
    """
    words = stage(count_words(docs, least_letters, least_n), "words")
    met = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    rows = met.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))
    rows = stage(rows, "forms")
    # forms grow by the factor, so chains are short: every round doubles what a root has followed
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    largest, steps = rows.agg(F.max("n")).first()[0] or 0, 1
    while least_n * factor ** (steps + 1) <= largest:  # a chain of s steps ends at least_n * factor^s or more
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(next_, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
