"""Best-fit packing of token sequences by minimum bin slack.

Pieces of one length are alike, so packing needs their counts by length only: a table of at most `capacity` rows, whatever
the corpus. For one bin after the other the largest length left is put in and a bitset subset-sum finds the combination
of available lengths that fills the rest best; the combination is taken out as often as the counts allow, which is what
bin by bin would do. Every piece then finds its place by its rank among the pieces of its length, in Spark.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import in_steps, stage

# Fixed value: the published pattern by which byte-level vocabularies of this kind split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 200_000
_RANK_BITS = 44


@lru_cache(1)
def _encoder(vocabulary: bytes):
    """The byte-level vocabulary of a tokenizers file, as tiktoken runs it; a special token's string in a text is that token."""
    import tiktoken

    stored = json.loads(zlib.decompress(vocabulary))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {a["content"]: a["id"] for a in stored["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, word)): i for word, i in stored["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("stored", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special), special


def chunks(text: str, size: int = CHUNK):
    """Parts of a long text that are encoded on their own with the same ids: cut before a single space between two words."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while 0 < (cut := text.find(" ", cut)) < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut += 1
        if not 0 < cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, vocabulary: bytes) -> np.ndarray:
    encoding, special = _encoder(vocabulary)
    found = any(s in text for s in special)
    run = (lambda t: encoding.encode(t, allowed_special="all")) if found else encoding.encode_ordinary
    if len(text) <= CHUNK:
        return np.array(run(text), np.uint32)
    return np.concatenate([np.array(run(t), np.uint32) for t in chunks(text)])


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def cuts(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start, and its end: all but the first have the full length."""
    first = (length - 1) % capacity + 1
    return [0, *range(first, length + 1, capacity)]


def _pieces(vocabulary: bytes, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    end = np.array([end_id], np.uint32)

    def run(batches):
        for batch in in_steps(batches, 256):
            out = {n: [] for n in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or "", vocabulary), end]).astype("<u4", copy=False)
                at = cuts(len(ids), capacity)
                for k, (lo, hi) in enumerate(zip(at, at[1:])):
                    row = (doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), *([ids[lo:hi].astype(np.int32)] if with_ids else []))
                    for n, v in zip(names, row):
                        out[n].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names=names)

    return run


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) from counts whose sum comes nearest to room; of equal sums the one with the larger lengths first.

    A set bit t of a Python integer says that some choice of the copies so far has the sum t.
    """
    reach, taken, whole = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & whole
            if more == reach:
                break
            taken.append((length, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, before in reversed(taken):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen[::-1]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: copies})] that use up counts. Each entry leaves a length with fewer pieces than it takes, so their
    number is bounded by the capacity, not by the pieces."""
    left = {x: n for x, n in counts.items() if n > 0}
    plan = []
    while left:
        first = max(left)
        rest = {x: n - (x == first) for x, n in left.items() if n > (x == first)}
        copies: dict[int, int] = {first: 1}
        for x in fullest(rest, capacity - first):
            copies[x] = copies.get(x, 0) + 1
        times = min(left[x] // c for x, c in copies.items())
        plan.append((times, copies))
        left = {x: n for x, c in left.items() if (n := c - times * copies.get(x, 0))}
    return plan


def _placing(plan: list[tuple[int, dict[int, int]]]):
    """Rank of a piece among those of its length -> its sequence and place there."""
    used: dict[int, int] = {}
    entries, base = [], 0
    for times, copies in plan:
        place = 0
        for length, c in copies.items():
            entries.append((length << _RANK_BITS | used.get(length, 0), length, c, base, place))
            used[length] = used.get(length, 0) + c * times
            place += c * length
        base += times
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = t.column("length").to_numpy().astype(np.int64) << _RANK_BITS | t.column("rank").to_numpy()
            start, length, copies, first, place = table[np.searchsorted(table[:, 0], key, side="right") - 1].T
            nth = key - start
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(first + nth // copies))
            yield from t.append_column("offset", pa.array(place + nth % copies * length)).to_batches()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset), one row for each piece.

    A document is the ids of its text and end_id; a null text is empty, so its end id alone is a piece. A document of more than
    capacity ids is cut into pieces of that length, but for the first, which may be shorter. Sequences hold at most capacity ids; offsets
    are gapless from 0. Texts of any length are encoded in parts. Repeated rows, also those without a doc_id, are packed each;
    other columns are not looked at; an empty table gives an empty table. tokenizer_path is read on the driver.
    """
    vocabulary = load_vocabulary(tokenizer_path)
    ddl = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary, capacity, end_id, with_ids), ddl)
    pieces = stage(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")  # rid is fixed once it is staged
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    # ranks by parts of a length, so that one length can be a third of all pieces
    parts = max(1, 2 * int(max(counts.values(), default=0) ** 0.5))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("rid"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "part"])
    columns = [c for c in pieces.columns if c != "rid"]
    ranked = ranked.select(*columns, (F.col("before") + F.col("within") - 1).alias("rank"))
    placed = ranked.mapInArrow(_placing(plan_bins(counts, capacity)), ddl + ", sequence_id long, offset long")
    return placed.withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces with ids -> (sequence_id, ids, doc_ids): the sequences themselves, each of at most the capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    out = packed.groupBy("sequence_id").agg(own.alias("own"))
    return out.select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"), F.transform("own", lambda x: x["doc_id"]).alias("doc_ids"))
