"""Exact repeats of `width` words and more anywhere in a text, in lines or across them.

Every window of `width` words is dealt by the smallest hash among its shorter windows of `part` words: equal
windows have the same one, and neighbouring windows mostly share it, so that one row carries a stretch of windows.
One exchange brings all places of a window together, sorted by document and position: the first is its head.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import MIX_A, WordHash, mix

SPAN_SCHEMA = "doc_id long, at int, n int, head long, copied boolean"
BLOCK_WORDS, BLOCK_ROWS = 200_000, 30_000
KEPT = 6  # bytes of a window's hash that are moved; it is compared only with windows of the same 64-bit part


def _whole(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, KEPT)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :KEPT] = raw
    return out.view(np.uint64).ravel()


def _doubled(values: np.ndarray, width: int, join) -> np.ndarray:
    """join over all windows of `width` values, by windows of doubled length; the last two may overlap."""
    size = 1
    while 2 * size <= width:
        values, size = join(values[:-size], values[size:]), 2 * size
    return join(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def span_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words, of at least that many words."""
    return _doubled(ids, width, lambda a, b: mix(a * MIX_A + (b ^ (b >> np.uint64(32)))))


def _stretches(width: int, part: int):
    """Rows of neighbouring windows with one smallest part: that part's hash, doc_id, place of the first, hashes of all."""

    def block(docs, sizes, words, cache):
        ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        least = _doubled(span_hashes(ids, part), width - part + 1, np.minimum)
        hashes, of = span_hashes(ids, width), np.repeat(np.arange(len(sizes)), sizes)[: len(words) - width + 1]
        ends = np.cumsum(sizes)
        at = np.flatnonzero(np.arange(len(of)) + width <= ends[of])
        least, hashes, of = least[at], hashes[at], of[at]
        first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])])
        offsets = (np.r_[first, len(at)] * KEPT).astype(np.int32)
        low = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :KEPT])
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
        place = at[first] - (ends - sizes)[of[first]]
        return pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(np.array(docs, np.int64)[of[first]]), pa.array(place.astype(np.int32)), packed], names=["part", "doc_id", "at", "hashes"])

    def run(batches):
        cache = WordHash()
        for batch in batches:
            docs, sizes, words = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                if len(own) >= width:
                    docs.append(doc_id)
                    sizes.append(len(own))
                    words += own
                if len(words) >= BLOCK_WORDS:
                    yield block(docs, np.array(sizes), words, cache)
                    docs, sizes, words = [], [], []
            if words:
                yield block(docs, np.array(sizes), words, cache)

    return run


def _repeats(width: int):
    """Of rows sorted by part, doc_id, at: the stretches of windows that have another place that does not overlap."""

    def block(batch, past):
        part, doc, at = (batch.column(c).to_numpy() for c in ("part", "doc_id", "at"))
        again = part[1:] == part[:-1]
        sizes = pc.binary_length(batch.column("hashes")).to_numpy().astype(np.int64) // KEPT
        # a part met once can repeat only in itself, if it reaches beyond one window
        keep = np.r_[False, again] | np.r_[again, False] | (part == part[-1]) | (part == past["part"]) | (sizes > width)
        part, doc, at, sizes, packed = part[keep], doc[keep], at[keep], sizes[keep], batch.column("hashes").filter(pa.array(keep)).to_pylist()
        row = np.repeat(np.arange(len(sizes)), sizes)
        h = np.r_[past["h"], _whole(packed)]
        d = np.r_[past["d"], doc[row]]
        p = np.r_[past["p"], at[row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]]
        told = np.r_[past["told"], np.zeros(len(row), bool)]
        owner = np.r_[np.full(len(past["h"]), past["part"]), part[row]]
        order = np.argsort(h, kind="stable")  # keeps the order of places
        s = h[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
        head, last = order[first], order[np.r_[first[1:], len(h)] - 1]
        known = ((d[head] != d[last]) | (p[last] - p[head] >= width))[group]
        hd, hp = d[head][group], p[head][group]
        copied = (d != hd) | (p - hp >= width)
        new = np.flatnonzero(known & ~told)
        on = np.ones(len(h), bool)
        on[head] = False
        stay = np.flatnonzero((owner == part[-1]) & (~on | ~known))
        past = {"part": part[-1], "h": h[stay], "d": d[stay], "p": p[stay], "told": known[stay] | told[stay]}
        if not len(new):
            return None, past
        d, p, hd, copied = d[new], p[new], hd[new], copied[new]
        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (hd[1:] != hd[:-1]) | (copied[1:] != copied[:-1])])
        n = np.diff(np.r_[cut, len(d)]) + width - 1
        columns = [pa.array(d[cut]), pa.array(p[cut].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hd[cut]), pa.array(copied[cut])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "n", "head", "copied"]), past

    def run(batches):
        past = {"part": 0, "h": np.empty(0, np.uint64), "d": np.empty(0, np.int64), "p": np.empty(0, np.int64), "told": np.empty(0, bool)}
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                out, past = block(batch.slice(lo, BLOCK_ROWS), past)
                if out is not None:
                    yield out

    return run


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) -> SPAN_SCHEMA: stretches of words, by place of the first word, whose windows of `width` words
    all have another place that does not overlap; head is the doc_id of the first place, copied says that it is not this one."""
    rows = docs.mapInArrow(_stretches(width, max(1, 2 * width // 5)), "part long, doc_id long, at int, hashes binary")
    return rows.repartition("part").sortWithinPartitions("part", "doc_id", "at").mapInArrow(_repeats(width), SPAN_SCHEMA)
