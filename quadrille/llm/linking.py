"""From shared signatures to verified links and components, without listing all pairs of a group.

A class stands for all rows with the same set of shingles. Classes that share a signature are
candidates. A 256-bit parity map of each class bounds the symmetric difference from below, so
that only pairs that can still reach the threshold go on; for long sets, whose small maps are
full, a map of 8192 bits does so again before any set is read and compared. Every class is first linked
to one hub (the smallest class of the signature it shares most often); signatures of at most HOT
classes then list their pairs that are still in different components.

A signature of more classes is never listed. It gets a hub h, the member that shares the most with the
others or, at later levels, was nearest to the hub before, and every member x its difference d(x) from h. Two members are as far apart as their differences
are: |x - y| = |d(x)| + |d(y)| - 2 |d(x) & d(y)| (symmetric differences). If |d(x)| + |d(y)| is within
what the threshold allows for x and y, both are linked with h. So any other linked pair
shares words of d(x) and d(y), at least as many as a bound says, and by the prefix principle one of the
first |d| - bound + 1 of each, words that h lacks first. These words, by hub, are the
signatures of the next level, where the same is done again. No pair that could connect two components is
left out at any level, so the components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MIX_A, mix, stage, unstage
from .components import connected_components

BITS = ["b0", "b1", "b2", "b3"]
FACTS_SCHEMA = "n int, b0 long, b1 long, b2 long, b3 long"
SET_SCHEMA = "cls long, members binary"
HOT, LEVELS = 256, 3


def parity_map(hashes: np.ndarray) -> list[int]:
    """256 parities of the hashes: its Hamming distance never exceeds the symmetric difference."""
    odd = np.bincount((hashes >> np.uint64(17)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def fact_arrays(sets: list[np.ndarray]) -> tuple[list[pa.Array], list[str]]:
    """Columns of FACTS_SCHEMA for sets of hashes."""
    bits = np.array([parity_map(h) for h in sets], np.int64).reshape(-1, 4)
    return [pa.array([len(h) for h in sets], pa.int32()), *[pa.array(bits[:, i]) for i in range(4)]], ["n", *BITS]


def pool_facts(pool: np.ndarray, counts: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """fact_arrays of the sets of a pool, none of them empty."""
    starts, at = np.cumsum(counts) - counts, (pool >> np.uint64(17)) & np.uint64(255)
    bit, word = np.uint64(1) << ((at & np.uint64(63)) ^ np.uint64(7)), at >> np.uint64(6)
    bits = [np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), starts).view(np.int64) for i in range(4)]
    return [pa.array(counts, pa.int32()), *[pa.array(b) for b in bits]], ["n", *BITS]


def set_batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([h.tobytes() for _, h in rows], pa.binary())], names=["cls", "members"])


WIDE = 8192


def wide_map(hashes: np.ndarray) -> np.ndarray:
    """The size of a set and 8192 parities, as one array of numbers."""
    odd = np.bincount((hashes >> np.uint64(13)).astype(np.int64) & (WIDE - 1), minlength=WIDE) & 1
    return np.concatenate([np.array([len(hashes)], np.uint64), np.packbits(odd.astype(np.uint8)).view(np.uint64)])


def _still_possible(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                apart, both = int(np.bitwise_count(x[1:] ^ y[1:]).sum()), int(x[0] + y[0])
                if apart * (num + den) <= both * (den - num):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _verifier(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("ma").to_pylist(), batch.column("mb").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * den >= num * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["u", "v"]
            )

    return run


def _with_members(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    small = sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"))
    large = sets.select(F.col("cls").alias("a"), F.col("members").alias("ma"))
    return pairs.select("a", "b").join(small, "b").join(large, "a")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) whose sets have Jaccard similarity >= num/den, as edges (u, v)."""
    return _with_members(pairs, sets).mapInArrow(_verifier(num, den), "u long, v long")


def _possible(num: int, den: int):
    """Size filter and parity bound on the columns of two sets, prefixed x_ and y_."""
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in BITS), F.lit(0))
    nx, ny = F.col("x_n"), F.col("y_n")
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (apart * (num + den) <= (nx + ny) * (den - num))


def _differences(num: int, den: int, load):
    """Of pairs (a hub, b) with their sets: whether they are linked, and the signatures of b at the next level."""
    p, q = den - num, den + num

    def keys(x: np.ndarray, hub: np.ndarray, a: int) -> tuple[bool, int, np.ndarray]:
        apart = np.setxor1d(x, hub, assume_unique=True)
        n, nh, d = len(x), len(hub), len(apart)
        linked = q * d <= p * (n + nh)
        size = min(max(nh, -(-num * n // den)), den * n // num)  # of the partner that needs the fewest common words
        least = q * abs(size - nh) - p * size
        if linked:
            least = max(least, p * nh + 1)  # two that are linked with the hub need no other link
        need = max(1, -(-(q * d - p * n + least) // (2 * q)))
        if need > d:
            return linked, d, np.empty(0, np.uint64)
        own = np.isin(apart, hub, assume_unique=True)
        weight = np.zeros(d) if load is None else load.value[(apart % np.uint64(len(load.value))).astype(np.int64)]
        first = apart[np.lexsort((apart, weight, own))[: d - need + 1]]
        return linked, d, mix(first * MIX_A + mix(np.full(1, a, np.int64).view(np.uint64)))

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            told = [keys(np.frombuffer(y.as_py(), np.uint64), np.frombuffer(x.as_py(), np.uint64), hub) for hub, x, y in zip(a, batch.column("ma"), batch.column("mb"))]
            ends = np.cumsum([0, *(len(k) for *_, k in told)]).astype(np.int32)
            every = np.concatenate([np.empty(0, np.uint64), *(k for *_, k in told)]).view(np.int64)
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x for x, *_ in told], pa.bool_()), pa.array([d for _, d, _ in told], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(every))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "apart", "keys"])

    return run


def shared_signatures(postings: DataFrame) -> DataFrame:
    """(sig, cls) of the signatures that two classes or more have. The smallest and largest class of a signature are
    gathered by partial sums, and the join may split a signature that very many classes have."""
    postings = stage(postings, "postings")
    met = postings.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("sig")
    out = stage(postings.join(met, "sig").distinct(), "shared")
    unstage(postings)
    return out


def link_components(shared: DataFrame, facts: DataFrame, fetch, num: int, den: int, wide: bool = False, load=None, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """shared (sig, cls) of signatures met more than once, facts (cls, FACTS_SCHEMA) by class, fetch: DataFrame of cls
    -> DataFrame of SET_SCHEMA, with wide maps in place of the sets if its second argument is true; load: a broadcast array of
    weights of shingles by hash, small ones first, or None. Returns (node, label): components over all links of similarity >= num/den.

    A signature of more than hot classes goes to the next level; at the last of the levels pairs are listed whatever their number."""
    side = lambda p, *more: [F.col(c).alias(f"{p}_{c}") for c in ("cls", "n", *BITS, *more)]
    used = lambda p: p.select(F.col("a").alias("cls")).union(p.select("b")).distinct()
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def verify(pairs):
        if wide:
            maps = stage(fetch(used(pairs), True), "maps")
            pairs = stage(_with_members(pairs, maps).mapInArrow(_still_possible(num, den), "a long, b long"), "pairs")
            unstage(maps)
        sets = stage(fetch(used(pairs), False), "sets")
        out = stage(verified(pairs, sets, num, den), "links")
        unstage(sets)
        return out

    def differences(many):
        """Links with hubs, and the members with facts and their signatures of the next level."""
        if "apart" in many.columns:
            hubs = many.groupBy("sig").agg(F.min_by("cls", F.struct("apart", "cls")).alias("a"))
        else:
            degree = many.groupBy("cls").agg(F.sum("c").alias("degree"))
            hubs = many.join(degree, "cls").groupBy("sig").agg(F.max_by("cls", F.struct("degree", "cls")).alias("a"))
        pairs = stage(many.select("sig", F.col("cls").alias("b")).join(hubs, "sig").where("a != b").select("a", "b").distinct(), "members")
        sets = stage(fetch(used(pairs), False), "sets")
        out = stage(_with_members(pairs, sets).mapInArrow(_differences(num, den, load), "a long, b long, linked boolean, apart int, keys array<long>"), "differences")
        unstage(sets)
        members = out.where(F.size("keys") > 0).select(F.col("b").alias("cls"), "apart", "keys").join(facts, "cls")
        return out.where("linked").select(F.col("b").alias("u"), F.col("a").alias("v")), stage(members, "next")

    edges, labels, first = None, None, None
    for level in range(levels):
        if labels is None:
            known = shared.join(facts, "cls").withColumn("label", F.col("cls"))
        else:  # labels come to the members, before their signatures are dealt out
            known = shared.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
            known = known.withColumn("sig", F.explode("keys")).drop("keys")
        known = stage(known, "known")
        groups = known.groupBy("sig").agg(F.min(F.struct("cls", "n", *BITS)).alias("h"), F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        placed = stage(known.join(groups.where("lo != hi").drop("lo", "hi"), "sig"), "placed")
        unstage(known)
        few, many, new = placed, None, []
        if level + 1 < levels:
            few, many = placed.where(F.col("c") <= hot), placed.where(F.col("c") > hot)
        if first is None:
            near = few.select("sig", *side("x"), *[F.col(f"h.{c}").alias(f"y_{c}") for c in ("cls", "n", *BITS)]).where((F.col("x_cls") != F.col("y_cls")) & _possible(num, den))
            votes = near.groupBy(F.col("x_cls").alias("b"), F.col("y_cls").alias("a")).agg(F.count("*").alias("votes"))
            first = stage(votes.groupBy("b").agg(F.min_by("a", F.struct(-F.col("votes"), F.col("a"))).alias("a")), "first")
            new.append(verify(first))
        shared = None
        if many is not None and not many.isEmpty():
            stars, shared = differences(many)
            new.append(stars)
        if new:
            edges = _joined(edges, new)
            labels = stage(connected_components(edges), "labels")
        named = labels.withColumnRenamed("node", "cls")
        few = few.drop("label").join(named, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        more = few.select("sig", *side("x", "label")).join(few.select("sig", *side("y", "label")), "sig")
        more = more.where((F.col("x_label") != F.col("y_label")) & (F.col("x_cls") < F.col("y_cls")) & _possible(num, den))
        more = more.select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct()
        more = stage(more.join(first.select(*ordered), ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            late = verify(more)
            if not late.isEmpty():
                edges = _joined(edges, [late])
                labels = stage(connected_components(edges), "labels")
        unstage(placed)
        if shared is None:
            break
    return labels


def _joined(edges: DataFrame | None, new: list[DataFrame]) -> DataFrame:
    for e in new:
        edges = e if edges is None else edges.union(e)
    return edges
