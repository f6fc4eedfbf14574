"""Operators 11 to 13 against brute force, on small tables with odd rows."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import filter_audit, slack_packing, spelling_variants
from quadrille.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, `rows` string, part string, mask int, word string, length int"
JSON = tokenizer_path("byte_bpe_50k.json")


def frame(spark, rows):
    """doc_id, text and lang, with columns named like those the operators make."""
    return spark.createDataFrame([(i, t, lang, "x", "y", 3, "z", 9) for i, t, lang in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    roots = ["".join(rng.choice("abcdeéÖ") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aabbaa", "aabbbaa", "ababab", "bababa"]
    out = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 260)):
            w = rng.choice(roots[: rng.randint(1, len(roots))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "c" + w[at:], w[:at] + "e" + w[at + 1 :], w.upper()])
            words.append(w)
        out.append((i, rng.choice([" ", "  ", "\n"]).join(words) + rng.choice(["", "", "", " #"]), rng.choice(["en", "de", None, ""])))
    out += [(200, out[5][1], "en"), (3, out[5][1], "de"), (3, out[5][1], "de"), (None, out[5][1], "en"), (None, out[5][1], "en"), (201, None, "en"), (202, "", None), (203, " \t", "fr"), (204, "x <|endoftext|> y", "fr")]
    out += [(205, "A" * 9000 + " " + "wörd  Zwölf! " * 3000, "fr"), (206, "\x85 　 a​b 你好 🙂" * 50, "zh")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


# ---- spelling variants ----
def lowered(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words):
    form = {}
    out = set()
    for x in words:
        close = [y for y in words if near(x, y)]
        best = min(close, key=lambda y: (-words[y], y), default=None)
        form[x] = best if best is not None and words[best] >= 5 * words[x] else None
        out.add((x, form[x], len(close)))
    for x, f, k in out:
        root = x
        while form[root]:
            root = form[root]
        yield x, f, root, words[x], k, words[f] if f else None


def test_spelling_variants_equal_all_pairs(docs, rows):
    count = Counter()
    for i, t, _ in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    want = sorted(map(str, variants_by_hand(words)))
    got = spelling_variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert len(want) > 100 and any(eval(w)[1] for w in want)


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdhg"] * 125 + ["abcihg"] * 625 + ["abjihg"] * 3125 + ["zzzzzz"] * 4)
    got = {r["word"]: r for r in spelling_variants.spelling_variants(frame(spark, [(10**9, text, "en")])).collect()}
    assert set(got) == {"abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"}
    assert {r["root"] for r in got.values()} == {"abjihg"} and got["abcdef"]["form"] == "abcdeg" and got["abjihg"]["form"] is None


def test_ties_go_to_the_first_word_in_code_point_order(spark):
    text = " ".join(["aaaaab"] * 5 + ["aaaaaö"] * 25 + ["aaaaaz"] * 25 + ["aaaaa"] * 90 + ["aaaaac"] * 25)
    got = {r["word"]: tuple(r) for r in spelling_variants.spelling_variants(frame(spark, [(1, text, "en")])).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got["aaaaab"] == ("aaaaab", "aaaaac", "aaaaac", 5, 3, 25)


def test_deletion_keys_are_equal_only_for_equal_strings():
    words = ["aab", "ab", "ba", "aba", "öab", "", "a", "aaaaaaaaaa"]
    by_key = defaultdict(set)
    for of, place, key, first in zip(*spelling_variants.deletion_keys(words)):
        word = words[of]
        by_key[key].add(word if place < 0 else word[:place] + word[place + 1 :])
        assert first == (place <= 0 or word[place] != word[place - 1])
    assert all(len(x) == 1 for x in by_key.values()) and len(by_key) == len(set.union(*by_key.values()))


def test_a_collision_of_keys_is_told_apart_by_the_strings():
    group = [("abcdef", 9, -1, True), ("abcdefx", 5, 6, True), ("uvwxyz", 7, -1, True), ("uvwxyzz", 6, 5, True)]
    assert sorted(spelling_variants._near(group)) == [("abcdef", 1, "abcdefx", 5), ("abcdefx", 1, "abcdef", 9), ("uvwxyz", 1, "uvwxyzz", 6), ("uvwxyzz", 1, "uvwxyz", 7)]


def test_groups_that_go_over_batches_are_whole():
    import pyarrow as pa

    rows = sorted((k, w, n, p, f) for k, w, n, p, f in [(1, "aaaaaa", 5, -1, True), (2, "bbbbbb", 5, -1, True), (2, "bbbbbbb", 6, 0, True), (2, "bbbbbbc", 7, 6, True), (2, "bbbbbbd", 8, 6, True), (3, "cccccc", 9, -1, True)])
    table = pa.table({c: pa.array(v, t) for c, v, t in zip(("key", "word", "n", "place", "first"), zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()))})
    results = [sorted(r for b in spelling_variants._meeting(table.to_batches(max_chunksize=size)) for r in zip(*b.to_pydict().values())) for size in (1, 2, 3, 100)]
    assert results[0] and all(r == results[0] for r in results)
    assert ("bbbbbb", 3, "bbbbbbd", 8) in results[0] and ("bbbbbbc", 1, "bbbbbbd", 8) in results[0]


def test_words_of_no_and_of_empty_documents(spark):
    for data in ([], [(None, None, None)], [(1, "", "en"), (2, "short 123", "en")]):
        assert spelling_variants.spelling_variants(frame(spark, data)).count() == 0


# ---- best-fit packing ----
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_places_every_id_once(docs, rows, library, capacity):
    packed = slack_packing.pack_documents(docs, JSON, capacity=capacity).persist()
    want, total = Counter(), 0
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids) + 1, capacity)]
        want.update((i, k, lo, hi - lo, zlib.crc32(struct.pack(f"<{hi - lo}I", *ids[lo:hi])), tuple(ids[lo:hi])) for k, (lo, hi) in enumerate(zip(at, at[1:])))
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.002 * least_bins(Counter(r["length"] for r in got), capacity) + 1
    made = slack_packing.sequences(packed).collect()
    assert len(made) == len(bins) and sum(len(r["ids"]) for r in made) == total and max(len(r["ids"]) for r in made) <= capacity
    packed.unpersist()


def least_bins(counts, capacity):
    """The lower bound of Martello and Toth: what does not fit beside the long pieces needs bins of its own."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in range(capacity // 2 + 1):
        whole = sum(n for x, n in counts.items() if x > capacity - k)
        long = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - k]
        short = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in long)
        best = max(best, whole + sum(n for _, n in long) + max(0, -(-(short - room) // capacity)))
    return best


def test_long_texts_in_parts_have_the_same_ids(library):
    rng = random.Random(2)
    vocabulary = slack_packing.load_vocabulary(JSON)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", " ", "\n", " c", "1", "  ", "'s", "!", " é", "<|endoftext|>"]) for _ in range(150))
        assert "".join(slack_packing.chunks(text, 10)) == text
        assert [i for part in slack_packing.chunks(text, 10) for i in slack_packing.encode(part, vocabulary).tolist()] == library.encode(text, add_special_tokens=False).ids


def test_the_fullest_combination_is_found():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = slack_packing.fullest(counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(c <= counts[x] for x, c in Counter(chosen).items())


def test_a_plan_uses_up_the_counts_in_few_kinds_of_bins():
    rng = random.Random(6)
    counts = {length: rng.randint(1, 10**7) for length in range(1, 257)}
    plan = slack_packing.plan_bins(counts, 256)
    used = Counter()
    for times, copies in plan:
        assert times > 0 and sum(x * c for x, c in copies.items()) <= 256
        used.update({x: c * times for x, c in copies.items()})
    assert used == counts and len(plan) <= 3 * 256
    assert sum(times for times, _ in plan) <= 1.01 * least_bins(counts, 256)  # even counts of all lengths are the worst met: 0.64 % above the bound


def test_packing_no_rows_and_one_hot_length(spark):
    assert slack_packing.pack_documents(frame(spark, []), JSON).count() == 0
    rows = [(None, None, "en")] * 3000 + [(1, "a", None)]
    got = slack_packing.pack_documents(frame(spark, rows), JSON).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3001 and len({r["sequence_id"] for r in got}) == 3


# ---- filter interaction audit ----
LABELS = "doc_id long, quality int, toxic int, part string"


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        facts.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    shapley, out = Counter(), {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, name in enumerate(order):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                hit = [f for f in own if name in f[1]]
                shapley[part, name] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), len(hit) - len(gone), sum(f[1] == {name} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_running_every_order(spark, docs, rows):
    rng = random.Random(8)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 210, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = filter_audit.audit_documents(docs, spark.createDataFrame([(*x, "p") for x in labels], LABELS))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = got.select(columns).collect()
    want = audit_by_hand(rows, labels)
    assert len(got) == len(want) == 600 * 5 and {tuple(r) for r in got} == want
    assert all(any(r[c] for r in got) for c in columns[3:])


def test_audit_of_no_documents_and_of_no_labels(spark, docs):
    no_labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(frame(spark, []), no_labels).count() == 0
    lost = filter_audit.audit_documents(docs, no_labels).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(lost) == (0, 0, 3000)


def test_audit_takes_any_filters_and_measures(spark):
    rows = spark.createDataFrame([("p", 0, 1), ("p", 1, 1), ("p", 3, 0), ("p", 2, 1), (None, 3, 1)], "part string, mask int, kind int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit_filters(rows, ["length", "lang"], ["kind"]).collect()}
    assert len(got) == 8
    r = got["p", "langlength", 1]
    assert (r["filter"], r["kept"], r["removed"], r["kind_lost"], r["unique_fails"], r["shapley"]) == ("lang", 2, 2, 1, 1, 3)
    with pytest.raises(ValueError):
        filter_audit.audit_filters(rows, list("abcdefg"), [])


def test_zeta_sums_over_subsets(spark):
    got = filter_audit.zeta(spark.range(1).select(F.array(*[F.lit(2**i).cast("long") for i in range(8)]).alias("x")), "x", 3).first()["x"]
    assert got == [sum(2**s for s in range(8) if s & ~m == 0) for m in range(8)]
    assert np.all(np.diff(got) != 0)
