"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel.

The kernel of two words sums, over all 3-letter subsequences that span at most SPAN letters, the
product of their weights DECAY ** span, normalised to 1 for equal words. Non-letters inside a
word are dropped and look-alike digits read as letters, so that inserted characters and gaps
cost little; tokens of very many letters are judged in overlapping pieces as well. Nystroem: landmark words are drawn from the labelled training sentences, and words
are mapped to K(w, landmarks) K(landmarks, landmarks)^-1/2, where a linear squared-hinge SVM is
trained. Labels belong to whole texts, so training is multiple-instance: a toxic text is
represented by its worst word, re-chosen every round; all words of the other texts are negative.
Since the kernel has explicit features, the trained landmark expansion folds into one weight for
each subsequence, with the same values, and scoring costs no kernel evaluations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, DECAY = 6, 0.6
CODES = 32
LEAST, LONG, WINDOWS = 3, 64, (8, 16, 32)
_LOOKALIKE = str.maketrans("013457@$", "oieastas")


def fold(token: str) -> str:
    """Lower-case letters of a token; digits that look like letters become those if letters surround them."""
    token = token.lower()
    if token.isalpha():
        return token
    if any(c.isalpha() for c in token):
        token = token.translate(_LOOKALIKE)
    return "".join(c for c in token if c.isalpha())


def forms(token: str) -> list[str]:
    """What is judged of a token: its letters; if those are more than LONG, also its parts between
    non-letters and overlapping windows of its letters, so that a word anywhere in it counts. Nothing of fewer
    than LEAST letters, the length of a subsequence, is judged, in training and in scoring alike."""
    whole = fold(token)
    if len(whole) <= LONG:
        return [whole] if len(whole) >= LEAST else []
    parts = "".join(c if c.isalpha() else " " for c in token.lower().translate(_LOOKALIKE)).split()
    windows = [whole[i : i + n] for n in WINDOWS for i in range(0, len(whole) - n // 2, n // 4)]
    return list(dict.fromkeys([whole, *(p for p in parts if len(p) >= LEAST), *windows]))


def _code(c: str) -> int:
    o = ord(c)
    return o - 97 if 97 <= o <= 122 else 26 + o % 4


class SubsequenceKernel:
    """Explicit features of words: (word number, subsequence) with summed weights."""

    gaps = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]

    def features(self, words: list[str]):
        """Arrays word, subsequence, value, with one entry for each different subsequence of a word."""
        codes = [30, *(x for w in words for x in (*map(_code, w), 31, 30))]
        c = np.array(codes, np.int64)
        size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        c = c[: len(word)]
        ends = np.cumsum(size)[word]
        keys, values = [], []
        at = np.arange(len(c))
        for a, b in self.gaps:
            i = at[at + a + b < ends]
            keys.append((word[i] << 15) | (c[i] << 10) | (c[i + a] << 5) | c[i + a + b])
            values.append(np.full(len(i), DECAY ** (a + b + 1)))
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        if not len(key):
            return key, key, value
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        value, key = np.add.reduceat(value, first), key[first]
        return key >> 15, key & 32767, value

    def dense(self, words: list[str]) -> np.ndarray:
        word, sub, value = self.features(words)
        out = np.zeros((len(words), CODES**3), np.float32)
        out[word, sub] = value
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def against(self, words: list[str], landmarks: np.ndarray) -> np.ndarray:
        """K(words, landmarks); landmarks dense and normalised."""
        out, columns = np.zeros((len(words), len(landmarks))), np.ascontiguousarray(landmarks.T)
        for lo in range(0, len(words), 200):  # the gathered rows take 200 * features of a word * landmarks numbers
            word, sub, value = self.features(words[lo : lo + 200])
            norm = np.sqrt(np.bincount(word, value**2, minlength=len(words[lo : lo + 200])))
            rows = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            if len(word):
                out[lo + word[rows]] = np.add.reduceat(columns[sub] * value[:, None].astype(np.float32), rows) / np.maximum(1e-9, norm[word[rows]])[:, None]
        return out

    def scores(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """sum_u phi_u(w) weights_u / |phi(w)|."""
        word, sub, value = self.features(words)
        n = len(words)
        return np.bincount(word, value * weights[sub], minlength=n) / np.sqrt(np.maximum(1e-18, np.bincount(word, value**2, minlength=n)))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one for each subsequence: the folded landmark expansion
    bias: float
    slope: float  # score = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        return SubsequenceKernel().scores(words, self.weights) + self.bias

    def worst(self, tokens: list[str], letters: int = 2_000_000) -> list[float]:
        """The largest margin among the forms of each token, about so many letters at a time."""
        top, of, some, n = np.full(len(tokens), -np.inf), [], [], 0
        for i, token in enumerate(tokens):
            for f in forms(token):
                of.append(i)
                some.append(f)
                n += len(f)
                if n >= letters:
                    np.maximum.at(top, of, self.margins(some))
                    of, some, n = [], [], 0
        if some:
            np.maximum.at(top, of, self.margins(some))
        return top.tolist()

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * max(margin, self.bias - 1) + self.shift, -30, 30))))


def units(text: str | None) -> set[str]:
    """The words of a text to be judged; runs of 4 and more one-letter words also count joined."""
    if not text:
        return set()
    tokens = text.lower().split()
    found = set(tokens)
    run: list[str] = []
    for t in (*tokens, "  "):
        if len(t) == 1:
            run.append(t)
        elif run:
            if len(run) >= 4:
                found.add("".join(run))
            run = []
    return found


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by Newton steps on the active set."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    ridge = np.eye(xb.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (xb @ w) < 1
        if not active.any():
            break
        a, wt = xb[active], weight[active] * c
        new = np.linalg.solve(ridge + (a * wt[:, None]).T @ a, (a * wt[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            w = new
            break
        w = new
    return w[:-1], float(w[-1])


def _counts(bags, labels) -> tuple[dict, dict]:
    """In how many toxic texts, and in how many others, a word is."""
    bad, fine = {}, {}
    for bag, label in zip(bags, labels):
        to = bad if label == 1 else fine
        for w in bag:
            to[w] = to.get(w, 0) + 1
    return bad, fine


def _odds(bad: dict, fine: dict, n1: int, n0: int) -> dict:
    return {w: np.log((k + 0.05) / (n1 + 0.1)) - np.log((fine.get(w, 0) + 0.5) / (n0 + 1)) for w, k in bad.items()}


def _instances(members: list[np.ndarray], z1: np.ndarray, z0: np.ndarray, rank: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Multiple-instance training: each toxic text stands for its worst word by rank, re-chosen every round; all rows of z0 are negative."""
    for _ in range(rounds):
        worst = np.array([m[np.argmax(rank[m])] for m in members])
        x = np.vstack([z1[worst], z0])
        y = np.r_[np.ones(len(worst)), -np.ones(len(z0))]
        beta, bias = _svm(x, y, np.r_[np.full(len(worst), 3.0), np.ones(len(z0))])
        rank = z1 @ beta + bias
    return beta, bias


def train(texts: list[str], labels: list[int], n_landmarks: int = 160, max_negatives: int = 20_000, rounds: int = 4, folds: int = 3) -> ToxicityModel:
    """Fits on labelled texts in memory; the caller bounds them. Same texts in the same order, same model.

    Negative words are the max_negatives / 2 most frequent ones of the other texts and as many more by hash. Scores are
    calibrated on the margins that texts get from machines trained without their fold; with fewer toxic texts than
    2 * folds, on the margins of the training texts themselves.
    """
    kernel = SubsequenceKernel()
    one: dict[str, str] = {}  # equal words share one string
    bags = [sorted({one.setdefault(f, f) for w in units(t) for f in forms(w)}) for t in texts]
    bad, fine = _counts(bags, labels)
    toxic = [b for b, label in zip(bags, labels) if label == 1]
    others = [b for b, label in zip(bags, labels) if label != 1]
    positives = [b for b in toxic if b]
    if not positives or not fine:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return ToxicityModel(np.zeros(CODES**3), 0.0, 1.0, float(np.log(share / (1 - share))))
    odds = _odds(bad, fine, len(positives), len(bags) - len(positives))
    ranked = sorted((w for w in bad if bad[w] >= 2), key=lambda w: (-odds[w] * bad[w] ** 0.5, w))
    common = sorted(fine, key=lambda w: (-fine[w], w))
    chosen = ranked[: 6 * n_landmarks // 10] + common[: 4 * n_landmarks // 10]
    landmarks = kernel.dense(list(dict.fromkeys(chosen)))
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])

    negatives = common[: max_negatives // 2] + sorted(common[max_negatives // 2 :], key=lambda w: hash_of(w))[: max_negatives // 2]
    z0 = kernel.against(negatives, landmarks) @ root
    vocabulary = sorted({w for b in positives for w in b})
    z1 = kernel.against(vocabulary, landmarks) @ root
    place, place0 = {w: i for i, w in enumerate(vocabulary)}, {w: i for i, w in enumerate(negatives)}
    members = [np.array([place[w] for w in b]) for b in positives]
    start = lambda counts, found: np.array([found[w] + 0.3 * np.log(counts[w]) if w in counts else -np.inf for w in vocabulary])
    beta, bias = _instances(members, z1, z0, start(bad, odds), rounds)
    weights = landmarks.T.astype(float) @ (root @ beta)

    def tops(some, clean, beta, bias):
        rank, rank0 = z1 @ beta + bias, z0 @ beta + bias
        return [rank[m].max() for m in some], [max((rank0[place0[w]] for w in b if w in place0), default=-1.0) for b in clean]

    if len(positives) < 2 * folds:
        top1, top0 = tops(members, others, beta, bias)
    else:
        top1, top0 = [], []
        for k in range(folds):
            rest = [b for i, b in enumerate(positives) if i % folds != k]
            clean = [b for i, b in enumerate(others) if i % folds != k]
            bad_k, fine_k = _counts([*rest, *clean], [1] * len(rest) + [0] * len(clean))
            known = np.array([place0[w] for w in fine_k if w in place0], np.int64)
            if not len(known):
                continue
            odds_k = _odds(bad_k, fine_k, len(rest), len(clean))
            machine = _instances([m for i, m in enumerate(members) if i % folds != k], z1, z0[np.sort(known)], start(bad_k, odds_k), rounds)
            got1, got0 = tops(members[k::folds], others[k::folds], *machine)
            top1 += got1
            top0 += got0
    slope, shift = _calibrate(np.r_[top1, top0], np.r_[np.ones(len(top1)), np.zeros(len(top0))])
    return ToxicityModel(weights, bias, slope, shift)


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Ridge logistic regression on one variable: margins of texts to probabilities."""
    x, w = np.stack([margin, np.ones_like(margin)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + 0.01 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _scoring(model):
    bound = 500_000

    def run(batches):
        known: dict[str, float] = {}
        fitted = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            top = []
            for lo in range(0, len(texts), 500):
                bags = [units(t) for t in texts[lo : lo + 500]]
                fresh = list({w for b in bags for w in b if w not in known})
                if len(known) + len(fresh) > bound:
                    known.clear()
                    fresh = list({w for b in bags for w in b})
                for i in range(0, len(fresh), 20_000):
                    part = fresh[i : i + 20_000]
                    known.update(zip(part, fitted.worst(part)))
                top += [max((known[w] for w in b), default=-np.inf) for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fitted.score(m) for m in top], pa.float64())], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3000):
    """A bounded sample of labelled rows that are not held out: the smallest by hash of the doc_id, by label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda t, n: rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    few = pick(1, positives).union(pick(0, negatives))  # at most positives + negatives rows
    found = docs.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * (positives + negatives)).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] or "" for r in found], [r["toxic"] for r in found]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: tuple[int, int] = (1500, 3000)) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> (doc_id, held_out, score, predicted), one row for each of docs.

    The model is fitted on at most sum(sample) labelled texts outside the held-out fold (a
    documented bound; every text is scored). The score of a text is that of its worst word.
    Null, empty and blank texts, and those without a word of LEAST letters, get the score of a text
    without any word; very long texts are read whole. A doc_id with both labels counts as toxic. Rows without a doc_id keep a score and have held_out null. Without labels of
    both kinds every score is the smoothed share of toxic labels.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, *sample)))
    out = docs.mapInArrow(_scoring(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
