"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates
their accuracies without labels, and the posterior probability of good quality decides."""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHash, in_steps, stage, window_hashes

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bang_words", "n_lines", "n_end_lines", "n_stops"]
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_BANG = re.compile(r"!!|\?\?")


def repeated_words(ids: np.ndarray, windows: np.ndarray, width: int) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    if len(ids) < width or len(windows) < 2:
        return 0
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[back] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def text_counts(text: str | None, cache: WordHash, width: int = 5) -> list[int]:
    if not text:
        return [0] * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    lines, seen, dup, full, ended = text.split("\n"), set(), 0, 0, 0
    for line in lines:
        bare = line.strip(" \t\r\v\f")
        if bare:
            full += 1
            ended += bare[-1] in ".!?:;\"')"
            dup += line in seen
            seen.add(line)
    ids = words if len(words) < width else np.empty(len(words))
    windows = window_hashes(words, width, cache) if len(words) >= width else ()
    return [
        len(words),
        len(text) - len(_SPACE.findall(text)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(ids, windows, width),
        len(_UPPER.findall(text)),
        len(_LETTER.findall(text)),
        len(_BANG.findall(text)),
        full,
        ended,
        sum(len(w) <= 3 for w in words),
    ]


def _counting(batches):
    cache = WordHash()
    for batch in in_steps(batches, 250):
        rows = [text_counts(t, cache) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[] for _ in COUNTS])]
        keep = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*keep, *columns], names=[*batch.schema.names, *COUNTS])


def count_features(docs: DataFrame) -> DataFrame:
    """Adds the counts of COUNTS to docs, which has a column text; columns of those names are replaced."""
    docs = docs.drop(*COUNTS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.mapInArrow(_counting, schema)


def rule_votes() -> dict[str, Column]:
    """Rule -> vote: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))

    def vote(good, bad):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length, symbols = F.col("word_chars") / n, F.col("n_symbols") / n
    dup, repeat = share("n_dup_lines", "n_lines"), F.col("n_repeat_words") / n
    upper, bang, ends, stops = share("n_upper", "n_letters"), F.col("n_bang_words") / n, share("n_end_lines", "n_lines"), F.col("n_stops") / n
    return {
        "word_length": vote(length.between(3, 9), (length < 2) | (length > 14)),
        "symbols": vote(symbols < 0.05, symbols > 0.2),
        "symbol_chars": vote(share("n_symbols", "word_chars") < 0.01, share("n_symbols", "word_chars") > 0.03),
        "dup_lines": vote(dup < 0.1, dup > 0.4),
        "repeats": vote(repeat < 0.1, repeat > 0.2),
        "capitals": vote(upper < 0.25, upper > 0.5),
        "shouting": vote(bang < 0.05, bang > 0.2),
        "line_ends": vote(ends > 0.6, (ends < 0.1) & (F.col("n_lines") > 3)),
        "short_words": vote((stops > 0.12) | (F.col("n_words") < 40), stops < 0.03),
        "length": vote(F.col("n_words") >= 10, F.col("n_words") < 10),
    }


def fit_accuracies(patterns: np.ndarray, weights: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) with their counts.

    Returns the prior of good and, by rule, P(vote -1, 0, 1 | bad) and P(... | good), shaped (rules, 2, 3).
    Beta-like pseudo counts keep every rule better than chance, which also fixes which class is the good one.
    """
    rules = patterns.shape[1]
    # a bad text fails one or two rules and passes the others; a good one hardly fails any
    prior, table = 0.85, np.tile(np.array([[0.3, 0.1, 0.6], [0.003, 0.057, 0.94]]), (rules, 1, 1))
    strength = max(1.0, 0.002 * weights.sum())
    base = table * strength
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=-1).astype(float)
    for _ in range(rounds):
        log_p = np.einsum("prv,rcv->pc", onehot, np.log(table)) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(log_p[:, 0] - log_p[:, 1], -500, 500)))
        mass = np.stack([(1 - good) * weights, good * weights], axis=1)
        new_prior = (mass[:, 1].sum() + 0.85 * strength) / (weights.sum() + strength)
        new = np.einsum("pc,prv->rcv", mass, onehot) + base
        new /= new.sum(axis=2, keepdims=True)
        moved = abs(new - table).max()
        prior, table = float(new_prior), new
        if moved < 1e-7:
            break
    return prior, table


def judge_quality(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality_probability and kept to the rows of count_features.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows.
    kept: not base_failed, and posterior >= threshold. Vote patterns (at most 3 ** rules) are
    counted over all rows; only those counts reach the driver. Null and blank texts have no
    words and fail. An empty table gives an empty table. Other columns stay, but for those of the results' names, which are
    replaced. The counts are made once and staged; votes are taken from there.
    """
    votes = rule_votes()
    mark = f"__{uuid.uuid4().hex[:8]}"  # no column of the caller has it
    names = [f"{mark}_{r}" for r in votes]
    counted = stage(counted.drop("base_failed", "quality_probability", "kept"), "counted")
    voted = counted.withColumns(dict(zip(names, votes.values())))
    found = voted.groupBy(*names).agg(F.count("*").alias("times")).collect()
    if found:
        prior, table = fit_accuracies(np.array([[r[c] for c in names] for r in found]), np.array([float(r["times"]) for r in found]))
    else:
        prior, table = 0.5, np.full((len(names), 2, 3), 1 / 3)
    score = F.lit(math.log(prior / (1 - prior)))
    for i, name in enumerate(names):
        gain = np.log(table[i, 1] / table[i, 0])
        score = score + F.when(F.col(name) == -1, float(gain[0])).when(F.col(name) == 1, float(gain[2])).otherwise(float(gain[1]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    probability = 1 / (1 + F.exp(-score))
    out = voted.withColumns({"base_failed": failed, "quality_probability": probability})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold)).drop(*names)
