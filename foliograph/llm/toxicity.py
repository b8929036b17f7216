"""Toxicity scores by logistic regression trained with FTRL-proximal.

Features are hashed word unigrams, bigrams and skip-grams (a word and the next
but one), and words' first bytes, each counted once per text. Every coordinate
has its own learning rate, and the L1 term keeps only coordinates with steady
evidence: the weights that remain are a short list of pairs, bounded by
2**`bits`, and are broadcast.

Defined results: null and empty texts have no features and get the score of the
bias; without labelled rows all weights are zero and every score is the prior,
under the threshold; labels other than 0 and 1 and null ids are not learnt from; very long texts
are scored whole; repeated rows get equal scores; only the text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import textops as T

BITS = 20
THRESHOLD = 0.3
STEMS = (4, 6)
#: Log odds of label 1 before any evidence.
PRIOR = -1.5


@dataclass(frozen=True)
class Weights:
    """The coordinates that are not zero, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.weight
        return out


def features(t: T.Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all texts and the text of each, in no order and with repeats."""
    w = T.Words(t, T.ALNUM_SEP, lower=True)
    pre = T.byte_prefix(w.data)
    h = T.range_hash(pre, w.start, w.end)
    out, doc = [h], [w.doc]
    for stem in STEMS:  # words that share their first bytes share evidence
        out.append(T.mix(T.range_hash(pre, w.start, np.minimum(w.start + stem, w.end)) + np.uint64(stem)))
        doc.append(w.doc)
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9E6C63D0676A9A99)):
        if len(h) > gap:
            same = w.doc[gap:] == w.doc[:-gap]
            out.append(T.mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
            doc.append(w.doc[gap:][same])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(doc)


def train(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> Weights:
    """FTRL-proximal over the rows in their order."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples: list[tuple[np.ndarray, int]] = []  # 32 bits a coordinate: the driver holds all of them
    raw = [x.encode() for x, _ in rows]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offs[1:])
    for i, _, t in T.slices(T.Texts(np.frombuffer(b"".join(raw), np.uint8), offs)):
        at, doc = features(t, bits)
        key = np.unique(np.concatenate([doc * (size + 1) + at, np.arange(len(t)) * (size + 1) + size]))  # the last coordinate is the bias
        cut = np.searchsorted(key, np.arange(len(t) + 1) * (size + 1))
        key = (key % (size + 1)).astype(np.int32)
        for d in range(len(t)):
            examples.append((key[cut[d] : cut[d + 1]], rows[i + d][1]))
    del raw, offs

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            at, y = examples[e]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + PRIOR, -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    kept = np.flatnonzero(w[:size])
    return Weights(kept, w[kept].astype(np.float32), float(w[size]) + PRIOR, bits)


def score_texts(t: T.Texts, bits: int, dense: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    at, doc = features(t, bits)
    some = np.flatnonzero(dense[at])
    key = np.unique(doc[some] * (1 << bits) + at[some])
    total = np.bincount(key >> bits, dense[key & ((1 << bits) - 1)], len(t)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _scorer(df: DataFrame, model: Weights):
    shared = df.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def run(t: T.Texts) -> np.ndarray:
        if not dense:
            dense.append(shared.value.dense())
        return score_texts(t, shared.value.bits, dense[0], shared.value.bias)

    return run


def score(df: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col and score, the probability of label 1."""
    run = _scorer(df, model)
    return T.per_row(df, [text_col], "score double", lambda t: {"score": run(t)}, [id_col])


def clean(df: DataFrame, model: Weights, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, with all their columns, that score under the threshold."""
    run = _scorer(df, model)
    return T.filter_rows(df, text_col, lambda t: run(t) < threshold)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights learnt from a bounded sample of the labelled rows that are not held out."""
    found = train(labelled.sample(df, labels, label_col, modulus, held_out, id_col, text_col))
    T.give_back()
    return found


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Per row: held_out, score, predicted."""
    found = score(df, fit(df, labels, "toxic", modulus, held_out, id_col, text_col), id_col, text_col)
    return found.select(id_col, (labelled.remainder(F.col(id_col), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
