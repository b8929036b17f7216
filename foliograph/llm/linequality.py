"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. Its features are shares of byte
classes, length and repetition, of the line itself and of its two neighbours;
two weights more stand for staying in a label and for the good label at the
start. The field is fitted by gradient ascent on whole documents whose lines
inherit the document's label; a document's score is the mean of the
forward-backward marginals of "good", weighted by the lines' lengths.

Defined results: null, empty and wordless texts have no lines and score 0; a
document of one very long line is one label; repeated rows get equal scores;
without labelled rows of both kinds every line scores 0.5; only the text is
scored, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import textops as T

THRESHOLD = 0.3

_CLASSES = {
    "lower": [*range(97, 123)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [32, 9],
    "stop": [*b".,;:?'\"()-"],
    "loud": [*b"!"],
    "pipe": [*b"|"],
    "symbol": [*b"#*$%&<>"],
    "other": [*b"/\\@=+_~^`[]{}"],
    "wide": [*range(128, 256)],
}
_FLAGS = np.zeros((len(_CLASSES), 256), bool)
for _k, _bytes in enumerate(_CLASSES.values()):
    _FLAGS[_k, _bytes] = True
N_OWN = len(_CLASSES) + 5
N_FEATURES = 3 * N_OWN + 1


def lines(t: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that hold a word, their text numbers (ascending), and their lengths in bytes."""
    w = T.Words(t, T.SPACE_SEP, lower=False)
    n = len(t.data)
    feed = np.flatnonzero(t.data == 10)
    begin = np.unique(np.concatenate([t.offs[:-1], feed + 1]))
    begin = begin[begin < n]
    end = np.append(begin[1:], n) if len(begin) else begin
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, end)
    has = b > a
    begin, end, a, b = begin[has], end[has], a[has], b[has]
    if not len(begin):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = w.doc[a]
    size = end - begin
    own = np.zeros((len(begin), N_OWN), np.float32)
    for k in range(len(_CLASSES)):
        total = np.zeros(n + 1, np.int64)
        np.cumsum(_FLAGS[k][t.data], out=total[1:])
        own[:, k] = np.sqrt((total[end] - total[begin]) / size)
    words = b - a
    k = len(_CLASSES)
    own[:, k] = np.log1p(words) / 4
    own[:, k + 1] = np.minimum((w.end[b - 1] - w.start[a]) / words / 16, 2)
    pre = T.byte_prefix(t.data)
    key = T.range_hash(pre, begin, w.end[b - 1]) ^ T.mix(doc.astype(np.uint64) + np.uint64(1))
    own[:, k + 2] = T.repeated(key)
    hashes = T.range_hash(pre, w.start, w.end)
    again = np.zeros(len(w) + 1, np.int64)
    np.cumsum(np.append(False, (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])), out=again[1:])
    own[:, k + 3] = (again[b] - again[a]) / words
    own[:, k + 4] = words < 3
    x = np.zeros((len(begin), N_FEATURES), np.float32)
    x[:, :N_OWN] = own
    near = doc[1:] == doc[:-1]
    x[1:, N_OWN : 2 * N_OWN][near] = own[:-1][near]
    x[:-1, 2 * N_OWN : 3 * N_OWN][near] = own[1:][near]
    x[:, -1] = 1
    return x, doc, size


@dataclass(frozen=True)
class Field:
    """Weights of the features (for the good label against the bad one), of staying in a label, of starting good."""

    weight: np.ndarray
    stay: float
    start: float


def marginals(u: np.ndarray, first: np.ndarray, stay: float, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains that lie one after another: P(good) of each line, P(this and the line before have one label), log normaliser by chain.

    u are the good label's potentials; first has each chain's first line, and the number of lines at its end.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    count, begin = count[order], first[:-1][order]
    n = len(u)
    # messages as log odds of good against bad, and the log of the sum for the normaliser
    fwd, bwd, same = np.zeros(n), np.zeros(n), np.zeros(n)
    log_z = np.zeros(len(order))
    longest = int(count[0]) if len(count) else 0
    alive = [int(np.searchsorted(-count, -k, "left")) for k in range(longest)]  # chains longer than k
    fa, fb = np.zeros(n), np.zeros(n)  # log forward sums of good and bad
    for k in range(longest):
        at = begin[: alive[k]] + k
        if k == 0:
            fa[at], fb[at] = u[at] + start, 0
        else:
            a, b = fa[at - 1], fb[at - 1]
            fa[at] = u[at] + np.logaddexp(a + stay, b)
            fb[at] = np.logaddexp(a, b + stay)
    ba, bb = np.zeros(n), np.zeros(n)
    for k in range(longest - 2, -1, -1):
        at = begin[: alive[k + 1]] + k
        a, b = ba[at + 1] + u[at + 1], bb[at + 1]
        ba[at] = np.logaddexp(a + stay, b)
        bb[at] = np.logaddexp(a, b + stay)
    good = 1 / (1 + np.exp(np.clip(fb + bb - fa - ba, -500, 500)))
    if longest:
        log_z = np.logaddexp(fa[begin + count - 1], fb[begin + count - 1])
        z = np.zeros(n)
        z[np.repeat(begin, count) + _ramp(count)] = np.repeat(log_z, count)
        inner = np.ones(n, bool)
        inner[begin] = False
        i = np.flatnonzero(inner)
        same[i] = np.exp(fa[i - 1] + stay + u[i] + ba[i] - z[i]) + np.exp(fb[i - 1] + stay + bb[i] - z[i])
    back = np.empty(len(order))
    back[order] = log_z
    return good, same, back


def _ramp(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def train(rows: list[tuple[str, int]], steps: int = 120, rate: float = 0.15, l2: float = 1e-4) -> Field:
    """Full-gradient ascent (Adam) on the mean log likelihood; both labels weigh alike."""
    raw = [x.encode() for x, _ in rows]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offs[1:])
    x, doc = [], []
    for i, _, t in T.slices(T.Texts(np.frombuffer(b"".join(raw), np.uint8), offs)):
        f, d, _ = lines(t)
        x.append(f)
        doc.append(d + i)
    none = Field(np.zeros(N_FEATURES), 0.0, 0.0)
    if not rows:
        return none
    x, doc = np.concatenate(x), np.concatenate(doc)
    label = np.array([y for _, y in rows])
    docs, first = np.unique(doc, return_index=True)
    first = np.append(first, len(doc))
    y = label[docs]
    if not len(docs) or y.min() == y.max():
        return none
    weigh = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    count = np.diff(first)
    # a document counts once, however many lines it has
    per_line = np.repeat(weigh / count, count)
    target = np.repeat(y, count).astype(float)
    begins = first[:-1]
    inner = np.ones(len(doc), bool)
    inner[begins] = False
    theta = np.zeros(N_FEATURES + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, same, _ = marginals(x @ theta[:N_FEATURES], first, theta[-2], theta[-1])
        g = np.empty_like(theta)
        g[:N_FEATURES] = ((target - good) * per_line) @ x
        g[-2] = ((1 - same) * per_line)[inner].sum()
        g[-1] = ((target - good) * per_line)[begins].sum()
        g -= l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[-2] = min(theta[-2], 2.0)  # lines that inherit one label would drive this weight up without end
    return Field(theta[:N_FEATURES], float(theta[-2]), float(theta[-1]))


def score_texts(t: T.Texts, field: Field) -> np.ndarray:
    x, doc, size = lines(t)
    out = np.zeros(len(t))
    if len(doc):
        docs, first = np.unique(doc, return_index=True)
        good, _, _ = marginals((x @ field.weight.astype(np.float32)).astype(float), np.append(first, len(doc)), field.stay, field.start)
        out[docs] = np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)
    return out


def score(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return T.per_row(df, [text_col], "score double", lambda t: {"score": score_texts(t, field)}, [id_col])


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Per row: held_out, score, predicted."""
    field = train(labelled.sample(df, labels, label_col, modulus, held_out, id_col, text_col))
    T.give_back()
    found = score(df, field, id_col, text_col)
    return found.select(id_col, (labelled.remainder(F.col(id_col), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
