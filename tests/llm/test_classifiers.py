"""Both classifiers against plain Python: features, training, scores."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from foliograph.llm import linequality, textops, toxicity

from .test_rows import ALNUM, lower


def texts(rows):
    return textops.texts(pa.array(rows))


def sentences(seed, n):
    pick = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "vile", "vilest", "nasty", "the", "of", "Über", "x9"]
    return [" ".join(pick.choice(words) for _ in range(pick.choice([0, 1, 2, 5, 20]))) + pick.choice(["", ".", "\nvile nasty"]) for _ in range(n)]


def features_of(text):
    """What is counted, by name: words, their first bytes, pairs and pairs with a gap."""
    w = [x.encode() for x in ALNUM.findall(lower(text))]
    out = [("word", x) for x in w] + [(f"stem{k}", x[:k]) for k in toxicity.STEMS for x in w]
    return out + [("pair", *p) for p in zip(w, w[1:])] + [("skip", *p) for p in zip(w, w[2:])]


def test_toxicity_features():
    rows = sentences(1, 60)
    at, doc = toxicity.features(texts(rows), 40)
    known = {}
    for k, text in enumerate(rows):
        own, alone = np.sort(at[doc == k]).tolist(), np.sort(toxicity.features(texts([text]), 40)[0]).tolist()
        assert own == alone and len(own) == len(features_of(text))
        for name in set(features_of(text)):
            known.setdefault(name, set(own)).intersection_update(own)
    assert all(known.values())  # a feature has one coordinate wherever it occurs
    assert len(set(at.tolist())) == len(known)


def plain_ftrl(rows, bits, epochs, alpha, beta, l1, l2):
    size = 1 << bits
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    examples = [({*toxicity.features(texts([t]), bits)[0].tolist(), size}, y) for t, y in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            own, y = examples[e]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + toxicity.PRIOR)))) - y
            for i in own:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if i != size and weight(i)}, weight(size) + toxicity.PRIOR


@pytest.mark.parametrize("l1", [0.0, 0.3, 4.0])
def test_ftrl(l1):
    rows = [(t, int("vile" in t)) for t in sentences(2, 80)]
    model = toxicity.train(rows, bits=14, epochs=3, l1=l1)
    weights, bias = plain_ftrl(rows, 14, 3, 0.5, 1.0, l1, 1.0)
    assert set(model.at.tolist()) == set(weights) and model.bias == pytest.approx(bias, abs=1e-9)
    assert dict(zip(model.at.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(weights, abs=1e-6)
    got = toxicity.score_texts(texts([t for t, _ in rows] + [""]), 14, model.dense(), model.bias)
    for (t, _), s in zip([*rows, ("", 0)], got, strict=True):
        total = sum(weights.get(i, 0.0) for i in set(toxicity.features(texts([t]), 14)[0].tolist())) + bias
        assert s == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def plain_lines(text):
    """Own features of each line with a word, and its length in bytes."""
    raw = text.encode()
    found = []
    for part in raw.split(b"\n"):
        if part.split():
            found.append(part)
    out = []
    at = 0
    pieces = []
    for part in raw.split(b"\n"):
        end = min(at + len(part) + 1, len(raw))
        pieces.append((part, end - at))
        at = end
    keys = [part[: len(part.rstrip(b" \t\x0b\x0c\r"))] for part, _ in pieces if part.split()]
    for part, size in pieces:
        words = [w for w in part.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") for w in w.split()]
        if not words:
            continue
        whole = part + b"\n" * (size - len(part))
        share = [math.sqrt(sum(b in codes for b in whole) / size) for codes in linequality._CLASSES.values()]
        mean = (len(part.rstrip(b" \t\x0b\x0c\r")) - (len(part) - len(part.lstrip(b" \t\x0b\x0c\r")))) / len(words)
        out.append(([*share, math.log1p(len(words)) / 4, min(mean / 16, 2)], len(words), size, words, part))
    again, last = [], None
    for _, _, _, words, _ in out:
        n = 0
        for w in words:
            n += w == last
            last = w
        again.append(n / len(words))
    return [([*own, float(keys.count(keys[k]) > 1), again[k], float(n < 3)], size) for k, (own, n, size, _, _) in enumerate(out)]


DOCUMENTS = ["one two three\nfour\n\nfour\nfive FIVE five!! 7", "", "  \n ", "a single line, of words.", "x | y | z\nx | y | z\n# $ %", "Ünder the über\nlast line\n", "word word word\nword other"]


def test_line_features():
    x, doc, size = linequality.lines(texts(DOCUMENTS))
    n = linequality.N_OWN
    for k, text in enumerate(DOCUMENTS):
        want = plain_lines(text)
        own = x[doc == k]
        assert len(own) == len(want) and size[doc == k].tolist() == [s for _, s in want]
        for i, (features, _) in enumerate(want):
            assert own[i, :n].tolist() == pytest.approx(features, abs=1e-5), (k, i)
            before = want[i - 1][0] if i else [0.0] * n
            after = want[i + 1][0] if i + 1 < len(want) else [0.0] * n
            assert own[i, n : 2 * n].tolist() == pytest.approx(before, abs=1e-5)
            assert own[i, 2 * n : 3 * n].tolist() == pytest.approx(after, abs=1e-5)
            assert own[i, -1] == 1


def chains(u, stay, start):
    """Weight of every labelling of a chain."""
    for labels in itertools.product((0, 1), repeat=len(u)):
        s = sum(a for a, y in zip(u, labels, strict=True) if y) + start * labels[0] + stay * sum(a == b for a, b in zip(labels, labels[1:]))
        yield labels, math.exp(s)


def expected(u, stay, start):
    """P(good) of each line, and the expected number of places where a label stays."""
    rows = list(chains(u, stay, start))
    z = sum(w for _, w in rows)
    good = [sum(w for y, w in rows if y[i]) / z for i in range(len(u))]
    same = [sum(w for y, w in rows if y[i] == y[i - 1]) / z for i in range(1, len(u))]
    return good, same


def test_training_by_enumeration():
    rows = [(t, k % 2) for k, t in enumerate([*DOCUMENTS, "other one!\nline two", "good line\nand more of it 1 2 3"])]
    field = linequality.train(rows, steps=4)
    kept = [(linequality.lines(texts([t]))[0].astype(float), y) for t, y in rows]
    kept = [(x, y) for x, y in kept if len(x)]
    n = {y: sum(1 for _, b in kept if b == y) for y in (0, 1)}
    theta = np.zeros(linequality.N_FEATURES + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 5):
        g = -1e-4 * theta
        for x, y in kept:
            weigh = 0.5 / n[y] / len(x)
            good, same = expected((x @ theta[:-2]).tolist(), theta[-2], theta[-1])
            g[:-2] += weigh * ((y - np.array(good)) @ x)
            g[-2] += weigh * sum(1 - s for s in same)
            g[-1] += weigh * (y - good[0])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta[-2] = min(theta[-2], 2.0)
    assert np.allclose(field.weight, theta[:-2], atol=1e-4) and field.stay == pytest.approx(theta[-2], abs=1e-4) and field.start == pytest.approx(theta[-1], abs=1e-4)


def test_scores_by_enumeration():
    pick = np.random.default_rng(3)
    field = linequality.Field(pick.normal(0, 0.5, linequality.N_FEATURES), 0.7, -0.4)
    got = linequality.score_texts(texts(DOCUMENTS), field)
    for text, s in zip(DOCUMENTS, got, strict=True):
        x, _, size = linequality.lines(texts([text]))
        if not len(x):
            assert s == 0
            continue
        good, _ = expected((x @ field.weight.astype(np.float32)).astype(float).tolist(), field.stay, field.start)
        assert s == pytest.approx(np.dot(good, size) / size.sum(), abs=1e-6)
