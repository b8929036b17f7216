"""Ranked search against a full evaluation in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from foliograph.llm import rankedsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def terms(text):
    return TERM.findall(lower(text or ""))


def brute(docs, items, top=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        query, scores = Counter(terms(text)), []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(r * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in query.items() if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(9, t, i, 1, b"x") for i, t in docs], "item bigint, text string, doc_id bigint, n int, terms binary").repartition(4)
    q = spark.createDataFrame([(t, i, 3) for i, t in items], "text string, item_id bigint, rank int").repartition(2)
    return sorted((tuple(r) for r in rankedsearch.search(d, q, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["Ünder", "x1", "THE", "the"]
    text = lambda size: " ".join(words[min(int(pick.expovariate(0.05)), len(words) - 1)] + pick.choice(["", "", ".", ","]) for _ in range(size))
    return [(i, text(pick.choice([1, 3, 8, 30, 200]))) for i in range(n)], [(i, text(pick.choice([1, 4, 12, 40]))) for i in range(12)]


@pytest.mark.parametrize("blocks", [1 << 20, 40])
def test_search(spark, blocks):
    docs, items = corpus(1, 260)
    docs += [(900, None), (901, ""), (902, " .,\n"), (None, "w1 w2 w3"), (5, "w1 w1 w1"), (903, "W5 w6 " * 3000)] + [(1000 + k, "w30 w31 w32 w33") for k in range(50)] + [(7, "w30 w31 w32 w33")] * 2
    items += [(50, None), (51, ""), (52, "nowhere at all"), (53, "w30 W31 w32 w33 w33"), (0, "w30")]
    assert got(spark, docs, items, block_terms=blocks) == brute(docs, items)


def test_empty(spark):
    docs, items = corpus(2, 5)
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, None)], items) == []


def test_small_steps(spark, monkeypatch):
    monkeypatch.setattr(rankedsearch, "CELLS", 7)
    docs, items = corpus(3, 80)
    assert got(spark, docs, items, top=3) == brute(docs, items, 3)


def test_bounds():
    """A byte bounds its impact from above, one step less from below."""
    pick = np.random.default_rng(4)
    weights, tf = pick.integers(0, 26_000, 4000), pick.integers(1, 5000, 4000)
    impact = weights * rankedsearch.shares(tf, pick.integers(1, 10_000, 4000), 1000, 300_000)
    step = rankedsearch.steps(weights)
    byte = -(-impact // step)
    assert byte.max() <= 255 and (byte * step >= impact).all() and (np.maximum(byte - 1, 0) * step + (byte > 0) <= np.maximum(impact, byte > 0)).all()
