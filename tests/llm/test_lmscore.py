"""Cross-entropy difference, against counting in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from foliograph.llm import lmscore

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, target, k, mu):
    """The conditional bigram models of the docstring, counted anew for each document without it."""
    texts = [(i, SPACED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows]
    word, pair, history, n = ({m: Counter() for m in "TB"} for _ in range(4))
    for i, ws in texts:
        for m in "TB" if i in target else "B":
            word[m].update(ws)
            pair[m].update(zip(ws, ws[1:]))
            history[m].update(ws[:-1])
            n[m][""] += len(ws)
    v = len(word["B"]) + 1
    scale = {"T": 1.0, "B": n["T"][""] / n["B"][""] if n["T"][""] else 1.0}
    out = []
    for i, ws in texts:
        total = 0.0
        for m, sign in (("T", 1), ("B", -1)):
            mine = m == "B" or i in target
            own, own2, own_h = Counter(ws), Counter(zip(ws, ws[1:])), Counter(ws[:-1])
            r = scale[m]
            for at, w in enumerate(ws):
                p = (r * (word[m][w] - mine * own[w]) + k) / (r * (n[m][""] - mine * len(ws)) + k * v)
                if at:
                    x = ws[at - 1]
                    p = (r * (pair[m][x, w] - mine * own2[x, w]) + mu * p) / (r * (history[m][x] - mine * own_h[x]) + mu)
                total -= sign * math.log(p)
        out.append((i, len(ws), total / max(len(ws), 1)))
    return sorted(out, key=repr)


def test_probabilities_add_up():
    """Over the whole vocabulary, the unseen word included, P(w) and P(w | v) are distributions."""
    texts = [x.split() for x in ("a b a c", "b b a", "c a")]
    word, pair, history = Counter(), Counter(), Counter()
    for ws in texts:
        word.update(ws)
        pair.update(zip(ws, ws[1:]))
        history.update(ws[:-1])
    v, n = len(word) + 1, word.total()
    one = {w: (word[w] + 1) / (n + v) for w in [*word, "?"]}
    assert sum(one.values()) == pytest.approx(1)
    for x in word:
        assert sum((pair[x, w] + lmscore.MU * one[w]) / (history[x] + lmscore.MU) for w in one) == pytest.approx(1)


@pytest.mark.parametrize("chunk", [1, 20_000, lmscore.CHUNK_BYTES])
def test_score(spark, chunk):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, "one"), (903, "the the the"), (903, "the the the"), (None, "of the and"), (904, "x y " * 70_000)]
    target = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, row int, target int").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*target, *target, None, 77_777]], "doc_id bigint")
    got = sorted((tuple(r) for r in lmscore.score(df, ids, chunk_bytes=chunk).collect()), key=repr)
    want = brute(rows, target, lmscore.K, lmscore.MU)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2], abs=1e-9), g


def test_score_of_little(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", None)], "doc_id string, text string")
    none = df.limit(0).select("doc_id")
    assert lmscore.score(df.limit(0), none).count() == 0
    got = {r[0]: r[1:] for r in lmscore.score(df, none).collect()}
    want = {r[0]: r[1:] for r in brute([("a", "x y z"), ("b", None)], set(), lmscore.K, lmscore.MU)}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in got)


def test_target_language_is_seen(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = df.where("doc_id % 2 = 0 and lang = 'en'").select("doc_id")
    got = lmscore.score(df, train).join(df.where("doc_id % 2 = 1").select("doc_id", "lang"), "doc_id").select("score", "lang").collect()
    pairs = sorted((-r[0], int(r[1] == "en")) for r in got)
    ones = sum(y for _, y in pairs)
    auc = (sum(k for k, (_, y) in enumerate(pairs) if y) - ones * (ones - 1) / 2) / (ones * (len(pairs) - ones))
    assert auc > 0.9


def test_keys_keep_all_bits():
    """Keys that differ in any of their 64 bits stay apart on the way to a part and back."""
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 5000, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    for n in (1, 7, 64, 1000):
        edge = lmscore._edges(n)
        cut = np.searchsorted(keys >> np.uint64(48), edge.astype(np.uint64))
        back = [lmscore._unpacked_keys(*lmscore._packed_keys(keys[cut[p] : cut[p + 1]], int(edge[p]), int(edge[p + 1])), int(edge[p])) for p in range(n)]
        assert (np.concatenate(back) == keys).all()
    for x in (np.array([], np.uint32), np.array([5], np.uint32), rng.integers(0, 1 << 40, 999)):
        assert (lmscore.squeeze(x) is not None) and (lmscore.swell(lmscore.squeeze(x), x.dtype.type) == x).all()
