"""Repeated byte strings, against a dictionary of all windows."""

import hashlib
import random

import pytest

from foliograph.llm import suffixdedup

SF = "/root/testdata/sf0.01"


def covered(raws, size):
    """For each text which bytes some repeated string of this size covers."""
    seen = {}
    for raw in raws:
        for k in range(len(raw) - size + 1):
            w = raw[k : k + size]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            if seen[raw[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        out.append(gone)
    return out


def runs_of(gone):
    starts = [k for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])]
    ends = [k + 1 for k in range(len(gone)) if gone[k] and not (k + 1 < len(gone) and gone[k + 1])]
    return list(zip(starts, ends, strict=True))


def brute(rows, size, passage, words):
    raws = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), raw, gone, low in zip(rows, raws, covered(raws, size), covered(raws, passage), strict=True):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        counts = [len(raw[a:b].split()) for a, b in runs_of(low)]
        out.append((i, len(raw), sum(gone), len(runs_of(gone)), hashlib.sha256(kept).hexdigest(), sum(c for c in counts if c > words)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=120):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(pick.randint(5, 40)) for _ in range(4)]
    out = []
    for i in range(n):
        kind = pick.random()
        if kind < 0.25 and out:
            t = pick.choice(out)[1]
            k = pick.randint(0, len(t))
            t = pick.choice([t, t[:k] + "XY" + t[k:], t[k:], t[:k]])
        else:
            t = text(pick.choice([0, 1, 5, 30, 90]))
            if kind < 0.7:
                t = t + pick.choice(shared) + text(3)
        out.append((i, t))
    out += [(500, "z" * 300), (501, "ab" * 200), (502, "z" * 41), (503, None), (504, ""), (None, "q" * 39 + text(20)), (3, out[5][1]), (3, out[5][1]), (505, out[7][1])]
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 512), (2, 512), (3, 2), (4, 5)])
def test_repeated_strings(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, row string, spans int").repartition(4)
    for passage, words in ((24, 4), (40, 6), (60, 0)):
        assert rows_of(suffixdedup.digests(df, size=40, passage=passage, words=words)) == brute(rows, 40, passage, words)


def test_repeated_strings_in_blocks(spark, monkeypatch):
    for name, value in (("LOCAL_BYTES", 3000), ("RUN_BYTES", 2000)):
        monkeypatch.setattr(suffixdedup, name, value)
    rows = corpus(8, 200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(suffixdedup.digests(df, size=40, passage=24, words=4)) == brute(rows, 40, 24, 4)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert rows_of(suffixdedup.digests(df)) == brute(rows, 400, 240, 50)


def test_deduplicated_keeps_columns(spark):
    rows = corpus(11)
    df = spark.createDataFrame([(t, i, "en", 1, 2) for i, t in rows], "text string, doc_id bigint, lang string, spans int, row int")
    out = suffixdedup.deduplicated(df, size=40)
    assert out.columns == df.columns
    assert out.count() == df.count()
    assert suffixdedup.digests(df.limit(0)).count() == 0


def test_loser_tree():
    pick = random.Random(2)
    runs, every = [], []
    for _ in range(13):
        r = sorted(bytes(pick.choice(b"ab") for _ in range(pick.randint(0, 12))) for _ in range(pick.randint(0, 30)))
        every += r
        runs.append([(s, suffixdedup.common(r[k - 1], s) if k else 0, 0) for k, s in enumerate(r)])
    got = list(suffixdedup.LoserTree([iter(r) for r in runs]))
    assert [s for _, s, _ in got] == sorted(every)
    assert all(h == suffixdedup.common(a[1], s) for a, (h, s, _) in zip(got, got[1:]))


def test_a_text_over_16_mib(spark):
    """A passage of a very long text is found in a short one: places beyond 24 bits choose anchors like others."""
    import numpy as np

    letters = np.random.default_rng(6).integers(97, 123, 17 << 20).astype(np.uint8)
    long = letters.tobytes().decode()
    a, n = 16_900_000, 3000
    other = lambda c: "0" if c != "0" else "1"
    short = other(long[a - 1]) * 700 + long[a : a + n] + other(long[a + n]) + "tail " + long[5 : 5 + 399]
    rows = [(1, long), (2, short)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r for r in suffixdedup.digests(df).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (17 << 20, n, 1)
    assert (got[2].n_removed, got[2].n_spans) == (700 + n, 1)  # the run of one letter repeats itself
    assert got[1].kept_sha256 == hashlib.sha256((long[:a] + long[a + n :]).encode()).hexdigest()
