"""Decontamination: the size of the benchmark changes no row."""

import random

import pyarrow as pa

from foliograph.llm import decontaminate, textops


def test_blocks_keep_every_row(spark):
    item = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    items = spark.createDataFrame([(k, item(k)) for k in range(6)], "item_id bigint, text string")
    plain = " ".join(f"p{i}" for i in range(12))
    own = [(1, item(0)), (1, item(0)), (1, item(5)), (1, plain), (None, item(1)), (None, item(4)), (None, plain), (None, plain), (2, f"{item(2)} and {item(3)}"), (3, None), (3, ""), (None, None)]
    docs = spark.createDataFrame(own, "doc_id bigint, text string").repartition(3)

    def rows(most):
        got = decontaminate.decontaminate(docs, items, max_patterns=most)
        return sorted([(r.doc_id, r.n_words, r.n_hit, r.items, [tuple(x) for x in r.spans], r.contaminated) for r in got.collect()], key=repr)

    whole = rows(decontaminate.MAX_PATTERNS)
    assert len(whole) == len(own)
    assert (None, 12, 12, [4], [(0, 12)], True) in whole and (2, 25, 24, [2, 3], [(0, 12), (13, 25)], True) in whole
    assert rows(24) == rows(1) == whole


def test_search_against_all_windows():
    """Shifts skip no occurrence, in lanes of any width, and patterns may repeat their own blocks."""
    rng = random.Random(5)
    for width in (1, 3, 64):
        for _ in range(40):
            word = lambda: rng.choice(["a", "b", "ab", "é"])
            texts = [[word() for _ in range(rng.randint(0, 90))] for _ in range(rng.randint(1, 5))]
            items = [[word() for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 6))]
            groups = decontaminate.patterns([(k, " ".join(x).encode()) for k, x in enumerate(items)], 4)
            own = textops.texts(pa.array([" ".join(x) for x in texts]))
            w = textops.Words(own, textops.ALNUM_SEP, lower=True)
            decontaminate.LANE, was = width, decontaminate.LANE
            got = {(int(at), g.size, tuple(sorted(g.items[p].tolist()))) for g, ats, which in decontaminate.search(groups, w) for at, p in zip(ats, which, strict=True)}
            decontaminate.LANE = was
            windows = {}
            for k, x in enumerate(items):
                m = min(4, len(x))
                for i in range(len(x) - m + 1 if m else 0):
                    windows.setdefault(tuple(x[i : i + m]), set()).add(k)
            want, base = set(), 0
            for x in texts:
                for m in {len(y) for y in windows}:
                    want |= {(base + i, m, tuple(sorted(windows[tuple(x[i : i + m])]))) for i in range(len(x) - m + 1) if tuple(x[i : i + m]) in windows}
                base += len(x)
            assert got == want


def test_item_ids_of_any_type(spark):
    items = spark.createDataFrame([("b-2", "one two three"), ("a-1", "one two three"), ("a-1", "four five"), (None, "six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero One, two three"), (2, "four five six"), (3, "six")], "doc_id bigint, text string")
    for most in (decontaminate.MAX_PATTERNS, 1):
        got = {r.doc_id: (r.items, r.n_hit) for r in decontaminate.decontaminate(docs, items, max_patterns=most).collect()}
        assert got == {1: (["a-1", "b-2"], 3), 2: (["a-1"], 2), 3: ([], 0)}
