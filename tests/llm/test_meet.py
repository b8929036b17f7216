"""What the pairwise step of the similarity join puts out."""

import numpy as np
import pyarrow as pa

from foliograph.llm import ngramjoin as J


def put_out(sets, keys):
    bits = J.parities(sets)
    rows = [(k, d) for k in range(keys) for d in range(len(sets))]
    key, doc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    zero, n = np.zeros(len(rows), np.int32), np.array([len(s) for s in sets], np.int64)[doc]
    table = pa.table({"key": key, "doc": doc, "component": doc, "probes": doc == 0, "a": zero, "b": zero, "side": zero > 0, "least": n, "most": n, "bits": pa.array(list(bits[doc]), pa.list_(pa.int64()))})
    return [(r["a"], r["b"]) for b in J._meet(J.PERCENT)(iter(table.to_batches(max_chunksize=64))) for r in b.to_pylist()]


def test_a_pair_of_many_keys_is_put_out_once():
    s = np.random.default_rng(3).integers(0, 2**63, 1000).astype(np.uint64)
    assert put_out([np.sort(s[:900]), np.sort(s[100:])], 300) == [(0, 1)]


def test_long_texts_that_share_a_passage_are_no_candidates():
    s = np.random.default_rng(4).integers(0, 2**63, 3000).astype(np.uint64)
    assert put_out([np.sort(s[:1550]), np.sort(s[1450:])], 5) == []
