"""The pipeline against its stages done one by one in plain Python."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from foliograph.llm import textops, toxicity
from foliograph.llm.queries import read_tokenizer, tokenizer_path

from .test_pairs import brute_classes
from .test_rows import ALNUM, lower
from .test_suffixes import brute as brute_spans, covered, runs_of

SF = "/root/testdata/sf0.001"


def cut(rows):
    """Without repeated strings of 400 bytes and runs of over 50 words of repeated strings of 240 bytes."""
    raws = [t.encode() for _, t in rows]
    out = []
    for (i, _), raw, gone, low in zip(rows, raws, covered(raws, 400), covered(raws, 240), strict=True):
        for a, b in runs_of(low):
            if len(raw[a:b].split()) > 50:
                gone[a:b] = b"\x01" * (b - a)
        out.append((i, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = toxicity.score_texts(textops.texts(pa.array([t for _, t in rows])), model.bits, model.dense(), model.bias)
    rows = [r for r, s in zip(rows, score, strict=True) if s < 0.3]
    rows = [r for r, c in zip(rows, sorted(brute_classes(rows)), strict=True) if c[2] == r[0]]
    rows = cut(rows)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = ALNUM.findall(lower(r.text or ""))
        m = min(10, len(ws))
        windows |= {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)} if m else set()
    sizes = {len(w) for w in windows}
    clean = []
    for i, t in rows:
        ws = ALNUM.findall(lower(t))
        if not any(tuple(ws[k : k + m]) in windows for m in sizes for k in range(len(ws) - m + 1)):
            clean.append((i, t))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = []
    for i, t in clean:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).collect()) == want
    assert 0 < len(want) < docs.count()


def test_stages_keep_columns_and_handle_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5), (4, "w " * 5000, "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= docs.count(), name
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
            if name in ("toxicity", "decontamination", "suffix_dedup"):
                assert n == docs.count(), name


def test_held_out_rows_are_not_learnt_from(spark):
    from foliograph.llm import labelled

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    texts = {r.text: r.doc_id for r in docs.collect()}
    used = labelled.sample(docs, labels, "toxic", 4, 2)
    assert len(used) == sum(1 for r in labels.collect() if r.doc_id not in held)
    assert all(texts[t] not in held or sum(t == x for x in texts) > 0 for t, _ in used)
    assert brute_spans([(1, "a")], 400, 240, 50)[0][2] == 0
