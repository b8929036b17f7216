"""Operators that give one row for each row, against plain Python."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import types as ty

from foliograph.llm import decontaminate, licenses, linequality, repetition, sentencepieces, toxicity, warc
from foliograph.llm.queries import QUERIES, read_tokenizer

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n\n", "a", "a b c d e f g h a b c d e f g h", "x " * 3000, "Line one\nLine one\nother\n", "é ß 日本 é ß 日本", "CC-BY cc by, all rights  reserved General Public\nLicense", "a\x00b\x1fc", "one\r\ntwo", "#*$ |x| <y>", "\ttab\x0bsep\x0c"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    own = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    own += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_001, "again"), (None, "no id at all")]
    schema = "doc_id bigint, text string, score double, n_words string"
    return own, spark.createDataFrame([(i, t, 0.5, "clash") for i, t in own], schema).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_repetition(docs):
    own, df = docs
    want = []
    for i, t in own:
        t = t or ""
        ws = SPACED.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if SPACED.search(x):
                dup += x in seen
                seen.add(x)
        count = {}
        for k in range(len(ws) - 7):
            count.setdefault(tuple(ws[k : k + 8]), []).append(k)
        inside = {k + j for v in count.values() if len(v) > 1 for k in v for j in range(8)}
        base = len(ws) < 20 or 100 * len(inside) > 30 * len(ws)
        want.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), base))
    got = repetition.repetition(df)
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert got.where("base_failed and kept").count() == 0


def brute_shares(text):
    ws = SPACED.findall(text)
    total = max(sum(map(len, ws)), 1)
    out = []
    for n in range(5, 11):
        count = {}
        for k in range(len(ws) - n + 1):
            count.setdefault(tuple(ws[k : k + n]), []).append(k)
        inside = {k + j for v in count.values() if len(v) > 1 for k in v for j in range(n)}
        out.append(sum(len(ws[k]) for k in inside) / total)
    return out


def test_repetition_shares(docs):
    own, df = docs
    text = {i: t or "" for i, t in own if i != 10_001}
    for r in repetition.repetition(df.where("doc_id != 10001")).collect():
        assert r.dup_ngram_share == pytest.approx(brute_shares(text[r.doc_id])), r.doc_id


def test_licenses(docs):
    own, df = docs
    want = []
    for i, t in own:
        ws = ALNUM.findall(lower(t or ""))
        places, labels = [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            at = [k for k in range(len(ws) - len(p) + 1) if ws[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.scan(df)
    assert rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    for r in got.collect():
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_rules():
    every = licenses.rules()
    assert len(every) > 300
    found = licenses.detect("this work is licensed under the apache license, version 2.0. see gpl-3.0 too.", every)
    assert [x.label for x in found] == ["apache-2.0", "gpl-3"]
    assert [x.label for x in licenses.detect("under cc by-nc 4.0", every)] == ["cc-by-nc"]


def test_decontaminate(spark, docs):
    own, df = docs
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(900, "a b c"), (901, None), (902, ""), (903, "é ß"), (900, "a b c")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    windows = {}
    for i, t in bench:
        ws = ALNUM.findall(lower(t or ""))
        m = min(10, len(ws))
        for k in range(len(ws) - m + 1 if m else 0):
            windows.setdefault(tuple(ws[k : k + m]), set()).add(i)
    want = []
    for i, t in own:
        ws = ALNUM.findall(lower(t or ""))
        hit, ids = set(), set()
        for m in {len(w) for w in windows}:
            for k in range(len(ws) - m + 1):
                if (found := windows.get(tuple(ws[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    ids |= found
        want.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    want.sort(key=repr)
    assert rows(decontaminate.digest(decontaminate.decontaminate(df, items))) == want
    assert sum(w[-1] for w in want) > 3
    one = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    whole = rows(decontaminate.digest(decontaminate.decontaminate(one, items)))
    assert rows(decontaminate.digest(decontaminate.decontaminate(one, items, max_patterns=400))) == whole
    assert decontaminate.decontaminate(df, items.limit(0)).where("contaminated").count() == 0


def test_sentencepiece(spark, docs):
    import sentencepiece
    from foliograph.llm.queries import tokenizer_path

    own, df = docs
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    model = read_tokenizer()
    ids = {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t in own if i != 10_001}
    one = df.where("doc_id is null or doc_id != 10001")
    coded = sentencepieces.encode(one, model, round_trip=True).cache()
    for r in coded.collect():
        assert r.ids == ids[r.doc_id], r.doc_id
        assert r.decoded == library.decode(r.ids)
    assert rows(sentencepieces.decode(coded, model)) == rows(coded.select("doc_id", "decoded"))
    for r in sentencepieces.digests(one, model).collect():
        assert r.n_tokens == len(ids[r.doc_id])
    coded.unpersist()


def test_sentencepiece_pairs():
    import random

    m = sentencepieces.Model(read_tokenizer())
    pick = random.Random(3)
    pool = list(m.ids)
    for _ in range(3000):
        a, b = pick.choice(pool), pick.choice(pool).lstrip("▁")
        if b in m.ids and set(a) != {"▁"} and m.merge(a) == [a] and m.merge(b) == [b]:
            assert m.agree(m.ids[a], m.ids[b]) == (m.merge(a + b) == [a, b])


def test_classifiers(spark, docs, empty):
    _, df = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for found in (toxicity.classify(df, labels), linequality.classify(df, labels)):
        got = found.collect()
        assert len(got) == df.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = labels.limit(0)
    assert toxicity.classify(df, none).where("predicted = 1").count() == 0
    assert {round(r.score, 9) for r in linequality.classify(df, none).collect()} <= {0.0, 0.5}
    assert toxicity.classify(empty, labels).count() == linequality.classify(empty, labels).count() == 0


def auc(score, label):
    pairs = sorted(zip(score, label, strict=True))
    ones = sum(label)
    rank = sum(k for k, (_, y) in enumerate(pairs) if y)
    return (rank - ones * (ones - 1) / 2) / (ones * (len(pairs) - ones))


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.85), ("op7_line_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    found = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", label).collect()
    assert auc([r[0] for r in found], [r[1] for r in found]) > least


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    first = np.array([0, 3, 4, 8])
    u = rng.normal(size=8)
    stay, start = 0.7, -0.3
    good, same, log_z = linequality.marginals(u, first, stay, start)
    for c in range(3):
        a, b = first[c], first[c + 1]
        z, g, s = 0.0, np.zeros(b - a), np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            e = np.exp(sum(u[a + k] for k in range(b - a) if y[k]) + start * y[0] + stay * sum(y[k] == y[k - 1] for k in range(1, b - a)))
            z += e
            g += e * np.array(y)
            s[1:] += e * np.array([y[k] == y[k - 1] for k in range(1, b - a)])
        assert np.allclose(good[a:b], g / z)
        assert np.allclose(same[a + 1 : b], (s / z)[1:])
        assert np.isclose(log_z[c], np.log(z))


def test_warc(spark):
    html = [(1, "u1", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u3", None), (4, "u4", ""), (5, "u\r\n5", "é" * 40_000), (6, "u6", "a\r\n\r\nb"), (7, "u7", "<p>a</p>"), (None, "x", "<p>a</p>"), (None, "y", "alone"), (None, "y", "alone"), (9, "u9", "\x00")]
    df = spark.createDataFrame([(*r, "clash") for r in html], "page_id bigint, url string, html string, payload string")
    first = {}
    for i, _, h in html:
        if i is not None:
            first.setdefault(h or "", i)
    want = []
    for i, _, h in html:
        raw, f = (h or "").encode(), first.get(h or "", i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert rows(warc.round_trip(df)) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = str(tmp_path / "w")
    warc.write(pages, path, archive_bytes=20_000)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    text = {r.page_id: r.html or "" for r in pages.collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        if r.record_type == "response":
            assert bytes(r.payload).decode() == text[i]
        else:
            assert text[r.refers_to] == text[i] and r.refers_to < i
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 2
    raw = files[0].read_bytes()
    with pytest.raises(warc.BadArchive):
        list(warc.frames(raw[: len(raw) // 2]))
    with pytest.raises(warc.BadArchive):
        warc.parse(warc.build(1, "u", b"payload", None).replace(b"payload", b"pay1oad"))
    with pytest.raises(warc.BadArchive):
        warc.parse(warc.build(1, "u", b"payload", None)[:-1])


def test_empty_tables(spark, empty):
    assert repetition.repetition(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert sentencepieces.digests(empty, read_tokenizer()).count() == 0
    assert isinstance(repetition.repetition(empty).schema, ty.StructType)
