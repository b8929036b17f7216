"""The bounds of the sample that classifiers are fitted on."""

from foliograph.llm import labelled


def test_one_id_many_times(spark):
    rows = [(7, "b" * 50 if k else "a text") for k in range(3000)] + [(k, f"text {k}") for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1)] + [(k, k % 2) for k in range(100, 130)], "doc_id bigint, toxic int")
    got = labelled.sample(df, labels, "toxic", 10**9, -1, max_rows=100)
    assert len(got) == 31 and got.count(("a text", 1)) == 1
    assert len(labelled.sample(df, labels, "toxic", 10**9, -1, max_rows=10)) <= 10


def test_characters_are_bounded(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "y" * 30), (3, None), (None, "z"), (4, "w" * 30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (4, 5), (5, 1), (None, 1)], "doc_id bigint, toxic int")
    got = labelled.sample(df, labels, "toxic", 10**9, -1, max_chars=100)
    assert sorted(got) == [("", 1), ("y" * 30, 0), ("y" * 30, 1)]
    assert labelled.sample(df.limit(0), labels, "toxic", 10**9, -1) == [] == labelled.sample(df, labels.limit(0), "toxic", 10**9, -1)


def test_held_out_rows_stay_out(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(200)], "doc_id bigint, toxic int")
    import zlib

    got = {t for t, _ in labelled.sample(df, labels, "toxic", 4, 2)}
    assert got == {f"t{k}" for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2}
