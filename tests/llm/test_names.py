"""Tables with columns that are named like helpers, and sessions that stay as they were."""

import pytest

from foliograph.llm import centroids, decontaminate, labelled, latticededup, licenses, linequality, lmscore, ngramjoin, rankedsearch, repetition, sentencepieces, suffixdedup, textops, toxicity, warc
from foliograph.llm.queries import read_tokenizer

NAMES = ["__at", "__word", "__slot", "__text", "__row", "__key", "__whole", "__spans0", "__spans1", "__kept", "__id", "__target", "__name", "__payload", "__own", "row", "spans", "id", "text_", "__SLOT_", "a.b"]
TEXT = "one two three four five six seven eight nine ten eleven twelve " * 12


def documents(spark):
    rows = [(k, [TEXT, TEXT, None, "", "benchmark words stand here " * 9][k % 5] if k < 10 else f"text number {k} with its own words {k * 7}", *[5] * len(NAMES)) for k in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in NAMES)).repartition(2)


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id bigint, toxic int, quality int")


def fives(df):
    return all(v == 5 for r in df.select(*[f"`{n}`" for n in NAMES]).collect() for v in r)


def test_filters_keep_every_column(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "benchmark words stand here", 3)], "item_id bigint, text string, __row int")
    keys = spark.createDataFrame([(k,) for k in range(0, 30, 3)], "__slot bigint")
    some, rest = textops.sieves(docs, "doc_id", keys)
    model = toxicity.fit(docs, labels(spark))
    for out in (some, rest, suffixdedup.deduplicated(docs), suffixdedup.deduplicated(docs, passage=240), decontaminate.clean(docs, items), toxicity.clean(docs, model)):
        assert out.columns == docs.columns and out.count() and fives(out)
    assert some.count() + rest.count() == 30
    assert suffixdedup.deduplicated(docs).count() == 30


def test_operators_ignore_other_columns(spark):
    docs = documents(spark)
    plain = docs.select("doc_id", "text")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    model = read_tokenizer()
    items = spark.createDataFrame([(1, "benchmark words stand here")], "item_id bigint, text string")
    good = labels(spark).where("quality = 1").select("doc_id")
    for run in (
        ngramjoin.similarity_classes, repetition.repetition, licenses.scan, suffixdedup.digests,
        lambda d: lmscore.score(d, good), lambda d: toxicity.classify(d, labels(spark)), lambda d: linequality.classify(d, labels(spark)),
        lambda d: decontaminate.decontaminate(d, items), lambda d: sentencepieces.digests(d, model), lambda d: rankedsearch.search(d, items),
        lambda d: warc.round_trip(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", textops.F.lit("u"))),
    ):
        assert rows(run(docs)) == rows(run(plain))


def test_embeddings_with_other_columns(spark):
    rows = [(k, [float(k % 7 + d % 3) for d in range(64)], 1, *[5] * len(NAMES)) for k in range(20)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, " + ", ".join(f"`{n}` int" for n in NAMES))
    plain = table.select("vec_id", "embedding", "label")
    for run in (centroids.cluster, latticededup.near_copies):
        assert sorted(map(tuple, run(table).collect())) == sorted(map(tuple, run(plain).collect()))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = documents(spark).withColumns({"lang": textops.F.lit("en"), "source": textops.F.lit("s"), "n_chars": textops.F.lit(1).cast("bigint")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and fives(out), name


@pytest.mark.parametrize("rows", ["10000", "77"])
def test_session_stays_as_it_was(spark, rows):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    was = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], rows)
    before = {k: spark.conf.get(k) for k in keys}
    docs = documents(spark)
    suffixdedup.digests(docs).count()
    toxicity.classify(docs, labels(spark)).count()
    ngramjoin.similarity_classes(docs).count()
    assert {k: spark.conf.get(k) for k in keys} == before
    for k, v in was.items():
        spark.conf.set(k, v)


def test_labels_without_documents(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id bigint, text string")
    many = spark.range(200_000).selectExpr("id * 1000 as doc_id", "1 as toxic").unionByName(spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    got = labelled.sample(df, many, "toxic", 5, 0, max_rows=120)
    assert len(got) >= 100 and {y for _, y in got} == {0, 1}
    assert len(labelled.sample(df, many, "toxic", 10**9, -1)) == 201  # document 0 has both labels


def test_nothing_stays_in_the_shared_folder(spark):
    import os

    folder = textops.shared_dir(spark)
    own = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = own()
    ngramjoin.similarity_classes(documents(spark)).count()
    assert {x.split("-")[0] for x in own() - before} == {"classes"}
