"""What a worker holds between tasks, and how much text is read at once."""

import corpus_pipeline
import pyarrow as pa
from foliograph.llm import sentencepieces, textops
from foliograph.llm.queries import read_tokenizer

READER = "spark.sql.parquet.columnarReaderBatchSize"


def test_workers_keep_no_model(spark):
    docs = spark.range(8).selectExpr("id as doc_id", "'some words' as text")

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepieces._models) + len(textops._powers)] * len(batch), pa.int64())], names=["n"])

    assert sentencepieces.digests(docs, read_tokenizer()).count() == 8
    assert spark.range(8).mapInArrow(held, "n bigint").groupBy().sum("n").first()[0] == 0


def test_texts_are_read_in_small_batches(spark):
    was = spark.conf.get(READER)
    for own, held in (("4096", str(textops.READ_ROWS)), ("33", "33")):
        spark.conf.set(READER, own)
        with textops.storing(spark):
            assert spark.conf.get(READER) == held
        assert spark.conf.get(READER) == own
        docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
        corpus_pipeline.encode(spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(READER) == held
    spark.conf.set(READER, was)
