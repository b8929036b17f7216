"""The corpus pipeline: documents in, encoded clean text out.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before
kept, and returns a DataFrame; all but the last return the columns of documents.
Rows that a stage rejects are gone, and texts that it changes stay changed.

The pipeline is an application and settles its session: Python workers get
`textops.BATCH_ROWS` rows at once and Parquet's reader decodes
`textops.READ_ROWS`, unless the session already has other numbers than Spark's
defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import decontaminate, ngramjoin, sentencepieces, suffixdedup, textops, toxicity
from foliograph.llm.queries import read_tokenizer, table


def _settled(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session whose batches are small: what it returns is run later, by whoever writes it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        textops.settle(spark)
        return stage(spark, docs, sf_dir)

    return run


@_settled
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold.

    Null and empty texts score the bias alone and stay; rows without an id and repeated rows are judged by their own text; without labels, or with empty tables, nothing is rejected.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_settled
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class: that with the smallest id.

    Empty texts and rows without an id belong to no class and stay; rows with one id are one document and stay or go together; an empty table stays empty.
    """
    others = ngramjoin.similarity_classes(docs).where("doc_id != component_id").select("doc_id").distinct()
    some, rest = textops.sieves(docs, "doc_id", others)
    return rest.unionByName(some.join(others.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))


@_settled
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 400 bytes and the passages of over 50 words that stand elsewhere too; n_chars follows the text.

    Null texts become empty; a text that repeats another one as a whole stays as a row with what is left of it, rows of equal id and text too; rows without an id take part; an empty table stays empty.
    """
    cut = suffixdedup.deduplicated(docs, passage=suffixdedup.PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns])


@_settled
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and empty texts stay; repeated rows and rows without an id are judged by their own text; an empty benchmark rejects nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_settled
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of ids and decoded text: a row for each row.

    Null and empty texts give the begin and end ids alone; repeated rows give equal rows; an empty table gives an empty result.
    """
    return sentencepieces.digests(docs, read_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Neither classifier nor tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored, and the next one reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = textops.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            textops.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
