"""Pages as a stream of files: an extension, no part of the batch contract.

Defined results: a file is taken once, by its path; files that cannot be decoded are
listed apart; a batch without files writes nothing; a batch that is repeated writes
the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import normalize as N
from ..sources import forms

#: Most files of a micro-batch.
FILES = 1000


def watch(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, modificationTime, length) of image files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", FILES).load(path).select("path", "modificationTime", "length")


def normalize_stream(spark: SparkSession, path: str, templates: list[dict], out: str, checkpoint: str, glob: str = "*.{png,jpg,jpeg}", once: bool = False) -> StreamingQuery:
    """Normalizes new files and appends documents and crops below `out`. Files that can't be decoded are listed in `out`/rejected.

    FILES files make a batch at most, so the names that the driver sees are bounded. A batch is written under its number, so a batch that is repeated after a failure overwrites its own files.
    """

    def batch(files: DataFrame, number: int) -> None:
        paths = [r.path for r in files.select("path").collect()]  # the names of one micro-batch
        if not paths:
            return
        pages, bad = forms.read_pages(files.sparkSession, paths, glob)
        docs = N.normalize(pages, templates)
        docs.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        N.field_crops(files.sparkSession.read.parquet(f"{out}/documents/batch={number}")).write.mode("overwrite").parquet(f"{out}/crops/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    writer = watch(spark, path, glob).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
