"""Documents as they arrive: a stream of words to typed documents.

A page is complete in the file that brings it, so each micro-batch is a table of whole pages and takes the same plans as
a batch; there is no state to keep. The sink is written once for each batch number, so a batch that runs again
overwrites its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliolens.operators.documents import document_types, free_fields
from foliolens.operators.layout import read_lines

WORDS = "page_id string, word_no int, x0 double, y0 double, x1 double, y1 double, text string"


def word_stream(spark: SparkSession, path: str) -> DataFrame:
    """Words of pages from Parquet files as they appear in a folder."""
    return spark.readStream.schema(WORDS).parquet(path)


def typed_pages(words: DataFrame) -> DataFrame:
    """page_id, tipo, and the free fields of each page of words."""
    lines = read_lines(words)
    return document_types(lines).join(free_fields(lines), "page_id")


def start(words: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Typed pages of a word stream, under a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        typed_pages(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = words.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
