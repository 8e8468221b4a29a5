"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts take room in the JVM, in the worker and in what it derives from them.
BATCH_ROWS = 512


def in_session(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The plan of df in another session, by whose settings it runs."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.logicalPlan()), spark)


def in_copy(df: DataFrame, setting: str, value: str) -> DataFrame:
    """df in a copy of its session, with all its settings but this one; the session itself stays as it is."""
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set(setting, value)
    return in_session(df, SparkSession(spark.sparkContext, own))


def in_small_batches(docs: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """docs in a copy of its session in which Arrow batches have few rows."""
    return in_copy(docs, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_small_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def portions(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a few at a time, however large the batches are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names (spark.checkpoint.dir). Only where none is named, as in tests on one
    machine, a temporary one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliolens-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared checkpoint folder; the lineage is cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpointed_and_cleared(df: DataFrame) -> DataFrame:
    """As checkpointed, and the files that df was shuffled through are removed then, not only when the driver collects
    garbage: for exchanges of whole texts, which would take disk beside all that follows."""
    own = checkpointed(in_copy(df, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
    return in_session(own, df.sparkSession)


def broadcast_if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, else as it is, for a shuffled join. df should be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python texts; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def single_threaded() -> None:
    """A task has one core; native libraries must not start pools of their own."""
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_RS_NUM_CPUS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "false" if name.startswith("TOK") else "1")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def sliced(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]
