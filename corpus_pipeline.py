"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results in every stage: an empty table gives an empty table; very long texts are read whole; rows with a null or
repeated doc_id are rows of their own; columns that the table has besides are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm import language, mixing, packing, pii, similar
from foliolens.llm.common import crc32_mod, in_small_batches, shared_folder

#: A document is rejected if its text has no letter or if no language reaches this score: a posterior times how well the
#: text's words suit the language, which is one half at a limit that the training fold sets.
LEAST_LANGUAGE_SCORE = 0.5
#: Texts are near duplicates from this Jaccard similarity of their word shingles on.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: No source is repeated more often than this for one pass over the largest.
MAX_REPEATS = 1.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that was learned; letter junk, other languages, null, empty and letterless texts go.
    Repeated rows share one fate. Ties between languages change nothing, as only the score decides."""
    docs = in_small_batches(docs)
    return language.identified(docs, language.fit(docs, crc32_mod("doc_id", 3) != 1), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates (five-word shingles, Jaccard similarity of 0.8): that of the
    smallest doc_id, once if its row is repeated; ties go to the smallest hash of the text. Null and empty texts are one
    component; rows without a doc_id stay only in components without ids, one in each."""
    return similar.one_of_similar(in_small_batches(docs), SHINGLE_WORDS, SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text. All rows stay; null and empty texts stay as they
    are; where found spans overlap they are replaced together, by the kind of the first."""
    return pii.redacted(in_small_batches(docs)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources by the temperature that the repetition limit allows; every document stays. A null
    source is a source; a null or empty text counts one token; equal rows are repeated together. Rows are written in the
    order of the mixture."""
    return mixing.repeated(docs, max_repeats=MAX_REPEATS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null or empty text is one token; ties in length keep the
    order of rows; a repeated row is packed as often as it comes."""
    return packing.pack(in_small_batches(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_sources", mixing_sources),
    ("packing", packed_sequences),
]

#: Learned models, hashes and tokenizers have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
