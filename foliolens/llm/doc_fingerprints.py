"""Document fingerprints: SimHash over weighted terms, and search within a Hamming radius by permuted block tables.

The terms of a text are its pairs of adjacent words; each votes on the 64 bits of its hash with a weight that grows with the
logarithm of its number of occurrences, so that a separator or a repeated phrase does not decide alone. Likeness of two
fingerprints is the share of equal bits. ``hamming.neighbour_counts`` finds all fingerprints within the radius.

For the edited text of a document its successor by doc_id is needed. Documents are dealt out once by ranges of doc_id and a
hash of the text, so that rows without a doc_id, or with one and the same, are spread as well; each task walks its range in order and holds two documents at a time. The first and the last
document of each range, and nothing else, are paired over the borders in a second step. What the texts were exchanged
through is removed from disk as soon as the walk is written.

Defined results: a null text is empty; a text without words has fingerprint zero; very long texts are read whole; the order
is doc_id, nulls first, ties by the XXH64 of the text and then the text; a single document is its own successor; repeated
rows follow one another; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import checkpointed, checkpointed_and_cleared, portions
from foliolens.llm.hamming import neighbour_counts
from foliolens.llm.near_dedup import majority

RADIUS = 3
SEED = 42
ROW = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"
SCHEMA = f"{ROW}, range int, head string, tail string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def fingerprint(text: str) -> int:
    """Weighted majority of the hashes of adjacent word pairs; a pair that occurs n times has weight 1 + floor(log2 n)."""
    words = text.lower().encode().split()
    if not words:
        return 0
    terms = Counter(map(b" ".join, zip(words, words[1:], strict=False))) if len(words) > 1 else Counter(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t, SEED) for t in terms), np.uint64, len(terms))
    return majority(hashes, np.fromiter((n.bit_length() for n in terms.values()), np.int64, len(terms)))


def edited(text: str, following: str) -> str:
    """The last quarter of the characters gives way to as many, or all, from the start of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _row(doc: int | None, text: str, fp: int, following: str, following_fp: int) -> tuple:
    other = edited(text, following)
    other_fp = fp if other == text else fingerprint(other)
    return doc, len(text), hashlib.sha256(other.encode()).hexdigest(), signed(fp), signed(other_fp), signed(following_fp)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order; its last document has no successor here, so it and the first text are passed on."""
    at, before, rows = TaskContext.get().partitionId(), None, []
    first = None
    for b in portions(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            fp = fingerprint(text)
            if before is None:
                first = text
            else:
                rows.append((*_row(*before, text, fp), at, None, None))
            before = (doc, text, fp)
            if len(rows) >= 2048:
                yield _batch(rows)
                rows = []
    if before is not None:
        rows.append((before[0], None, None, None, None, None, at, first, before[1]))
        yield _batch(rows)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches):
        rows = []
        for doc, tail, head in zip(b.column("doc_id").to_pylist(), b.column("tail").to_pylist(), b.column("following").to_pylist(), strict=True):
            rows.append((*_row(doc, tail, fingerprint(tail), head, fingerprint(head)), None, None, None))
        if rows:
            yield _batch(rows).select(_NAMES[:6])


def with_successors(docs: DataFrame) -> DataFrame:
    """The columns of ROW for every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    walked = checkpointed_and_cleared(dealt.select("doc_id", "text").mapInArrow(_walk, SCHEMA))
    ends = walked.where("tail is not null")
    order = ends.select("range").withColumn("next", F.lead("range").over(Window.orderBy("range")))  # one number for each range
    order = order.withColumn("next", F.coalesce("next", F.min("range").over(Window.partitionBy())))
    heads = ends.select(F.col("range").alias("next"), F.col("head").alias("following"))
    pairs = ends.select("doc_id", "range", "tail").join(order, "range").join(heads, "next").select("doc_id", "tail", "following")
    return walked.where("tail is null").select(_NAMES[:6]).unionByName(pairs.mapInArrow(_borders, ROW))


def _hex(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _likeness(a: str, b: str):
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def fingerprint_report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints, edited fingerprints and likenesses of every row of docs(doc_id, text), and n_near: the number of
    other rows whose fingerprint is within the radius."""
    rows = checkpointed(with_successors(docs))
    classes = checkpointed(rows.groupBy("fp").agg(F.count("*").alias("n")))
    near = classes.join(neighbour_counts(classes, radius).withColumnRenamed("n", "others"), "fp", "left")
    near = checkpointed(near.select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")))
    return rows.join(near, "fp").select(
        "doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        _likeness("fp", "edited_fp").alias("near_edited"), _likeness("fp", "next_fp").alias("near_next"), "n_near",
    )
