"""Near-duplicate classes by SimHash fingerprints of word shingles.

A text's fingerprint is the majority vote of the 64-bit hashes of its word shingles. Fingerprints within the radius are
found by the byte-position inverted index with count filtering of ``hamming.links``: shared positional bytes are tallied
for each pair of a list, pairs that reach the guaranteed minimum are kept, and the bits are verified. Documents of one
fingerprint are one class from the start, so exact copies cost one row; components are found over the classes.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; very long
texts are read whole; a bit that half of the hashes have is 0; rows with equal doc_id are rows of their own; a null doc_id gets a fingerprint and never becomes a component id unless its whole
component has none; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import broadcast_if_small, checkpointed, portions
from foliolens.llm.components import connected_components
from foliolens.llm.hamming import links

#: Shingle hashes that vote at a time; bounds memory on very long texts.
VOTES = 1 << 16


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bit i is 1 if set in over half of the (weighted) hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        bits = np.unpackbits(hashes[at : at + VOTES].astype(">u8").view(np.uint8)).reshape(-1, 64)
        if weights is None:
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
        else:
            w = weights[at : at + VOTES]
            ones += w @ bits
            total += int(w.sum())
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def shingle_fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Lower-cases A-Z, splits at ASCII white space, and votes over the XXH64 of every run of ``words`` words."""
    own = text.encode().lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return majority(np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the long columns ``extra`` for every row of docs(doc_id, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            fp = np.array([shingle_fingerprint(t or "", words, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64)), *(b.column(c) for c in extra)], names=["doc_id", "fp", *extra])

    return docs.select("doc_id", "text", *extra).mapInArrow(found, ", ".join(f"{c} long" for c in ("doc_id", "fp", *extra)))


def components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fp, root, component_id for each distinct fp of fps(doc_id, fp): the smallest fp and the smallest doc_id reachable
    over links within the radius."""
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(links(classes, radius))
    linked = nodes.join(classes, nodes["node"] == classes["fp"]).select("fp", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(ids, "root").select("fp", "root", "component_id")
    found = classes.join(of_linked, "fp", "left")
    return found.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text)."""
    fps = checkpointed(fingerprints(docs, words))
    of_class = checkpointed(components(fps, radius))
    return fps.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text: str = "text") -> Column:
    """A 64-bit hash of a text; null counts as the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def first_of_each(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay when one row is kept of every component, given as roots(key, id, root)
    with a row for each text_key and doc_id: the row of the smallest doc_id, and of the smallest key among those. Rows without
    a doc_id stay only in components without ids, one in each."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    kept = roots.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.id").alias("_id"), F.col("first.key").alias("_key"))
    # Joined and numbered by the same columns, so rows with their texts are exchanged once.
    at = lambda i: (F.coalesce(i, F.lit(0).cast("long")).alias("_id"), i.isNull().alias("_none"))
    kept = checkpointed(kept.select("_key", *at(F.col("_id"))))
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("_key"), *at(F.col("doc_id").cast("long")))
    rows = rows.join(broadcast_if_small(kept), ["_key", "_id", "_none"])
    in_order = Window.partitionBy("_key", "_id", "_none").orderBy("row.text")
    return rows.withColumn("number", F.row_number().over(in_order)).where("number = 1").select("row.*")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay when one row is kept of every component of near duplicates."""
    keyed = docs.select("doc_id", "text", text_key().alias("key"))
    fps = checkpointed(fingerprints(keyed, words, extra=("key",)))
    roots = fps.join(components(fps, radius), "fp").select("key", F.col("doc_id").alias("id"), "root")
    return first_of_each(docs, roots)
