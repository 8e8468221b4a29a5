"""Near-duplicate components by Jaccard similarity of word shingles: SimHash links and MinHash bands propose, exact sets
decide.

A text's set holds the 64-bit hashes of its word shingles (XXH64, as in ``near_dedup``; a text of fewer words is one
shingle). Their majority vote is the text's fingerprint; fingerprints are linked by the byte-position inverted index
with count filtering of ``hamming.links``, and texts that it links are compared. At the limits used here most similar texts differ in
more bits than positional bytes can guarantee, so MinHash proposes as well: of ``BANDS`` * ``BAND_ROWS`` minimum hashes, each run of ``BAND_ROWS`` makes a band; two texts are compared if
they share a band too, which a pair of similarity s does with probability 1 - (1 - s^6)^32: 0.99994 at 0.8, and 0.002 at 0.2.
Compared texts are linked if the exact Jaccard similarity of their sets reaches the limit; no estimate decides.

Equal texts are one class from the start. Classes that share bands or are linked, directly or through others, form a cluster; the sets
of a cluster are shipped once (in parts of ``PART`` shingles, where each pair of parts is compared in a task of its own),
so neither a hot band nor a large group of near copies is written once for each pair. Classes already linked are not
compared again: a group of near copies costs about one comparison a member.

Defined results: a null text is empty; texts without words are near duplicates of each other; very long texts are read
whole; rows with equal doc_id are rows of their own, unless their texts are equal too; of a component the row of the
smallest doc_id stays, on ties that of the smallest hash of its text; a row without a doc_id stays only where no other row
of its component has one; an empty table gives an empty table; all columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import broadcast_if_small, checkpointed, portions
from foliolens.llm.components import connected_components
from foliolens.llm.hamming import byte_keys, links
from foliolens.llm.near_dedup import first_of_each, majority, text_key

BANDS, BAND_ROWS = 32, 6
#: Fingerprints of at most so many differing bits are linked; the index takes no more.
RADIUS = 4
PART = 1 << 20
#: Shingles hashed at a time; bounds memory on very long texts.
CHUNK = 1 << 12


def shingle_set(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of every run of ``words`` words; words are lower-cased (A-Z) and split at ASCII white space."""
    own = text.encode().lower().split()
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops)))


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(17)
    n = BANDS * BAND_ROWS
    draw = lambda k: r.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(n), draw(n), draw(BAND_ROWS)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One signed 64-bit value for each band."""
    a, b, mix = _factors()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        least = np.minimum(least, (shingles[at : at + CHUNK, None] * a + b).min(axis=0))
    # The low bits of a product are poor; the high ones decide the order and alone go into the band.
    return ((least >> np.uint64(16)).reshape(BANDS, BAND_ROWS) * mix).sum(axis=1, dtype=np.uint64).view(np.int64)


def positional(fp: int) -> np.ndarray:
    """The keys of a fingerprint in the byte-position index, as signed values: fingerprints within ``RADIUS`` share one."""
    keys, _ = byte_keys(RADIUS, 0)
    return np.array([sum((fp >> at & (1 << bits) - 1) << 8 * i for i, (at, bits) in enumerate(key)) for key in keys], np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def linked_pairs(found: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect what all similar pairs with a common proposal (columns of ``found``) connect."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    tried: set[tuple[int, int]] = set()

    def link(g: list[int], h: list[int]) -> bool:
        for x in g:
            for y in h:
                pair, sizes = (min(x, y), max(x, y)), (len(sets[x]), len(sets[y]))
                if pair in tried or min(sizes) < similarity * max(sizes):
                    continue
                if jaccard(sets[x], sets[y]) >= similarity:
                    parent[find(x)] = find(y)
                    out.append((x, y))
                    return True
                tried.add(pair)
        return False

    for band in found.T:
        order = np.argsort(band, kind="stable")
        for run in np.split(order, np.nonzero(np.diff(band[order]))[0] + 1):
            groups: dict[int, list[int]] = {}
            for x in run.tolist() if len(run) > 1 else ():
                groups.setdefault(find(x), []).append(x)
            done: list[list[int]] = []
            for g in groups.values():
                apart = []
                for h in done:
                    if link(g, h):
                        g = h + g
                    else:
                        apart.append(h)
                done = [*apart, g]
    return out


def _banded(docs: DataFrame, words: int) -> DataFrame:
    """key, id, size (of the shingle set), fp (its fingerprint as a signed long) and bands for every row of docs(doc_id, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            size, fp, own = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t or "", words)
                size.append(len(s))
                fp.append(majority(s))
                own.append(bands(s))
            flat = pa.array(np.concatenate(own) if own else np.empty(0, np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * BANDS), flat)
            signed = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(size, pa.int64()), signed, listed], names=["key", "id", "size", "fp", "bands"])

    rows = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(found, "key long, id long, size long, fp long, bands array<long>")


def _similar_links(docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges a, b between keys that connect what all similar pairs connect."""
    listed = classes.select("key", F.posexplode("bands").alias("k", "v"))
    hubs = listed.groupBy("k", "v").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    banded = listed.join(hubs, ["k", "v"]).where("key <> b").select(F.col("key").alias("a"), "b")
    # Linked fingerprints are nodes beside their texts; texts of one fingerprint meet there too.
    fps = checkpointed(classes.groupBy("fp").agg(F.count("*").alias("n")))
    near = checkpointed(links(fps, RADIUS))
    met = fps.where("n > 1").select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    owned = classes.select("key", "fp").join(broadcast_if_small(met), "fp").select(F.col("key").alias("a"), F.col("fp").alias("b"))
    clusters = checkpointed(connected_components(banded.unionByName(owned).unionByName(near).distinct()))
    members = classes.select("key", "size").join(clusters, F.col("key") == F.col("node")).select("key", "root", "size")
    parts = members.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(PART)).cast("int").alias("parts"))
    members = checkpointed(members.join(parts, "root").select("key", "root", "parts", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            sets = [shingle_set(t or "", words) for t in b.column("text").to_pylist()]
            rest = {c: b.column(c) for c in ("key", "root", "parts", "part")}
            yield pa.RecordBatch.from_arrays([*rest.values(), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*rest, "shingles"])

    texts = docs.select(text_key().alias("key"), "text").join(broadcast_if_small(members), "key").dropDuplicates(["key"])
    rows = texts.select("key", "root", "parts", "part", "text").mapInArrow(hashed, "key long, root long, parts int, part int, shingles binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "key", "shingles")

    def compared(group: pa.Table) -> pa.Table:
        keys, sets = group.column("key").to_pylist(), [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        pairs = linked_pairs(np.array([np.concatenate([bands(s), positional(majority(s))]) for s in sets]), sets, similarity) if len(keys) > 1 else []
        return pa.table({"a": pa.array([keys[x] for x, _ in pairs], pa.int64()), "b": pa.array([keys[y] for _, y in pairs], pa.int64())})

    return rows.groupBy("root", "i", "j").applyInArrow(compared, "a long, b long")


def one_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay when one row is kept of every component of texts that are linked at
    this similarity."""
    rows = checkpointed(_banded(docs, words))
    classes = checkpointed(rows.groupBy("key").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    nodes = checkpointed(connected_components(_similar_links(docs, classes, words, similarity)))
    ids = rows.select("key", "id").join(broadcast_if_small(nodes), F.col("key") == F.col("node"), "left")
    return first_of_each(docs, ids.select("key", "id", F.coalesce("root", "key").alias("root")))
