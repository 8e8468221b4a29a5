"""Pairs of 64-bit fingerprints within a Hamming radius, without comparing all pairs.

Every fingerprint is listed under several keys such that any two within the radius share at least one key; only
fingerprints of one list are compared. Two families of keys are offered:

* ``byte_keys``: an inverted index on byte positions. Two fingerprints that differ in at most r bits differ in at most r
  of the 8 bytes, so they share at least 8 - r positional bytes. The lists are kept for groups of positions, so chosen
  that any 8 - r positions hold one of the groups; short lists, and still no pair of the required count is missed.
* ``block_keys``: permuted block tables. The 64 bits are cut into blocks, of which at least a given number agree; a table
  for each choice of that many blocks.

The keys get longer as the number of fingerprints grows (``width``), so lists stay short at every size; each width
finds every pair. A list that is longer than ``LIST_ROWS`` all the same is cut into parts by a hash, and each pair of
parts is compared in a task of its own, so no list has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import popcount

LIST_ROWS = 16384
Keys = list[tuple[tuple[int, int], ...]]  #: each key is a choice of (first bit, number of bits)


def byte_keys(radius: int, n: int) -> tuple[Keys, int]:
    """Keys on positional bytes and the guaranteed number of shared ones, for a radius of at most 4."""
    if not 0 <= radius <= 4:
        raise ValueError("positional bytes are selective for a radius of 0 to 4")
    least = 8 - radius
    if n <= 1 << 24 and least == 4:
        # Any four of eight positions, in groups of 3, 3 and 2 on a ring, hold three within a group or two and one of the next.
        ring = ((0, 1, 2), (3, 4, 5), (6, 7))
        chosen = [g for g in ring if len(g) == 3]
        chosen += [(*two, one) for i in range(3) for two in combinations(ring[i], 2) for one in ring[(i + 1) % 3]]
    else:
        chosen = list(combinations(range(8), 4)) if least == 4 else [tuple(range(i, i + 3)) for i in (0, 3, 5)] if least >= 7 else list(combinations(range(8), min(least, 4)))
    return [tuple((8 * p, 8) for p in sorted(c)) for c in chosen], least


def block_keys(radius: int, n: int) -> Keys:
    """Keys on choices of blocks: with radius + k blocks, k of them agree. k is 3, or 4 and more for very many fingerprints."""
    agree = 3 if n <= 1 << 32 else 4
    blocks = radius + agree
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [tuple((bounds[b], bounds[b + 1] - bounds[b]) for b in c) for c in combinations(range(blocks), agree)]


def _key(fp: Column, key: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(0).cast("long")
    for at, bits in key:
        out = F.shiftleft(out, bits).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def _lists(fps: DataFrame, keys: Keys, extra: list[str]) -> DataFrame:
    """Lists (key number, key value, parts) with at least two fingerprints: rows k, v, i, j, part, members."""
    listed = fps.select("fp", *extra, F.posexplode(F.array(*[_key(F.col("fp"), k) for k in keys])).alias("k", "v"))
    sizes = listed.groupBy("k", "v").agg(F.count("*").alias("rows")).where("rows > 1")
    rows = listed.join(sizes, ["k", "v"])
    parts = F.ceil(F.col("rows") / F.lit(LIST_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    rows = rows.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    member = F.struct("fp", "part", *extra)
    grouped = rows.groupBy("k", "v", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return grouped.agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)


def _blocks(fp: np.ndarray, rows: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(fp), rows):
        yield at, fp[at : at + rows, None] ^ fp[None, :]


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each word are zero: the tally of positional bytes that a pair shares."""
    out = np.zeros(x.shape, np.uint8)
    for s in range(0, 64, 8):
        out += (x >> np.uint64(s)).astype(np.uint8) == 0
    return out


def spanning_links(fp: np.ndarray, radius: int, least_bytes: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links of the list connect: pairs with enough shared bytes, verified bit by bit."""
    parent = np.arange(len(fp))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for at, x in _blocks(fp, max(1, min(1024, (1 << 22) // len(fp)))):
        rows, cols = np.nonzero(_shared_bytes(x) >= least_bytes)
        rows += at
        near = (rows < cols) & (popcount(fp[rows] ^ fp[cols]) <= radius)
        for a, b in zip(rows[near].tolist(), cols[near].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose connected components are those of all pairs within the radius.

    Within a list only a spanning forest of its links is returned, so a large group of near copies gives as many rows
    as it has members, never all of its pairs.
    """
    keys, least = byte_keys(radius, fps.count())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for own in b.column("fps").to_pylist():
                if len(own) == 2:
                    x = (own[0] ^ own[1]) & 0xFFFFFFFFFFFFFFFF
                    if sum(not x >> s & 255 for s in range(0, 64, 8)) >= least and x.bit_count() <= radius:
                        a.append(own[0])
                        c.append(own[1])
                    continue
                fp = np.array(own, np.int64)
                for i, j in spanning_links(fp.view(np.uint64), radius, least):
                    a.append(own[i])
                    c.append(own[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    lists = _lists(fps.select("fp"), keys, []).select(F.col("members.fp").alias("fps"))
    return lists.mapInArrow(found, "a long, b long").distinct()


def neighbour_counts(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fp, n: for each distinct fingerprint of fps(fp, n), the sum of n over the other fingerprints within the radius.

    A pair is counted in the first table in which it agrees, so tables need no removal of duplicates and pairs are never
    written out. Fingerprints without neighbours have no row.
    """
    keys = block_keys(radius, fps.count())
    masks = np.array([sum(((1 << bits) - 1) << at for at, bits in k) for k in keys], np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[int, int] = {}
            for k, i, j, members in zip(*(b.column(c).to_pylist() for c in ("k", "i", "j", "members")), strict=True):
                own = [m["fp"] for m in members]
                fp, n, part = np.array(own, np.int64).view(np.uint64), np.array([m["n"] for m in members], np.int64), np.array([m["part"] for m in members])
                for at, x in _blocks(fp, max(1, min(1024, (1 << 22) // len(fp)))):
                    rows, cols = np.nonzero(popcount(x) <= radius)
                    rows += at
                    keep = (rows != cols) & ((part[rows] != part[cols]) if i != j else True)
                    rows, cols = rows[keep], cols[keep]
                    d = fp[rows] ^ fp[cols]
                    first = np.ones(len(d), bool)
                    for m in masks[:k]:
                        first &= (d & m) != 0
                    sums = np.bincount(rows[first], weights=n[cols[first]], minlength=len(fp)) if first.any() else ()
                    for r in np.nonzero(sums)[0].tolist():
                        total[own[r]] = total.get(own[r], 0) + int(sums[r])
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["fp", "n"])

    lists = _lists(fps.select("fp", "n"), keys, ["n"]).select("k", "i", "j", "members")
    return lists.mapInArrow(counted, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
