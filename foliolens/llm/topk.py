"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Vectors become integers, floor(scale * x). For each component, and each direction, the candidates of a block form a list
sorted by value. Lists are only read in order, a stretch of each in turn; of a candidate that some lists have not shown
yet, the score is bounded from below by the ends of those lists and from above by the values they have come to. For a
query, component c is the ascending or the descending list by the sign of its own value there, weighted by the absolute
value. A query stops reading when no candidate outside can qualify: the k-th best lower bound is above every other
candidate's upper bound. Candidates that still can are resolved from their lists, and the k best scores are returned,
ties to the smaller vec_id.

All queries of a block read together: bounds are products of the queries' weights with the matrix of values read, so a
look at the bounds is two matrix products. Where looking pays is found out for each block: a few ``PROBES`` look at every
depth of ``DEPTHS``, from a small part of the lists on, and the other queries look where a probe could stop. Queries and
candidates are dealt into blocks of bounded size; every pair of blocks is a task of its own (``cogroup``), its k best per
query are merged by a second top-k. Nothing is broadcast or collected, and vectors travel as they are stored. A candidate
is sent once for each ``QUERY_ROWS`` queries, and its block's lists are sorted as often.

Scores are exact: bounds are computed in the narrowest floating type that holds every possible score as an integer; where
none does, bounds are widened by what rounding can do to them, and the scores themselves are whole numbers of any size.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null
vec_id; an empty vector takes part, with score 0 to all; vectors of unequal length count as padded with zeros; rows that
share the query's vec_id are its own and are not candidates, and a repeated query gives one result, that of the vector
first in order; repeated candidates count one by one, ties among them in no particular order; scores beyond a long
count as the long next to them; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, CANDIDATE_ROWS = 32768, 16384
DEPTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 0.7, 0.8, 0.9)  #: shares of each list after which the bounds can be compared
PROBES = 8
LONG = (1 << 63) - 1
SCHEMA = "query_id long, vec_id long, score long"


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, v (as stored) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))


def integers(rows: pd.Series, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, a row for each vector."""
    if len(rows) and all(len(r) == width for r in rows):
        return np.floor(np.stack(rows.to_list()).astype(np.float64) * scale)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = np.floor(np.asarray(r, np.float64) * scale)
    return out


class SortedLists:
    """For each component the candidates in descending order of value, and in ascending order with values negated:
    2 * width lists of which each is read from its start. ``stops`` yields, for each depth in turn, how far every list is
    read and the matrices from which bounds are made: values read so far, filled up with the ends of the lists (lower)
    or with the values they have come to (upper)."""

    def __init__(self, x: np.ndarray, kind: type):
        self.own = np.concatenate([x.T, -x.T]).astype(kind)
        self.order = np.argsort(-self.own, axis=1)
        self.last = np.take_along_axis(self.own, self.order[:, -1:], axis=1)

    def stops(self, depths: Sequence[float], k: int):
        n = self.own.shape[1]
        seen, at = np.zeros(self.own.shape, bool), 0
        for depth in depths:
            to = min(n, max(k + 1, int(depth * n)))
            if to > at:
                np.put_along_axis(seen, self.order[:, at:to], True, axis=1)
                reached = np.take_along_axis(self.own, self.order[:, to - 1 : to], axis=1)
                yield depth, to, np.where(seen, self.own, self.last), np.where(seen, self.own, reached)
                at = to


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _scores(x: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Inner products; Python's own numbers where 64 bits may not hold them, cut to the range of a long."""
    if small:
        return x.astype(np.int64) @ query.astype(np.int64)
    q = list(map(int, query.tolist()))
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, q, strict=True)), -LONG), LONG) for r in x.tolist()], np.int64)


def search(lists: SortedLists, stops, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, rows: int = 256) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], dict[float, int]]:
    """(query positions, candidate positions, scores) of each query's k best candidates with another id (all, if fewer), and
    how many queries stopped at each depth."""
    n, kind = len(x), lists.own.dtype
    most = np.abs(queries) @ np.abs(x).max(axis=0) if n else np.zeros(len(queries))
    exact, small = most.max(initial=0) < 1 << 53, most.max(initial=0) < 1 << 62
    slack = np.zeros(len(queries)) if exact else most * (4 * queries.shape[1] + 8) * np.finfo(np.float64).eps
    open_rows = np.arange(len(queries))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stopped: dict[float, int] = {}
    for depth, at, lower, upper in stops:
        left = []
        for part in np.split(open_rows, range(rows, len(open_rows), rows)):
            weights = np.concatenate([np.maximum(queries[part], 0), np.maximum(-queries[part], 0)], axis=1).astype(kind)
            high = weights @ upper + slack[part, None].astype(kind)
            low = (weights @ lower if at < n else high) - slack[part, None].astype(kind) * (1 if at < n else 2)
            own_row, own_column = np.nonzero(query_ids[part, None] == ids[None, :])
            low[own_row, own_column], high[own_row, own_column] = -np.inf, -np.inf
            able = (high >= _kth(low, min(k, n))[:, None]) & (high > -np.inf)
            # A query is done when so few can qualify that resolving them costs less than reading on; at the end all lists are read.
            done = (able.sum(axis=1) <= max(4 * k, n // 64)) | (at == n)
            for i in np.nonzero(done)[0]:
                c = np.nonzero(able[i])[0]
                s = high[i, c].astype(np.int64) if at == n and exact else _scores(x[c], queries[part[i]], small)
                best = np.lexsort((ids[c], -s))[:k]
                out.append((np.full(len(best), part[i]), c[best], s[best]))
            stopped[depth] = stopped.get(depth, 0) + int(done.sum())
            left.append(part[~done])
        open_rows = np.concatenate(left)
        if not len(open_rows):
            break
    return out, stopped


def search_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for all queries of a block; the lists are sorted once."""
    most = float((np.abs(queries) @ np.abs(x).max(axis=0)).max(initial=0))
    lists = SortedLists(x, np.float32 if most < 1 << 24 else np.float64)
    _, seen = search(lists, lists.stops((*DEPTHS, 1.0), k), queries[:PROBES], query_ids[:PROBES], x, ids, k)
    parts, _ = search(lists, lists.stops(sorted({d for d, n in seen.items() if n} | {1.0}), k), queries, query_ids, x, ids, k)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query row of vectors(vec_id, embedding)."""
    rows = taking_part(vectors)
    chosen = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates, asked = -(-rows.count() // candidate_rows), -(-chosen.count() // query_rows)

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, count))).cast("int")

    def everywhere(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(0, count - 1))))

    left = chosen.select(block(asked).alias("q"), everywhere(candidates).alias("c"), "vec_id", "v")
    right = rows.select(everywhere(asked).alias("q"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, candidates))).cast("int").alias("c"), "vec_id", "v")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(a["v"].map(len).max(), b["v"].map(len).max(), 1)
        ids, asked_ids = b["vec_id"].to_numpy(), a["vec_id"].to_numpy()
        q, c, s = search_block(integers(a["v"], width, scale), asked_ids, integers(b["v"], width, scale), ids, k)
        return pd.DataFrame({"query_id": asked_ids[q], "vec_id": ids[c], "score": s})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(best, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
