"""Removal of repeated 50-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Sorting every suffix of
a corpus would move some fifty times the corpus; what has to be sorted is found first, in the manner of distributed
prefix doubling:

1. Documents are dealt into runs of about ``RUN_BYTES`` by a hash of doc_id and text. Each window of 50 bytes has an anchor, the
   26 bytes within it of the smallest hash (leftmost on ties), so equal windows have equal anchors at equal places. Runs
   send the sorted hashes of their anchors, as differences, to the owners of hash ranges, who answer which anchors occur
   in several documents. A window whose anchor does not is unique and is done with.
2. For the other anchors each run makes its suffixes: from the anchor to the end of the last window that has it as its
   anchor, then what lies before the anchor back to the first such window. Each run's distinct suffixes are sorted,
   front-coded and exchanged by anchor with the smallest doc_id of each. The owner merges the runs with a loser tree
   that takes over known common prefixes; suffixes of one anchor come out together, and for each window of each of them
   the smallest doc_id is found and returned to the runs.
3. Each run marks the windows for which that doc_id is smaller than the document's own, and cuts their bytes out.

An anchor that occurs in more than ``HOT_DOCS`` documents may have as many contexts; its windows are exchanged one by one,
dealt out by their own content, so no owner gets all of a very frequent line. Repeats within a run cost one suffix.

There are as many owners as runs, so what an owner receives does not grow with the corpus: on average what a run sends, at
most about 1.7 times ``RUN_BYTES`` compressed. A run sends nothing to owners that it has no anchor for, so messages grow in
proportion to the corpus; as it grows they get smaller, and ``run_bytes`` should be raised with the memory there is.

The places of a run's suffixes travel with them, so step 3 needs no anchors. Texts are shuffled once, by run, and that
exchange is used by all three steps; nothing is broadcast or collected.

Defined results: a null text is empty; texts under 50 bytes are kept; rows of equal doc_id neither remove from each
other nor count as smaller, so repeated rows and ties lose the same bytes; a row with a null doc_id is kept whole, removes
nothing and is not shuffled; very long texts are one document of one run; an empty table gives an empty table; other
columns are ignored. Removal works on bytes, so ``kept`` may begin or end within a character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.merge_sort import LoserTree, front_code, front_decode

WINDOW, ANCHOR = 50, 26
REACH = WINDOW - ANCHOR + 1  #: places of the anchor in a window
RUN_BYTES = 4 << 20
HOT_DOCS = 256
CHUNK = 1 << 17  #: bytes whose hashes are held at a time, so that they stay in the cache
CUT = b"\xff"  #: between the two parts of a suffix; no byte of UTF-8
ROWS = "run int, owner int, kind int, body binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), n, 1 << 64))


def _anchors(buf: np.ndarray) -> np.ndarray:
    """For each window start, (48-bit hash of the anchor) << 8 | its place in the window."""
    h1 = _BYTES[buf]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    n = len(buf) - ANCHOR + 1
    h = (h16[:n] * _power(8) + h8[16 : 16 + n]) * _power(2) + h2[24 : 24 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    m = (h >> np.uint64(16)) << np.uint64(8)
    for step in (1, 2, 4, 8, REACH - 16):
        m = np.minimum(m[:-step], m[step:] + np.uint64(step))
    return m


def _spread(h: np.ndarray) -> np.ndarray:
    """48-bit hashes one to one onto others: the smallest of a window are small, and owners have even shares of the range."""
    mask = np.uint64((1 << 48) - 1)
    h = (h * np.uint64(0x9E3779B97F4B)) & mask
    return ((h ^ (h >> np.uint64(23))) * np.uint64(0xC2B2AE3D27D5)) & mask


class Texts:
    """The documents of a run in order, and their bytes one behind the other."""

    def __init__(self, table: pa.Table):
        # A shuffle brings the rows of a run in any order; every step has to see the same one.
        rows = sorted(zip(table.column("doc_id").to_pylist(), (t or b"" for t in table.column("text").to_pylist()), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids, self.texts = [d for d, _ in rows], [t for _, t in rows]
        self.buf = b"".join(self.texts)
        self.starts = [0, *np.cumsum([len(t) for t in self.texts])[:-1].tolist()]

    def document(self, places: np.ndarray | list[int]) -> np.ndarray:
        """Index of the document at each place of the bytes."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def numbers(self) -> np.ndarray:
        """The doc_id of each document; 0 where there is none, as no suffix is from there."""
        return np.array([0 if d is None else d for d in self.ids], "<i8")


class Run(Texts):
    """The anchors of the documents of a run: arrays first and last (window starts), at (anchor), hash, doc (index)."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        own = {d: i for i, d in enumerate(sorted({d for d in self.ids if d is not None}))}
        parts, at = [], 0
        whole = np.frombuffer(self.buf, np.uint8)
        doc = np.repeat(np.arange(len(self.texts)), [max(0, len(t) - WINDOW + 1) if d is not None else 0 for d, t in zip(self.ids, self.texts, strict=True)])
        windows = np.concatenate([np.arange(s, s + max(0, len(t) - WINDOW + 1)) if d is not None else np.empty(0, np.int64) for s, d, t in zip(self.starts, self.ids, self.texts, strict=True)] or [np.empty(0, np.int64)])
        while at < len(windows):
            to = int(np.searchsorted(windows, windows[at] + CHUNK))
            low = int(windows[at])
            p, d = windows[at:to], doc[at:to]
            m = _anchors(whole[low : int(p[-1]) + WINDOW])[p - low]
            a = p + (m & np.uint64(255)).astype(np.int64)
            edge = np.nonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1]))[0]
            first, last = np.append(0, edge + 1), np.append(edge, len(p) - 1)
            parts.append((p[first], p[last], a[first], _spread(m[first] >> np.uint64(8)), d[first]))
            at = to
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.int64)
        self.first, self.last, self.at, self.hash, self.doc = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, k) for k in kinds)
        self.number = np.array([own.get(d, -1) for d in self.ids], np.int64)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes, and in how many documents of the run each occurs."""
        d = self.number[self.doc]
        order = np.lexsort((d, self.hash))
        h, d = self.hash[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= d[1:] != d[:-1]
        at = np.nonzero(new)[0]
        return h[at], np.add.reduceat(other, at) if len(at) else np.empty(0, np.int64)

    def suffixes(self, shared: np.ndarray, flags: np.ndarray, owners: int) -> Iterator[tuple[int, bytes, int]]:
        """(owner, suffix, first window) of each anchor that occurs in several documents."""
        if not len(shared):
            return
        place = np.minimum(np.searchsorted(shared, self.hash), len(shared) - 1)
        flag = np.where(shared[place] == self.hash, flags[place], 0)
        buf = self.buf
        for i in np.nonzero(flag)[0]:
            s, e, a = int(self.first[i]), int(self.last[i]), int(self.at[i])
            if flag[i] == 1:
                yield int(self.hash[i]) % owners, buf[a : e + WINDOW] + CUT + buf[s:a], s
            else:
                for p in range(s, e + 1):
                    w = buf[p : p + WINDOW]
                    yield zlib.crc32(w) % owners, w, p


def _owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    return (h >> np.uint64(16)).astype(np.int64) * owners >> 32


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["run", "owner", "kind", "body"])


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(len(a).to_bytes(4, "little") + a.tobytes() for a in arrays), 1)


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(body), 0, []
    for k in kinds:
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(np.frombuffer(raw, k, n, at + 4))
        at += 4 + n * np.dtype(k).itemsize
    return out


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers byte by byte: the high bytes are mostly zero and pack to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def _unplanes(planes: np.ndarray, width: int) -> np.ndarray:
    n = len(planes) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _send_hashes(owners: int):
    def send(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        h, docs = Run(table).hashes()
        owner = _owner_of(h, owners)
        first = np.nonzero(np.diff(owner, prepend=-1))[0].tolist()
        return _rows([(run, int(owner[a]), 0, _pack(_planes(np.diff(h[a:b], prepend=np.uint64(0)), 6), np.minimum(docs[a:b], 255).astype(np.uint8))) for a, b in zip(first, [*first[1:], len(h)], strict=True)])

    return send


def _answer_hashes(hot_docs: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each run, 0, 1 or 2 for each of its hashes: in one document, in several, in very many."""
        owner = table.column("owner")[0].as_py()
        runs = table.column("run").to_pylist()
        got = [_unpack(b, "u1", "u1") for b in table.column("body").to_pylist()]
        hashes = [np.cumsum(_unplanes(p, 6), dtype=np.uint64) for p, _ in got]
        distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, np.concatenate([c for _, c in got]).astype(np.int64), len(distinct))
        flags = np.where(total > hot_docs, 2, total > 1).astype(np.uint8)[where]
        at, out = 0, []
        for run, h in zip(runs, hashes, strict=True):
            out.append((run, owner, 1, _pack(flags[at : at + len(h)])))
            at += len(h)
        return _rows(out)

    return answer


def _flags(run: Run, answers: pa.Table, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a run that occur in several documents, with their answers."""
    h, _ = run.hashes()
    flags, owner = np.zeros(len(h), np.uint8), _owner_of(h, owners)
    for o, body in zip(answers.column("owner").to_pylist(), answers.column("body").to_pylist(), strict=True):
        a, b = np.searchsorted(owner, [o, o + 1])
        flags[a:b] = _unpack(body, "u1")[0]
    return h[flags > 0], flags[flags > 0]


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _parts(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _send_suffixes(owners: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _rows([])
        number, run = docs.column("run")[0].as_py(), Run(docs)
        found: dict[int, dict[bytes, list[int]]] = {}
        for o, suffix, s in run.suffixes(*_flags(run, answers, owners), owners):
            found.setdefault(o, {}).setdefault(suffix, []).append(s)
        out = []
        for o, own in found.items():
            strings = sorted(own)
            # Documents are in order of doc_id, so the first place of a suffix is in the smallest.
            least = run.numbers()[run.document([min(own[s]) for s in strings])]
            # Where a run's suffixes stand travels with them and comes back with the answer.
            times, starts = np.array([len(own[s]) for s in strings]), np.array([p for s in strings for p in own[s]])
            at = _pack(_planes(times, 4), _planes(starts, 5))
            out.append((number, o, 2, _framed(front_code(strings), _pack(least), at)))
        return _rows(out)

    return send


def _windows(suffix: bytes) -> list[bytes]:
    """The windows of a suffix, by their starts in the text."""
    right, cut, left = suffix.partition(CUT)
    text = left + right
    return [text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1)] if cut else [suffix]


def _merge(table: pa.Table) -> pa.Table:
    """Merges the runs of an owner and answers, for each suffix of each run, the smallest document of each window."""
    owner = table.column("owner")[0].as_py()
    given = sorted(zip(table.column("run").to_pylist(), map(_parts, table.column("body").to_pylist()), strict=True), key=lambda r: r[0])
    runs = [r for r, _ in given]
    least = [iter(_unpack(p[1], "<i8")[0].tolist()) for _, p in given]
    tree = LoserTree([front_decode(p[0]) for _, p in given])
    counts: list[list[int]] = [[] for _ in runs]
    lengths: list[list[int]] = [[] for _ in runs]
    docs: list[list[int]] = [[] for _ in runs]
    group: list[tuple[bytes, int, list[int]]] = []  # suffix, smallest document, runs

    def close() -> None:
        if len(group) == 1:
            suffix, doc, of = group[0]
            n = len(suffix) - WINDOW + (CUT not in suffix)
            for w in of:
                counts[w].append(1)
                lengths[w].append(n)
                docs[w].append(doc)
            return
        cut = [(_windows(s), doc, of) for s, doc, of in group]
        first: dict[bytes, int] = {}
        for windows, doc, _ in cut:
            for x in windows:
                if first.setdefault(x, doc) > doc:
                    first[x] = doc
        for windows, _, of in cut:
            found = [first[x] for x in windows]
            edges = [i for i in range(1, len(found)) if found[i] != found[i - 1]]
            steps = [b - a for a, b in zip([0, *edges], [*edges, len(found)], strict=True)]
            values = [found[i] for i in (0, *edges)]
            for w in of:
                counts[w].append(len(steps))
                lengths[w].extend(steps)
                docs[w].extend(values)

    before = b""
    for shared, suffix, w in tree:
        doc = next(least[w])
        if group and shared == len(suffix) == len(before):
            s, d, of = group[-1]
            of.append(w)
            if doc < d:
                group[-1] = (s, doc, of)
            continue
        if group and shared < ANCHOR:
            close()
            group.clear()
        group.append((suffix, doc, [w]))
        before = suffix
    if group:
        close()
    answers = (_pack(np.array(counts[w], "u1"), np.array(lengths[w], "<u4"), np.array(docs[w], "<i8")) for w in range(len(runs)))
    return _rows([(run, owner, 3, _framed(answer, p[2])) for (run, p), answer in zip(given, answers, strict=True)])


def _mark(marks: np.ndarray, run: Texts, ids: np.ndarray, answer: bytes, places: bytes) -> None:
    """Marks the ends of the windows that a smaller document has. An answer gives each suffix as stretches of windows with
    one smallest document; each place of the suffix takes all of its stretches."""
    stretches, lengths, least = (x.astype(np.int64) for x in _unpack(answer, "u1", "<u4", "<i8"))
    times, starts = (_unplanes(x, width).astype(np.int64) for x, width in zip(_unpack(places, "u1", "u1"), (4, 5), strict=True))
    first = np.cumsum(stretches) - stretches
    before = np.cumsum(lengths) - lengths
    before -= np.repeat(before[first], stretches)
    suffix = np.repeat(np.arange(len(times)), times)
    each = stretches[suffix]
    place = np.repeat(np.arange(len(suffix)), each)
    stretch = np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each) + first[suffix[place]]
    hit = least[stretch] < ids[run.document(starts)][place]
    start = (starts[place] + before[stretch])[hit]
    np.add.at(marks, start, 1)
    np.add.at(marks, start + lengths[stretch][hit] - 1 + WINDOW, -1)


def _cut_out(docs: pa.Table, answers: pa.Table) -> pa.Table:
    run = Texts(docs)
    marks, ids = np.zeros(len(run.buf) + 1, np.int32), run.numbers()
    for body in answers.column("body").to_pylist():
        _mark(marks, run, ids, *_parts(body))
    gone = np.cumsum(marks[:-1]) > 0
    spans, kept = [], []
    for start, t in zip(run.starts, run.texts, strict=True):
        own_gone = gone[start : start + len(t)]
        if not own_gone.any():
            spans.append([])
            kept.append(t)
            continue
        edges = np.nonzero(np.diff(np.concatenate([[0], own_gone.view(np.int8), [0]])))[0].tolist()
        spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(np.frombuffer(t, np.uint8)[~own_gone].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(run.ids, pa.int64()), pa.array(map(len, run.texts), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_bytes, spans (the maximal removed runs of bytes) and kept (the bytes that stay) for every row of docs(doc_id, text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = owners = max(1, -(-total // run_bytes))
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs)).cast("int")
    text = F.col("text").cast("binary").alias("text")
    dealt = docs.where("doc_id is not null").select(number.alias("run"), F.col("doc_id").cast("long").alias("doc_id"), text)
    by_run = dealt.groupBy("run")
    flags = by_run.applyInArrow(_send_hashes(owners), ROWS).groupBy("owner").applyInArrow(_answer_hashes(hot_docs), ROWS)
    merged = by_run.cogroup(flags.groupBy("run")).applyInArrow(_send_suffixes(owners), ROWS).groupBy("owner").applyInArrow(_merge, ROWS)
    cut = by_run.cogroup(merged.groupBy("run")).applyInArrow(_cut_out, RESULT)
    kept = F.coalesce(F.col("text"), F.lit(b""))
    spans = F.array().cast("array<struct<start: bigint, end: bigint>>")
    whole = docs.where("doc_id is null").select(text).select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(kept).cast("long").alias("n_bytes"), spans.alias("spans"), kept.alias("kept"))
    return cut.unionByName(whole)
