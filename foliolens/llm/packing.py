"""Cost-balanced packing of documents into fixed-length training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (projections and attention within the piece). In
groups of up to ``GROUP_TOKENS`` tokens, full sequences are cut off long documents first; what remains of each document
is assigned in descending order to the sequence of the lowest cost that has room for all of it. A group has exactly as
many sequences as its tokens need, so a remainder for which no single sequence has room is cut over the cheapest ones
with room left: less than one sequence of padding is left in a group.

Groups are made inside each task from the rows it reads, so nothing is shuffled and memory is bounded by a group and
the longest document. Sequence ids are (partition << 32) + number, so a task that runs again gives the same ids.

Defined results: a null or empty text is one token (the end token); a very long text is cut over as many sequences as it
needs; every row of docs is packed on its own, repeated rows and rows of equal or null doc_id included; ties in length keep
the order of rows, ties in cost go to the first sequence; the string of the special token inside a text is that token, as the library's default
has it; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliolens.llm.common import portions, single_threaded, texts
from foliolens.llm.token_counts import BYTE_LETTERS, UNCOMMON

GROUP_TOKENS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The split of byte-level BPE.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them for a byte-level BPE file, without added special tokens.

    Where each merge of the file makes the token of the next id, ranks and merges order the same steps, and common texts
    are encoded from the ranks, which is several times faster; texts with a special token's string or with characters on
    whose class libraries may differ, and files of another kind, go through the library itself.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"]
        byte_of = {chr(v): k for k, v in BYTE_LETTERS.items()}
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = file["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not model["end_of_word_suffix"] and not model["ignore_merges"]
        if not plain or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocabulary.items()}
        return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special) or not text.isascii() and UNCOMMON.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.ranked.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def balanced(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for items of 1 to capacity - 1 tokens, by the rule of the module."""
    count = -(-sum(lengths) // capacity)
    used, cost = np.zeros(count, np.int64), np.zeros(count)
    out = []

    def put(item: int, start: int, n: int, s: int) -> None:
        out.append((item, start, n, s, int(used[s])))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n, start = lengths[item], 0
        room = used + n <= capacity
        if room.any():
            put(item, 0, n, int(np.where(room, cost, np.inf).argmin()))
            continue
        while n:
            s = int(np.where(used < capacity, cost, np.inf).argmin())
            part = min(n, capacity - int(used[s]))
            put(item, start, part, s)
            start, n = start + part, n - part
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece of every row of docs(doc_id, text)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        base, made = TaskContext.get().partitionId() << 32, 0
        group: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, tokens
            rows: list[tuple] = []
            rest = []
            for k, (doc, ids) in enumerate(group):
                whole = len(ids) // capacity
                for j in range(whole):
                    rows.append((doc, j * capacity, capacity, zlib.crc32(ids[j * capacity : (j + 1) * capacity]), len(ids), base + made, 0))
                    made += 1
                if len(ids) > whole * capacity:
                    rest.append((k, whole * capacity))
            sequences = 0
            for item, start, n, s, offset in balanced([len(group[k][1]) - at for k, at in rest], capacity, linear, quadratic):
                k, at = rest[item]
                doc, ids = group[k]
                rows.append((doc, at + start, n, zlib.crc32(ids[at + start : at + start + n]), len(ids), base + made + s, offset))
                sequences = max(sequences, s + 1)
            made += sequences
            group.clear()
            tokens = 0
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in portions(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                group.append((doc, ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield flush()
        if group:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)
