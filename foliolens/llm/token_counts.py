"""Token counts without token ids.

Pieces are counted once for each distinct pre-token; a document's count is the sum over its pre-token frequencies of
frequency times pieces. The table of distinct pre-tokens lives in each task and is filled as new pre-tokens turn up, so
the join of frequencies with piece counts is a map-side hash join: no row is shuffled, and the work is one pass over
the texts. (A global table of distinct pre-tokens would need a shuffle of every document's frequencies, which is larger
than the corpus.) The table is emptied when it reaches ``TABLE_ROWS`` entries, which bounds memory and changes no result.

Defined results: a null text counts as empty (0 bytes, 0 tokens); the strings of special tokens inside a text count as
one token each, as the library's default has it; very long texts are counted whole; repeated rows each give a row, equal
texts equal counts; a null doc_id stays null; other columns
are ignored; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.llm.common import portions, single_threaded, texts

TABLE_ROWS = 300_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Punctuation and symbols among the characters below.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac"
MARKS = re.escape(_MARKS[:32]) + _MARKS[32:]
#: Finds a character outside a set in which the standard library's classes and case mappings agree with the tokenizer's
#: (ASCII, Latin-1 and Latin Extended letters, common punctuation). Texts with such a character take the library's own steps.
UNCOMMON = re.compile(f"[^\t\n\r 0-9A-Za-z\u00a0\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01c4\u01c6-\u024f{MARKS}]")
#: The split of the vocabulary file, over lower-cased text of the set above.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[{MARKS}]+")


def _byte_table() -> dict[int, int]:
    """Byte -> the letter that byte-level vocabularies write for it: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


BYTE_LETTERS = _byte_table()


def byte_letters(token: str) -> str:
    """A pre-token without white space in the letters of byte-level vocabularies."""
    return token if token.isascii() else token.encode().decode("latin-1").translate(BYTE_LETTERS)


class PieceCounter:
    """Counts the tokens of texts for one tokenizer file of the ``tokenizers`` library (NFC, lower case, split, BPE)."""

    def __init__(self, path: str, table_rows: int = TABLE_ROWS):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = _WORDS.findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.table_rows = table_rows
        self.pieces: dict[str, int] = {}
        self.mapped: dict[str, int] = {}

    def count(self, text: str) -> int:
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            return sum(map(self._count, parts)) + len(parts) - 1
        return self._count(text)

    def _count(self, text: str) -> int:
        if not text:
            return 0
        if not text.isascii() and UNCOMMON.search(text):
            return self._count_uncommon(text)
        return self._join(Counter(self.find(text.lower())), self.pieces, byte_letters)

    def _count_uncommon(self, text: str) -> int:
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return self._join(Counter(w for w, _ in words), self.mapped, lambda t: t)

    def _join(self, frequencies: Counter, table: dict[str, int], spelled) -> int:
        if len(table) > self.table_rows:
            table.clear()
        for t in frequencies:
            if t not in table:
                table[t] = len(self.model.tokenize(spelled(t)))
        return sum(map(mul, frequencies.values(), map(table.__getitem__, frequencies)))


@lru_cache(maxsize=2)
def piece_counter(path: str, table_rows: int) -> PieceCounter:
    """One for each Python worker: its table outlives a task."""
    return PieceCounter(path, table_rows)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row of docs(doc_id, text)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer_path, table_rows)
        for b in portions(batches):
            rows = texts(b.column("text"))
            n = [counter.count(t) for t in rows]
            size = [len(t) if t.isascii() else len(t.encode()) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(counts, SCHEMA)
