import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from foliolens.llm import packing, token_counts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["a<|endoftext|>b  c<|startoftext|>", "İstanbul ΣΑΣ ß ﬁ  x\x1cy\x85 １２ 你好!!'s", "\n\n\n foo  bar\t\n", "x" * 5000, "don't WE'LL he's 'S", "é İ Ͱ", "a²b ½ \xa0c\xad", "👍🏽 é"]


def test_counts_match_the_library(spark, docs, empty, corpus):
    t = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, token_counts.count_tokens(docs, WORD, limit=100, table_rows=50).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 100) for r in corpus]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, WORD).count() == 0
    counter = token_counts.PieceCounter(WORD)
    for s in ODD:
        assert counter.count(s) == len(t.encode(s, add_special_tokens=False).ids)


def test_common_characters_have_the_same_classes():
    """Each character that skips the library's own steps gives what the library gives."""
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    counter, encoder = token_counts.PieceCounter(WORD), packing.Encoder(BYTE)
    for c in map(chr, range(0x3000)):
        if not token_counts.UNCOMMON.search(c):
            s = f"a{c}b {c}{c} 1{c}'s"
            assert counter.count(s) == len(word.encode(s, add_special_tokens=False).ids)
            assert encoder.encode(s).tolist() == byte.encode(s, add_special_tokens=False).ids


def test_common_characters_next_to_each_other():
    """Each character that skips the library's own steps, beside letters, digits and marks; units and names with the micro sign."""
    word, counter = Tokenizer.from_file(WORD), token_counts.PieceCounter(WORD)
    common = [c for c in map(chr, range(0x3000)) if not token_counts.UNCOMMON.search(c)]
    beside = ["a", "\u00e9", "5", " ", "\u00b7", "!", "'", "\u00ab", "\u2026"]
    odd = ["5 N\u00b7\u00b5m", "kg\u00b7\u00b5s", "cm\u00b7\u00b5g", "\u00ab\u00b5Torrent\u00bb"]
    for s in [*odd, *(f"{x}{c}{y}m" for c in [*common, "\u00b5"] for x in beside for y in beside)]:
        assert counter.count(s) == len(word.encode(s, add_special_tokens=False).ids), s


def test_packing_round_trip(spark, docs, empty, corpus):
    t = Tokenizer.from_file(BYTE)
    pieces = packing.pack(docs, BYTE, capacity=256, group_tokens=5000).collect()
    left = defaultdict(list)
    for r in corpus:
        left[r[0]].append(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    expected = {(d, x, len(i)) for d, texts in left.items() for i in texts for x in [zlib.crc32(i)]}
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
        assert any(zlib.crc32(i[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] and len(i) == p["doc_tokens"] for i in left[p["doc_id"]])
    for d, own in by_doc.items():
        assert sum(p["length"] for p in own) == sum(map(len, left[d]))
    for s in by_sequence.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    padding = sum(256 - sum(n for _, n in s) for s in by_sequence.values())
    assert padding < 256 * 10 and expected
    assert packing.pack(empty, BYTE).count() == 0


def test_balancing_rule():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.randint(1, 99) for _ in range(r.randint(1, 60))]
        out = packing.balanced(lengths, 100, 1.0, 0.01)
        placed, used = defaultdict(list), defaultdict(int)
        for item, start, n, s, offset in out:
            placed[item].append((start, n))
            assert offset == used[s]
            used[s] += n
        assert max(used.values()) <= 100 and len(used) <= -(-sum(lengths) // 100)
        for i, n in enumerate(lengths):
            assert sorted(placed[i])[0][0] == 0 and sum(m for _, m in placed[i]) == n
    assert packing.balanced([50, 40, 30, 20], 100, 1.0, 0.0)[:4] == [(0, 0, 50, 0, 0), (1, 0, 40, 1, 0), (2, 0, 30, 1, 40), (3, 0, 20, 0, 50)]
    encoder = packing.Encoder(BYTE)
    t = Tokenizer.from_file(BYTE)
    for s in ODD:
        assert encoder.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids
