"""The registered queries and the stages of the pipeline over the smallest tables, each against a plain version of its contract."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from test_duplicates import brute_removal, plain_fingerprint, roots
from test_learned import plain_base, plain_languages, plain_mixture
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from foliolens.llm import pii
from foliolens.llm.doc_fingerprints import fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def answer(spark):
    """A function from a query's name to its columns and rows."""

    def run(name):
        df = entry.queries()[name](spark, SF)
        return df.columns, [tuple(r) for r in df.collect()]

    return run


def fold(d, modulus):
    return zlib.crc32(("" if d is None else str(d)).encode()) % modulus


def test_op1(answer, rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    columns, got = answer("op1_token_counts")
    assert columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for d, x, _, _ in rows]
    assert sorted(got) == sorted(want)


def test_op2(answer, rows):
    read = plain_languages([r[:3] for r in rows])
    columns, got = answer("op2_language_id")
    assert columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = sorted((d, fold(d, 3) == 1, *read(x)) for d, x, _, _ in rows)
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in want] and np.allclose([g[3] for g in sorted(got)], [w[3] for w in want])
    langs = {d: k for d, _, k, _ in rows}
    held = [langs[d] == k for d, out, k, _ in got if out and k != "und" and langs[d]]
    assert len(held) > 30 and np.mean(held) > 0.97


def test_op3(answer):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    columns, got = answer("op3_exact_topk")
    assert columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(got) == sorted(con.sql(entry.oracle_sql()["op3_exact_topk"]).fetchall())


def packed_exactly(pieces, texts):
    """Every id of every text lies in exactly one piece, where the piece says; sequences are gapless and full but for little."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = Counter()
    ids = defaultdict(list)
    for d, x in texts:
        ids[d].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    found, room = defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, sequence, offset in pieces:
        found[d].append((start, n, crc, total))
        room[sequence].append((offset, n))
    for d, own in ids.items():
        left = Counter(found.pop(d))
        for x in own:
            at = 0
            while at < len(x):
                piece = next(p for p in left if p[0] == at and p[3] == len(x) and p[2] == zlib.crc32(x[at : at + p[1]]))
                left -= Counter([piece])
                at += piece[1]
            assert at == len(x)
        assert not left, d
    assert not found and not wanted
    for own in room.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    return sum(2048 - sum(n for _, n in own) for own in room.values())


def test_op4(answer, rows):
    columns, got = answer("op4_packing")
    assert columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    padding = packed_exactly([g[:7] for g in got], [r[:2] for r in rows])
    assert padding < 2048 * 2 * len({g[5] >> 32 for g in got})


def test_op5(answer, rows):
    columns, got = answer("op5_mixing")
    want, weight = plain_mixture([(d, x, s) for d, x, _, s in rows])
    got = [dict(zip(columns, g, strict=True)) for g in got]
    assert Counter((g["doc_id"], g["source"], g["n_tokens"], g["pass"], g["block"]) for g in got) == Counter((d, s, n, p, b) for d, _, s, n, p, b in want)
    assert all(g["weight"] == pytest.approx(weight[g["source"]], abs=1e-8) for g in got)


def test_op6(answer, rows):
    columns, got = answer("op6_pii")
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    by_id = {g[0]: g for g in got}
    assert len(by_id) == len(rows) == len(got)
    for d, x, _, _ in rows:
        base = plain_base(x or "")
        assert by_id[d][1:6] == (*(sum(k == kind for k, _, _ in base) for kind in pii.KINDS[:4]), hashlib.sha256(pii.joined(base).encode()).hexdigest())
        assert {pii.joined([s]) for s in base} <= set(by_id[d][6].split(","))


def test_op7(answer, rows, spark):
    columns, got = answer("op7_quality")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert all(out == (fold(d, 5) == 0) and 0 <= s <= 1 and p == (s >= 0.3) for d, out, s, p in got)


def test_op8(answer, rows):
    columns, got = answer("op8_suffix_dedup")
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in brute_removal([r[:2] for r in rows])]
    assert sorted(got) == sorted(want)


def test_op9(answer, rows):
    columns, got = answer("op9_simhash_near_dedup")
    assert columns == ["doc_id", "fingerprint", "component_id"]
    fps = [plain_fingerprint(x or "") for _, x, _, _ in rows]
    root = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {k: min(r[0] for r, own in zip(rows, root, strict=True) if own == k) for k in set(root)}
    assert sorted(got) == sorted((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, root, strict=True))


def test_op10(answer, rows):
    columns, got = answer("op10_doc_fingerprints")
    assert columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    in_order = sorted((d, x or "") for d, x, _, _ in rows)
    want = []
    for (d, x), (_, y) in zip(in_order, [*in_order[1:], in_order[0]], strict=True):
        n = len(x) // 4
        e = x[: len(x) - n] + y[:n]
        a, b, c = fingerprint(x), fingerprint(e), fingerprint(y)
        want.append((d, len(x), hashlib.sha256(e.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    assert sorted(g[:7] for g in got) == want


def test_stages_match_plain_versions(spark, rows):
    """Each stage on the rows that the one before it kept, against its rule worked out one document at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name: [tuple(r) for r in stages[name](spark, docs, SF).collect()]
    columns = docs.columns
    at = {c: columns.index(c) for c in columns}
    given = [tuple(r) for r in docs.collect()]

    read = plain_languages([(r[at["doc_id"]], r[at["text"]], r[at["lang"]]) for r in given])
    kept = [r for r in given if read(r[at["text"]])[0] != "und" and read(r[at["text"]])[1] >= 0.5]
    assert Counter(step("language_id")) == Counter(kept) and kept

    docs = spark.createDataFrame(kept, docs.schema)
    sets = []
    for r in kept:
        words = "".join(c.lower() if c.isascii() else c for c in r[at["text"]]).encode().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = roots(len(kept), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    first = {k: min(r[at["doc_id"]] for r, own in zip(kept, root, strict=True) if own == k) for k in set(root)}
    got = step("near_duplicates")
    kept = [r for r, k in zip(kept, root, strict=True) if r[at["doc_id"]] == first[k]]
    assert Counter(got) == Counter(kept)

    docs = spark.createDataFrame(kept, docs.schema)
    trained, clean = pii.models(), []
    for r in kept:
        text = pii.redact(r[at["text"]], pii.find([r[at["text"]]], trained)[0][1])
        clean.append(tuple(text if c == "text" else len(text) if c == "n_chars" else v for c, v in zip(columns, r, strict=True)))
    assert Counter(step("personal_data")) == Counter(clean) and all(not plain_base(r[at["text"]]) for r in clean)

    docs = spark.createDataFrame(clean, docs.schema)
    want, _ = plain_mixture([(r[at["doc_id"]], r[at["text"]], r[at["source"]]) for r in clean], max_repeats=corpus_pipeline.MAX_REPEATS)
    by_key = {(r[at["doc_id"]], r[at["text"]], r[at["source"]]): r for r in clean}
    mixed = [by_key[d, t, s] for d, t, s, *_ in want]
    assert Counter(step("mixing_sources")) == Counter(mixed) and set(mixed) == set(clean)

    docs = spark.createDataFrame(mixed, docs.schema)
    packed_exactly([p[:7] for p in step("packing")], [(r[at["doc_id"]], r[at["text"]]) for r in mixed])
