import contextlib
import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from foliolens.llm import doc_fingerprints as P
from foliolens.llm import hamming, merge_sort, near_dedup, similar, suffix_dedup
from foliolens.llm.components import connected_components


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_match_brute_force(docs, empty, corpus):
    fps = [plain_fingerprint(r[1] or "") for r in corpus]
    root = roots(len(corpus), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {k: min((corpus[i][0] for i in range(len(corpus)) if root[i] == k and corpus[i][0] is not None), default=None) for k in set(root)}
    want = sorted(((r[0], f"{fps[i]:016x}", least[root[i]]) for i, r in enumerate(corpus)), key=str)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str) == want
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in near_dedup.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({v for v in least.values() if v is not None})
    assert near_dedup.one_of_each(docs).columns == docs.columns and near_dedup.one_of_each(empty).count() == 0


def test_every_component_keeps_one_row(spark):
    """Many rows without a doc_id, and one doc_id on unrelated texts of which one has a copy with a smaller doc_id."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, text(i)) for i in range(12) for _ in range(2)] + [(None, text(50)), (7, text(50)), (7, text(51)), (3, text(51)), (7, text(52)), (7, text(52)), (None, None), (None, "")]
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, text(i)) for i in range(12)] + [(7, text(50)), (3, text(51)), (7, text(52))]
    assert sorted(((d, t) for d, t in kept if t), key=str) == sorted(want, key=str) and len(kept) == len(want) + 1


@pytest.mark.parametrize("part", [similar.PART, 300])
def test_similar_texts_keep_one_row(spark, monkeypatch, docs, empty, corpus, part):
    """Texts with some words changed, against all pairs of five-word shingle sets; also in many parts."""
    monkeypatch.setattr(similar, "PART", part)
    r = random.Random(part)
    rows = [(x[0], x[1]) for x in corpus]
    for i in range(12):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
        for j in range(6):
            own = list(base)
            for at in r.sample(range(150), r.randint(0, 6)):
                own[at] = f"v{r.randint(0, 10**6)}"
            rows.append((1000 + 10 * i + j if j % 3 else None, " ".join(own)))
    sets = []
    for _, t in rows:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = roots(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    least = {k: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == k) for k in set(root)}
    kept = similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    place = {(d, t): i for i, (d, t) in enumerate(rows)}
    assert sorted(root[place[d, t]] for d, t in kept) == sorted(least)
    assert all((d is None, d or 0) == least[root[place[d, t]]] for d, t in kept)
    assert len(kept) > len(near_dedup.one_of_each(docs).collect()) and similar.one_of_similar(empty).count() == 0
    assert similar.one_of_similar(docs).columns == docs.columns


def test_pipeline_keeps_one_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60], "other", *words[61:120], "more", *words[121:]])), (3, " ".join(words[::-1]))]
    assert sorted(r[0] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == [1, 3]


def test_every_pair_shares_a_key():
    r = np.random.default_rng(0)
    for n in (10, 1 << 25):
        keys, least = hamming.byte_keys(4, n)
        blocks = hamming.block_keys(3, n)
        assert least == 4 and len(keys) == (20 if n == 10 else 70)
        for _ in range(2000):
            for family, bits in ((keys, 4), (blocks, 3)):
                d = sum(1 << int(b) for b in r.choice(64, bits, replace=False))
                assert any(all(not d >> at & (1 << width) - 1 for at, width in k) for k in family)


@pytest.mark.parametrize("rows", [hamming.LIST_ROWS, 7])
def test_links_and_neighbours_match_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(hamming, "LIST_ROWS", rows)
    r = random.Random(rows)
    fps = {0}
    for _ in range(25):
        x = r.getrandbits(64)
        fps |= {x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(r.randint(1, 12))}
    fps = sorted(fps)
    frame = spark.createDataFrame([(P.signed(x), i % 3 + 1) for i, x in enumerate(fps)], "fp long, n long")
    got = {(a % (1 << 64), b % (1 << 64)) for a, b in hamming.links(frame).collect()}
    place = {x: i for i, x in enumerate(fps)}
    pairs = {(place[a], place[b]) for a, b in got} | {(place[b], place[a]) for a, b in got}
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    assert roots(len(fps), lambda i, j: (i, j) in pairs) == roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    near = {x: sum(j % 3 + 1 for j, y in enumerate(fps) if y != x and (x ^ y).bit_count() <= 3) for x in fps}
    assert {k % (1 << 64): v for k, v in hamming.neighbour_counts(frame).collect()} == {k: v for k, v in near.items() if v}


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    linked = {(a, b) for e in edges for a, b in (e, e[::-1])}
    root = roots(len(nodes), lambda i, j: (nodes[i], nodes[j]) in linked)
    assert got == {n: nodes[root[i]] for i, n in enumerate(nodes)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_document_fingerprints(docs, empty, corpus, spark):
    rows = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is not None, r[0] or 0, P.signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))
    fps = [P.fingerprint(t) for _, t in rows]
    want = []
    for i, (d, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        e = t[: len(t) - len(t) // 4] + rows[j][1][: len(t) // 4]
        f = P.fingerprint(e)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{fps[i]:016x}", f"{f:016x}", 1 - (fps[i] ^ f).bit_count() / 64, 1 - (fps[i] ^ fps[j]).bit_count() / 64, sum((fps[i] ^ x).bit_count() <= 3 for x in fps) - 1))
    assert sorted(map(tuple, P.fingerprint_report(docs).collect()), key=str) == sorted(want, key=str)
    assert P.fingerprint_report(empty).count() == 0
    alone = P.fingerprint_report(docs.where("doc_id = 137")).first()
    assert alone["near_next"] == 1 and alone["n_near"] == 0


def test_document_fingerprints_leave_no_texts_on_disk(spark, monkeypatch):
    """The files that whole texts were exchanged through go without the help of the garbage collector, which spares what is held."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffled():
        out = {}
        for f in (f for d in folders for f in Path(d.getPath()).glob("*/shuffle_*.data")):
            with contextlib.suppress(FileNotFoundError):
                out[f] = f.stat().st_size
        return out

    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), x -> sha2(concat(id, ' ', x), 256))) AS text")
    held, checkpoint = [], type(docs).checkpoint
    monkeypatch.setattr(type(docs), "checkpoint", lambda df, eager=True: checkpoint(held.append(df) or df, eager))
    before, most = shuffled(), 300 * 200 * 64 // 10
    report = P.fingerprint_report(docs)
    for _ in range(20):  # files are removed in the background
        if (left := sum(n for f, n in shuffled().items() if f not in before)) < most:
            break
        time.sleep(0.2)
    assert held and left < most
    assert len(report.collect()) == len(report.collect()) == 300


def brute_removal(corpus):
    first = {}
    for d, t in sorted(((r[0], (r[1] or "").encode()) for r in corpus if r[0] is not None)):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    out = []
    for r in corpus:
        t, d = (r[1] or "").encode(), r[0]
        gone = bytearray(len(t))
        for p in range(len(t) - 49) if d is not None else ():
            if first[t[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        spans, start = [], None
        for i, g in enumerate([*gone, 0]):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((d, len(t), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("run_bytes", "hot"), [(1 << 22, 256), (3000, 3)])
def test_suffix_removal_matches_brute_force(docs, empty, corpus, run_bytes, hot):
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, run_bytes, hot).collect()]
    assert sorted(got, key=str) == sorted(brute_removal(corpus), key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_rows_without_or_with_one_id_are_spread(spark):
    """Null ids remove nothing; one doc_id on many texts does not remove from itself; both over many runs."""
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    text = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    rows = [(i, f"{text()} {passage}") for i in (None, 7) for _ in range(40)] + [(i, f"{passage} {text()}") for i in (3, 9)] + [(None, None), (9, None), (7, "é" * 60), (8, "é" * 60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2000, 5).collect()
    assert sorted(((x["doc_id"], x["n_bytes"], [tuple(s) for s in x["spans"]], bytes(x["kept"])) for x in got), key=str) == sorted(brute_removal(rows), key=str)


def test_long_texts_are_cut_alike(spark, monkeypatch):
    """Texts over the size of a chunk, in any order of arrival."""
    r = random.Random(8)
    base = bytes(r.choice(b"abcdefgh ") for _ in range(20000)).decode()
    rows = [(i, base[i * 100 : i * 100 + 9000]) for i in range(12)]
    want = {d: kept for d, _, _, kept in brute_removal([(d, t) for d, t in rows])}
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 30000).collect()}
    assert got == want


def test_loser_tree():
    r = random.Random(6)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 40))}) for _ in range(9)]
    got = list(merge_sort.LoserTree([merge_sort.front_decode(merge_sort.front_code(x)) for x in runs]))
    assert [s for _, s, _ in got] == sorted(s for x in runs for s in x)
    for (_, a, _), (h, b, _) in zip(got, got[1:], strict=False):
        assert h == merge_sort.shared_prefix(a, b)
    assert list(merge_sort.LoserTree([])) == [] and list(merge_sort.LoserTree([iter([(0, b"a")])])) == [(0, b"a", 0)]


def test_similar_texts_go_through_the_byte_position_index(spark, monkeypatch):
    """Texts that share no band are compared all the same if the index links their fingerprints."""
    r = random.Random(1)
    rows = []
    for i in range(6):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(1500)]
        rows += [(10 * i + j, " ".join([*base[: 300 * j], f"v{i}x{j}", *base[300 * j + 1 :]])) for j in range(4)]
    fps = {d: near_dedup.majority(similar.shingle_set(t)) for d, t in rows}
    linked = lambda i, j: (fps[rows[i][0]] ^ fps[rows[j][0]]).bit_count() <= similar.RADIUS
    root = roots(len(rows), linked)
    want = [rows[k][0] for k in sorted(set(root))]
    assert len(want) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {d for d, _ in similar.one_of_similar(docs).collect()} == {0, 10, 20, 30, 40, 50}
    unlike = lambda s: np.arange(similar.BANDS) + int(s[0] >> np.uint64(8))
    monkeypatch.setattr(similar, "bands", unlike)
    assert sorted(d for d, _ in similar.one_of_similar(docs).collect()) == want
