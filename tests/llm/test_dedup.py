"""Exact and near copies against brute force, planted cases and edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quern.llm import exact_dedup as X
from quern.llm import simhash as S
from quern.llm.components import components
from quern.llm.textvec import Slice

EDGES = [(1, "same text", "a", "k"), (2, "same text", "b", "k"), (None, "same text", "c", "k"), (3, None, "d", "k"), (4, None, "e", "k"), (5, "", "f", "k"), (6, "", "g", "k"), (7, "x" * 300_000, "h", "k"), (8, "x" * 300_000, "i", "k"), (9, "x" * 299_999 + "y", "j", "k"), (10, "alone", "k", "k"), (10, "alone", "k", "k"), (11, "äöü", "l", "k"), (12, "äöü", "m", "k")]
COLUMNS = "doc_id long, text string, row string, first string"


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        b = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        want = tuple(sum(c * pow(base, n - 1 - i, p) for i, c in enumerate(b)) % p for base, p in zip(X.BASES, X.PRIMES)) if n < 1100 else X.fingerprint(b)
        assert X.fingerprint(b) == want
        for cut in (0, n // 3, n):
            assert X.combine(X.fingerprint(b[:cut]), X.fingerprint(b[cut:]), n - cut) == X.fingerprint(b)


def test_chunk_rows_combine(spark):
    text = "abc" * 5000
    parts = [text[:100], text[100:9000], text[9000:]]
    rows = [(1, i, len(p), *X.fingerprint(p.encode())) for i, p in enumerate(parts)]
    got = X.combine_chunks(spark.createDataFrame(rows[::-1], "doc_id long, chunk int, n_bytes long, f1 long, f2 long, f3 long")).first()
    assert tuple(got) == (1, len(text), *X.fingerprint(text.encode()))


def expected(rows):
    groups: dict = {}
    for i, t, *_ in rows:
        if t is not None:
            groups.setdefault(t, []).append(i)
    low = lambda g: min((i for i in g if i is not None), default=None)
    return sorted(((i, low(groups[t]), len(groups[t]), len(t.encode())) if t is not None else (i, i, 1, None) for i, t, *_ in rows), key=str)


def test_exact_duplicates_with_edges(spark, monkeypatch):
    docs = spark.createDataFrame(EDGES, COLUMNS)
    for split in (1 << 16, 2):  # groups in one part, and in several
        for huge in (1 << 20, 100_000, 4):  # texts hashed whole, and in chunk rows
            assert sorted(map(tuple, X.exact_duplicates(docs, 500_000, split, huge).collect()), key=str) == expected(EDGES)
    kept = X.drop_exact_duplicates(docs, 0)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 7, 9, 10, 11], key=str)
    assert X.exact_duplicates(docs.limit(0)).collect() == []


def test_texts_of_one_fingerprint_that_differ_stay_apart(spark):
    texts = {1: "aaaaabbbb", 2: "aaaaacccc", 3: "aaaaabbbb", 4: "aaaaabbbb", 5: "dddddbbbb", None: "aaaaacccc"}
    for split in (False, True):
        rows = [(k, i, 9, 1, 1, 1, k % 2 if split else 0, split, t) for k, (i, t) in enumerate(texts.items())]
        df = spark.createDataFrame(rows, "rid long, doc_id long, n_bytes long, f1 long, f2 long, f3 long, salt int, split boolean, text string")
        for size in (4, 5, 100):  # in three chunks, in two, in one
            got = {r["doc_id"]: (r["keep_id"], r["copies"], r["first"]) for r in X.classes(df, size).collect()}
            assert got == {1: (1, 3, True), 3: (1, 3, False), 4: (1, 3, False), 2: (2, 2, True), None: (2, 2, False), 5: (5, 1, True)}


def near_brute(texts: list[str], radius: int) -> list[int]:
    fp, has = S.simhashes(Slice(pa.array(texts)))
    bits = np.unpackbits(fp.view(np.uint8), axis=1).astype(np.int32)
    d = (bits[:, None] != bits[None]).sum(axis=2)
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if d[i, j] <= radius and has[i] and has[j] or i == j) for i in range(len(texts))]
    return root


def test_bit_sliced_comparison_equals_distances():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    fp = np.repeat(base, 5, axis=0)
    for i in range(len(fp)):
        for b in rng.choice(256, size=rng.integers(0, 70), replace=False):
            fp[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    sizes = np.array([1, 2, 70, 3, 124])
    bits = np.unpackbits(fp.view(np.uint8), axis=1).astype(np.int32)
    d = (bits[:, None] != bits[None]).sum(axis=2)
    bucket = np.repeat(np.arange(5), sizes)
    for radius in (0, 10, 48, 100):
        got = {(int(i), int(j)) for a, b in S.near_in_buckets(fp, sizes, radius) for i, j in zip(a, b)}
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if bucket[i] == bucket[j] and d[i, j] <= radius}
        assert got == want


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    root = near_brute([r["text"] for r in rows], S.RADIUS)
    ids = [r["doc_id"] for r in rows]
    got = {r["doc_id"]: r["keep_id"] for r in S.near_duplicates(docs).collect()}
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if root[i] == root[j]]
    assert len(got) == len(ids) and all(got[ids[i]] == got[ids[j]] for i, j in pairs)
    assert all(root[ids.index(k)] == root[ids.index(v)] for k, v in got.items())  # and none that isn't near
    kept = S.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs.columns


def test_near_edges(spark):
    docs = spark.createDataFrame(EDGES + [(20, "!!! ...", "l", "k")], COLUMNS)
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=str)
    assert (3, 3, 1) in got and (20, 20, 1) in got and (5, 5, 1) in got and (None, 1, 3) in got and (2, 1, 3) in got and got.count((10, 10, 2)) == 2
    kept = S.drop_near_duplicates(docs, broadcast_rows=0)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and None not in ids and ids.count(10) == 1 and 1 in ids and 2 not in ids
    assert S.near_duplicates(docs.limit(0)).collect() == [] and S.drop_near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_buckets_cut_in_parts_lose_nothing(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choice(words, 300, replace=False)
    texts = []
    for i in range(260):  # a family that fills buckets, and pairs beside it
        t = base.copy() if i < 200 else rng.choice(words, 300, replace=False) if i % 2 == 0 else t.copy()  # noqa: F821
        t[rng.integers(0, 300, 4)] = rng.choice(words, 4)
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = near_brute(texts, S.RADIUS)
    prints = S.with_simhashes(docs)
    assert S._hot(prints.select(S.F.col("doc_id").alias("node"), *S._FP), 8, 16, 64).count() > 0
    for hot in (64, 1 << 15):
        got = {tuple(r[c] for c in S._FP): r["root"] for r in S._groups(prints, S.RADIUS, S.RECALL, hot).collect()}
        same = {r["doc_id"]: got[tuple(r[c] for c in S._FP)] for r in prints.collect()}
        assert [same[i] for i in range(260)] == root


def test_pairs_across_parts_are_found(spark):
    fp = [(0, 0, 0, 0), (7, 0, 0, 0), (1 << 40, 0, 0, 0), (-1, -1, 0, 0), (-1, -1, 1, 0)]
    rows = [(5, p, 2, n, *f) for p, n, f in [(0, 1, fp[0]), (1, 2, fp[1]), (0, 3, fp[2]), (0, 4, fp[3]), (1, 5, fp[4])]]
    df = spark.createDataFrame(rows, "key long, part long, parts long, node long, p0 long, p1 long, p2 long, p3 long")
    roots = spark.createDataFrame([(1, 1), (3, 1)], "node long, root long")
    got = {tuple(sorted(r)) for r in S._across(df, roots, 48).collect()}
    assert got == {(1, 2), (2, 3), (4, 5)}


def test_tables_do_not_grow_up_to_a_hundred_million_fingerprints():
    assert len({S.plan(n) for n in (10, 10**5, 10**6, 10**7, 10**8)}) == 1
    tables, bits = S.plan(1000)
    rng = np.random.default_rng(9)
    chosen = S.sampled_bits(tables, bits)
    met = sum(any(not (set(c.tolist()) & off) for c in chosen) for off in (set(rng.choice(256, 48, replace=False).tolist()) for _ in range(2000)))
    assert met >= 0.985 * 2000


def test_long_and_tied_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    docs = spark.createDataFrame([(9, long), (4, long + " more"), (4, long + " more"), (7, "alpha beta"), (7, "gamma delta")], "doc_id long, text string")
    got = sorted(map(tuple, S.near_duplicates(docs).collect()))
    assert got.count((4, 4, 3)) == 2 and (9, 4, 3) in got and got.count((7, 7, 1)) == 2
