"""Searches against brute force and the scenarios of a vector store."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.operators import clustering, knn, quantization, vector_dedup

POINTS = [(1, [0.0, 0, 0], "origin"), (2, [1.0, 0, 0], "x"), (3, [0.0, 1, 0], "y"), (4, [0.0, 0, 1], "z"), (5, [1.0, 1, 0], "xy"), (6, [1.0, 1, 1], "d"), (7, [2.0, 0, 0], "x"), (8, [3.0, 0, 0], "x")]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, [float(x) for x in v], {"type": t}) for i, v, t in POINTS], "id long, vector array<float>, metadata map<string,string>")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_range_and_limit(spark, points):
    v = points.select("id", "vector")
    origin, one = v.where("id = 1"), v.where("id = 2")
    assert ids(knn.range_search(origin, v, 1.0)) == [1, 2, 3, 4]
    assert ids(knn.range_search(origin, v, 1.5)) == [1, 2, 3, 4, 5]
    assert ids(knn.range_search(origin, v, 2.0)) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(knn.range_search(origin, points.where(knn.matches("metadata", {"type": "x"})).select("id", "vector"), 3.0)) == [2, 7, 8]
    assert ids(knn.range_search(one, v, 1.0)) == [1, 2, 5, 7]
    some = knn.range_limited(knn.range_search(origin, v, 3.0), 3).collect()
    assert [r["id"] for r in sorted(some, key=lambda r: r["rank"])] == [1, 2, 3] and all(r["limited"] and r["count"] == 3 for r in some)


def test_metadata_filters(points):
    assert ids(points.where(knn.matches("metadata", {"type": "x", "other": 1}))) == []
    assert ids(points.where(knn.matches("metadata", {}))) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert ids(points.where(knn.matches("metadata", {"type": "' OR 1=1"}))) == []


@pytest.mark.parametrize("metric", D.METRICS)
def test_knn_equals_brute_force_with_ties_and_bad_rows(spark, metric):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((60, 5)), 1)
    x[7] = x[3]
    x[9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(100, None), (None, [1.0] * 5), (101, [1.0]), (102, [])], "id long, vector array<double>")
    q = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["dist"]) for r in knn.knn(q, df, 4, metric, block=16).collect()}
    d = knn.distances(x, x, metric)
    for i in range(60):
        for k, j in enumerate(np.lexsort((np.arange(60), d[i]))[:4]):
            assert got[i, k + 1] == (j, d[i, j])
    one = df.where("id = 3").crossJoin(df.where("id < 60").toDF("b", "w")).select("b", D.round6(D.distance(metric, F.col("vector"), F.col("w"))).alias("d")).collect()
    assert all(abs(r["d"] - d[3, r["b"]]) < 2e-6 for r in one)


def test_distances_of_edges(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [None if r[0] is None else round(r[0], 9) for r in rows.select(D.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [1, 0, -1, 0] and got[5] is None


def test_approximate_searches_keep_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    exact = knn.knn(v, v, 10, "l2")
    two = quantization.knn_two_stage(v, v, 10)
    ivf = knn.knn_ivf(v, v, clustering.fit(v, 16), 10, 13)
    truth = knn.knn(v, v, 10, "cosine")
    assert knn.recall(two, exact, 10).agg(F.avg("recall")).first()[0] > 0.95
    assert knn.recall(ivf, truth, 10).agg(F.avg("recall")).first()[0] > 0.9


def test_codes(spark):
    rows = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(300)] + [(999, None)], "id long, vector array<float>")
    r = {x["d"]: (x["lo"], x["hi"]) for x in quantization.ranges(rows).collect()}
    assert r == {0: (3.0, 296.0), 1: (5.0, 5.0)}
    packed = quantization.packed_ranges(quantization.ranges(rows))
    code = quantization.encode(F.col("vector"), F.col("lows"), F.col("highs"))
    got = {x["id"]: x["c"] for x in rows.crossJoin(packed).select("id", code.alias("c")).collect()}
    assert got[0] == [0, 0] and got[299] == [255, 0] and got[999] is None
    bits = spark.range(1).select(F.array(*map(F.lit, [1, 15, 7])).alias("c")).select("c", quantization.pack_bits(F.col("c")).alias("p"))
    assert bits.select("p", quantization.unpack_bits(F.col("p"), F.lit(3)).alias("u")).first() == ("f107", [1, 15, 7])
    assert quantization.recommend(64)["kind"] == "scalar" and quantization.recommend(768)["kind"] == "product"


def test_near_signatures_share_a_band(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 32))
    rows = [(0, base)] + [(i + 1, base ^ sum(1 << int(b) for b in rng.choice(32, size=k, replace=False))) for i, k in enumerate([0, 1, 2, 3, 4, 5])]
    got = {(r["a"], r["b"]): r["differ"] for r in vector_dedup.hamming_candidates(spark.createDataFrame(rows, "id long, signature long")).collect()}
    want = {(a, b): n for a, x in rows for b, y in rows if a < b and (n := bin(x ^ y).count("1")) <= 3}
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert knn.knn(none, none, 3).collect() == [] and vector_dedup.exact_groups(none).collect() == [] and quantization.ranges(none).collect() == []


def test_blocks_of_a_key_meet_only_each_other(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 4))
    rows = [(i, v.tolist(), i % 3 if i else None) for i, v in enumerate(x)] + [(200, [1.0], 1), (201, None, 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, key long").repartition(3)
    left, right = (knn.packed(df, p, 8, "key") for p in ("q_", "v_"))
    got = {(r["query_id"], r["id"]): r["key"] for r in knn.searched(knn.keyed_blocks(left, right, "key"), "l2", radius=100.0, key="key").collect()}
    want = {(a, b): i for a, v, i in rows for b, w, j in rows if i is not None and i == j and v and w and len(v) == len(w)}
    assert got == want


def test_pq_pairs_equal_those_of_expressions(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where("id < 60")
    rng = np.random.default_rng(2)
    book = spark.createDataFrame([(m, k, c.tolist()) for m in range(8) for k, c in enumerate(rng.standard_normal((5, 8)) / 8)], "m int, k int, centroid array<double>")
    codes = quantization.pq_codes(v, book, 8).crossJoin(quantization.book_of(book))
    q = v.where("id < 4").join(codes.select("id", F.col("code").alias("own")), "id").withColumnRenamed("id", "query_id")
    rows = q.crossJoin(codes).select("query_id", "id", D.round6(quantization.asymmetric(F.col("vector"), F.col("code"), F.col("book"), 8)).alias("a"), D.round6(quantization.symmetric(F.col("own"), F.col("code"), F.col("book"))).alias("s"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in quantization.pq_pairs(v.where("id < 4"), v, book, 8, block=16).collect()}
    assert got == {(r[0], r[1]): (r[2], r[3]) for r in rows.collect()} and len(got) == 240


@pytest.mark.parametrize("name", ["knn_l2", "knn_filtered", "recall_at_k", "fuse_rrf", "fuse_combsum", "semantic_cache"])
def test_searches_of_each_fiftieth_row_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    df = entry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want and all(r[0] % 50 == 0 for r in want)


def test_near_pairs_are_of_classes_and_lose_no_link(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((20, 6)), 3, axis=0)
    x[1::3] += 0.05 * rng.standard_normal((20, 6))
    x = np.vstack([x, np.zeros((2, 6))])
    ids = (rng.permutation(62) - 20).tolist()  # every third vector is the first's copy
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(900, None)], "id long, vector array<double>").repartition(3)
    d = knn.distances(x, x, "cosine")
    near = {(min(ids[i], ids[j]), max(ids[i], ids[j])): d[i, j] for i in range(62) for j in range(62) if i != j and d[i, j] <= 0.05}
    head = {ids[i]: min(ids[j] for j in range(62) if (x[i] == x[j]).all() and (i == j or x[i].any())) for i in range(62)}
    got = {(r["a"], r["b"]): r["similarity"] for r in vector_dedup.near_pairs(df).collect()}
    want = {(a, b): round(1 - s, 6) for (a, b), s in near.items() if head[a] == a and head[b] == b} | {(h, i): 1.0 for i, h in head.items() if h != i}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    low = {i: min([i, *(a for a, b in near if b == i)]) for i in ids}
    assert {r["id"]: r["representative"] for r in vector_dedup.representatives(df).collect()} == low | {900: 900}
    assert vector_dedup.near_pairs(df.limit(0)).count() == 0
    grouped = vector_dedup.classes(df)
    assert {(r["a"], r["b"]) for r in vector_dedup.class_pairs(grouped, block=7).collect()} == {k for k in want if head[k[1]] == k[1]}
