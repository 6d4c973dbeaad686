"""Personalization, planning, caches and folds on small tables with edges, against plain loops."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.embedding import hashed
from quern.operators import feedback as B
from quern.operators import fusion, knn, planner, quantization
from quern.operators import personal as P
from quern.sources.collections import Log, Store, replayed

EVENT = "user_id long, query_id long, document_id long, position long, type string, value double, ts timestamp_ntz"
AT = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(u, q, d, p, t, v, AT + dt.timedelta(seconds=s)) for u, q, d, p, t, v, s in rows], EVENT)


def test_filter_takes_both_ends_and_the_first_by_time(spark):
    x = events(spark, [(1, 1, 1, 1, "click", 1.0, s) for s in range(5)] + [(2, 1, 1, 1, "view", None, 9), (None, 1, 1, 1, "click", 1.0, 2)])
    got = P.filtered(x, "2024-01-01 00:00:01", "2024-01-01 00:00:03", user_id=1)
    assert sorted(r["ts"].second for r in got.collect()) == [1, 2, 3]
    assert [r["ts"].second for r in P.filtered(x, limit=2, type="click").collect()] == [0, 1]
    assert P.filtered(x.limit(0), user_id=1).collect() == []


def test_interests_forget_stepwise(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), AT + dt.timedelta(seconds=i), str(t), float(v)) for i, (u, t, v) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), rng.choice([0.0101, 0.3, 0.011], 300)))]
    want: dict = {}
    for u, _, t, v in rows:
        own = {k: s * 0.95 for k, s in want.get(u, {}).items()}
        own[t] = own.get(t, 0) + v
        want[u] = {k: s for k, s in own.items() if s >= 0.01}
    df = spark.createDataFrame(rows + [(None, AT, "x", 1.0)], "user_id long, ts timestamp_ntz, topic string, value double")
    got = {(r["user_id"], r["topic"]): r["score"] for r in P.interests(df).collect()}
    assert got.keys() == {(u, t) for u, own in want.items() for t in own} and all(abs(s - want[u][t]) < 1e-6 for (u, t), s in got.items())
    assert P.interests(df.limit(0)).collect() == []


@pytest.mark.parametrize("batch", [10_000, 7])
def test_sessions_and_means_pass_through_batches(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = np.random.default_rng(2)
        rows = [(int(u), 1, int(p), 1, "click", float(v), int(s)) for u, p, v, s in zip(rng.integers(0, 4, 200), rng.integers(0, 5, 200), rng.integers(0, 90, 200), rng.integers(0, 20_000, 200))] + [(None, 1, 1, 1, "click", 1.0, 5)]
        want = []
        for u in range(4):
            start, n = None, 0
            for s in sorted(r[6] for r in rows if r[0] == u):
                if start is None or s - start > 1800:
                    start, n = s, n + 1
                    want.append([u, n, start, 0])
                want[-1][3] += 1
        x = events(spark, rows)
        got = sorted([r["user_id"], r["session"], int((r["start"] - AT).total_seconds()), r["events"]] for r in B.sessions_from_start(x).collect())
        assert got == want and B.sessions_from_start(x.limit(0)).collect() == []
        means: dict = {}
        for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[6], int(r[5]), r[2])):
            n, a, b = means.get(r[0], (0, 0, 0))
            means[r[0]] = (n + 1, (a * n + int(r[5])) // (n + 1), (b * n + r[2]) // (n + 1))
        runs = planner.running_means(x.select(F.col("user_id").alias("plan_id"), "ts", F.col("value").alias("ms"), F.col("document_id").alias("results")))
        assert {r["plan_id"]: (r["n"], r["mean_ms"], r["mean_results"]) for r in runs.collect()} == means
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_running_dwell_equals_a_fold(spark):
    rows = [(1, q, 1, 1, t, v, s) for s, (q, t, v) in enumerate([(1, "dwell", 30.0), (1, "click", None), (2, "dwell", 50.0), (3, "view", 1.0), (1, "dwell", None), (1, "dwell", 10.0)])]
    mean, n = 0.0, 0
    for r in rows:
        if r[4] == "dwell":
            mean = (mean * n + (r[5] or 0)) / (n + 1)
        n += 1
    (got,) = B.document_feedback(events(spark, rows)).collect()
    assert abs(got["avg_dwell"] - mean) < 1e-6 and got["views"] == 6


def test_pairs_need_a_click(spark):
    rows = [(1, 1, d, d, "click" if d == 3 else "view", float(d), d) for d in range(1, 6)] + [(1, 2, 1, 1, "view", 1.0, 1), (1, 2, 2, 2, "view", 1.0, 2)]
    x = events(spark, rows).withColumn("score", F.col("value") / 10).withColumn("views", F.col("document_id"))
    got = {(r["doc1"], r["doc2"]): (r["label"], r["score_diff"], r["views_diff"]) for r in B.pairwise(x).collect()}
    assert got.keys() == {(1, 3), (2, 3), (3, 4), (3, 5)} and got[1, 3][0] == 0 and got[3, 4] == (1.0, -0.1, round(math.log1p(3) - math.log1p(4), 6))


def test_pairs_are_counted_in_blocks_and_written_out(spark):
    rng = np.random.default_rng(5)
    some = lambda *x: x[rng.integers(0, len(x))]
    rows = [(1, some(1, 1, 2, None), some(1, 2, 3), some(1, 2, 3, None), some("click", "impression", None), some(0.0, 1.0, 2.0, math.nan, None), s, some(0.5, 0.25), some(1, None)) for s in range(600)]
    rows += [(1, 4, 1, 5, None, 1.5, 1000 + s, 0.5, 1) for s in range(9)]  # a position of which no type is known
    x = spark.createDataFrame([(*r[:6], AT + dt.timedelta(seconds=r[6]), *r[7:]) for r in rows], EVENT + ", score double, views long")
    x = x.drop("score", "views"), x
    hit = {(q, p): max([int(t == "click") for _, q2, _, p2, t, *_ in rows if (q2, p2) == (q, p) and t], default=None) for _, q, _, p, *_ in rows}
    by, want = {}, ({}, {})
    for r in sorted(rows, key=lambda r: (-1 if r[3] is None else r[3], r[6])):
        by.setdefault(r[1], []).append(r)
    for q in by.keys() - {None}:
        for i, a in enumerate(by[q]):
            for b in by[q][i + 1 :]:
                h, k, v, w = hit[q, a[3]], hit[q, b[3]], a[5], b[5]
                if h or k:
                    nan = lambda v: math.inf if math.isnan(v) else v
                    label = 1.0 if h and k == 0 else 0.0 if k and h == 0 else 0.5 if v is None or w is None or nan(v) == nan(w) else float(nan(v) > nan(w))
                    ends = (None, None) if None in (a[3], b[3]) else (float(b[3] - a[3]), round(a[3] / b[3], 6))
                    for out, more in zip(want, ((), (a[7] - b[7], None if None in (a[8], b[8]) else 0.0))):
                        key = (q, a[2], b[2], label, *ends, *more)
                        out[key] = out.get(key, 0) + 1
    for block in (50, 8192):
        for given, out in zip(x, want):
            got = B.pairwise(given, block)
            assert {tuple(r)[:-1]: r["count"] for r in got.groupBy(got.columns).count().collect()} == out


def test_pairs_that_give_equal_rows_are_counted_once(spark):
    x = spark.range(30_000).selectExpr("1L user_id", "7L query_id", "id % 3 document_id", "2L position", "'click' type", "double(id % 1000) value", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) ts")
    found = B.pair_counts(x).agg(F.count(F.lit(1)), F.sum("times"), F.max("times")).first()
    assert found[0] < 600_000 and found[1] == 30_000 * 29_999 // 2 and found[2] <= B.MOST


def test_weights_and_modes(spark):
    requests = spark.createDataFrame([(1, 1, True, None, None, "auto", True, "q"), (2, 1, False, None, None, None, True, None), (3, 1, True, 1.0, None, "vector", False, "q"), (4, 9, True, 0.0, 0.0, "", False, "")], "request_id long, user_id long, personalize boolean, vector_weight double, text_weight double, mode string, has_vector boolean, query string")
    profiles = spark.createDataFrame([(1, 0.9, 0.1)], "user_id long, vector_weight double, text_weight double")
    got = {r["request_id"]: tuple(r)[1:] for r in P.weights(requests, profiles).collect()}
    assert got == {1: (0.9, 0.1, "hybrid"), 2: (0.5, 0.5, "vector"), 3: (0.909091, 0.090909, "vector"), 4: (0.0, 0.0, "text")}


def test_training_follows_the_gradient(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((50, 2)), rng.integers(0, 2, 50)
    w = np.zeros(2)
    for e in range(10):
        p = 1 / (1 + np.exp(-(0.5 + x @ w)))
        w = w + 0.01 * 0.95**e * ((y - p) @ x / 50 - 0.001 * w)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    assert np.allclose([r["weight"] for r in P.trained(df, ["a", "b"]).collect()], w, atol=1e-6)
    assert [r["weight"] for r in P.trained(df.limit(0), ["a"]).collect()] == [0.0]


def test_chunks_of_characters_end_at_white_space():
    text = "".join(f"word{i} " for i in range(800))
    chunks = T.cut_by_characters(text)
    assert all(len(c) <= 1000 for c in chunks) and all(c.split()[-1] in text.split() for c in chunks)
    assert T.cut_by_characters("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 700] and T.cut_by_characters("") == [""]


def test_hashed_counts_and_boosts(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta alpha alpha"), (3, None), (4, "")], "id long, text string").select("id", hashed(F.col("text"), 16).alias("v"))
    got = {r["id"]: r["v"] for r in rows.collect()}
    assert got[1] == got[2] and len(got[1]) == 16 and sum(map(abs, got[1])) in (1, 3) and got[3] is None and got[4] == [0.0] * 16
    hits = spark.createDataFrame([(1, 1, 7, 0.1), (1, 2, 8, 0.2)], "query_id long, rank int, id long, dist double")
    text = spark.createDataFrame([(1, 1, 8, 5.0)], "query_id long, rank int, id long, score double")
    info = spark.createDataFrame([(7, dt.datetime(2024, 1, 31, 12), "Official"), (8, None, None)], "id long, created timestamp, source string")
    out = {r["id"]: r["score"] for r in fusion.hybrid(hits, text, info=info, as_of=F.lit("2024-02-01").cast("timestamp")).collect()}
    assert out == {7: round(round(0.6 / 61, 6) * 1.2 * 1.3, 6), 8: round(0.6 / 62 + 0.4 / 61, 6)}


def test_two_stage_search_loses_little_and_l2_keeps_equal_vectors_at_zero(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    v = spark.createDataFrame(rows + [(900, rows[0][1]), (901, None)], "id long, vector array<double>")
    exact = knn.knn(v, v, 5, "l2")
    assert all(r["dist"] == 0 for r in exact.where("query_id = 0 and id in (0, 900)").collect())
    found = quantization.knn_two_stage(v, v, 5, block=64)
    assert knn.recall(found, exact, 5).agg(F.avg("recall")).first()[0] > 0.98


def test_last_of_equal_ids_stays_and_deletes_hold(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create("c", 2)
    rows = spark.createDataFrame([("a", [1.0, 1.0], None), ("b", [2.0, 2.0], None), ("a", [3.0, 3.0], None)], "id string, values array<float>, metadata map<string,string>").coalesce(1)
    assert store.put("c", rows) == 2
    assert {r["id"]: r["values"][0] for r in store.vectors("c").collect()} == {"a": 3.0, "b": 2.0}
    store.delete("c", spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in store.vectors("c").collect()] == ["b"]


def test_log_appends_rotates_and_truncates(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    row = lambda op, i, data: (AT, op, "c", i, data)
    schema = "ts timestamp, operation string, collection string, vector_id string, data string"
    assert log.entries().count() == 0 and log.truncate(5) == []
    log.append(spark.createDataFrame([row("insert", "1", "a"), row("insert", "2", "b")], schema).coalesce(1))
    log.rotate()
    log.append(spark.createDataFrame([row("insert", "1", "c"), row("delete", "2", None)], schema).coalesce(1))
    assert {(r["vector_id"], r["data"]) for r in replayed(log.entries()).collect()} == {("1", "c")}
    ids = sorted(r["entry_id"] for r in log.entries().collect())
    assert len(set(ids)) == 4 and len(log.segments()) == 2
    assert log.truncate(ids[1]) == [] and log.truncate(ids[2]) == log.segments()[:0] + ["000000000"] and log.entries().count() == 2
    small = Log(spark, f"file://{tmp_path}/small", most_bytes=10)
    for _ in range(3):
        small.append(spark.createDataFrame([row("insert", "1", "a")], schema))
    assert len(small.segments()) == 3


def test_registry_choice_and_key(spark):
    models = spark.createDataFrame([("a", ["en"], 128, ["fast"], 0.5, 500.0, 104857600), ("b", ["fr"], 128, ["fast"], 1.0, None, None)], "name string, languages array<string>, dimension int, tags array<string>, accuracy double, throughput double, bytes long")
    assert {r["name"]: r["relevance"] for r in planner.registry(models, ["en"], ["fast", "x"]).collect()} == {"a": round(0.2 + 0.15 + 0.1 + 1.0, 6)}
    assert planner.registry(models.limit(0)).collect() == []
    x = events(spark, [])
    assert planner.access_analysis(x.select(F.col("user_id").alias("partition_id"), "ts"), "2024-02-01 00:00:00").first()["partitions"] == 0


def test_reranking_meets_each_list_of_topics_once(spark):
    import time

    n = 20_000
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    topics = F.array((F.col("id") % 3).cast("string"), (F.col("id") % 5).cast("string"))
    rows = spark.range(n).select(F.lit(0).alias("list_id"), F.col("id").alias("position"), "id", F.lit(1.0).alias("score"), F.lit(0.0).alias("vector_score"), F.lit(0.0).alias("text_score"), F.lit(0).alias("views"), F.lit(0.0).alias("rating"), at.alias("created"), F.lit("blog").alias("source"), topics.alias("topics"))
    began = time.time()
    got = {r["id"]: r["score"] for r in B.rerank(rows, "2024-01-01 00:00:00").collect()}
    assert time.time() - began < 60  # each result against all before it takes minutes
    alone = got[0]
    assert len(got) == n and got[1] == pytest.approx(alone) and got[3] == pytest.approx(alone * (1 - 0.3 / 3), abs=1e-5) and got[n - 1] == pytest.approx(alone * 0.7, abs=1e-5)
