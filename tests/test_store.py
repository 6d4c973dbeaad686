"""Collections, logs, exports and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.plans import store as plans
from quern.sources import collections as C
from quern.streaming import feedback_stream as S


def test_collections(spark, tmp_path):
    s = C.Store(spark, f"file://{tmp_path}/store")
    s.create("a", 2)
    with pytest.raises(ValueError):
        s.create("a", 2)
    rows = spark.createDataFrame([("x", [1.0, 2.0], {"k": "v"}), ("y", [3.0, 4.0], None)], C.VECTOR)
    assert s.put("a", rows) == 2
    with pytest.raises(ValueError):
        s.put("a", spark.createDataFrame([("z", [1.0], None)], C.VECTOR))
    assert s.update("a", spark.createDataFrame([("x", [9.0, 9.0], None), ("none", [1.0, 1.0], None)], C.VECTOR)) == 1
    assert s.get("a", "x").first()["values"] == [9.0, 9.0]
    s.export(f"file://{tmp_path}/out")
    assert s.verify(f"file://{tmp_path}/out") == {"a": True} and C.manifest_of(spark, f"file://{tmp_path}/out")[0]["vectors"] == 2
    s.delete("a", spark.createDataFrame([("y",)], "id string"))
    assert [r["id"] for r in s.vectors("a").collect()] == ["x"] and s.stats().first()["vectors"] == 1
    with pytest.raises(ValueError):
        s.load(f"file://{tmp_path}/out")
    assert s.load(f"file://{tmp_path}/out", overwrite=True) == {"a": 2}
    s.drop("a")
    assert s.collections().count() == 0 and s.vectors("a").count() == 0


def test_checksum(spark):
    assert spark.range(1).select(C.checksum(F.lit("ab"))).first()[0] == 3105


def test_streams_equal_batches(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    events = plans._stream(spark, d)
    rows = plans.stream_ctr(spark, d).collect()
    assert len(rows) == 50 and sum(r["clicks"] for r in rows) == spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click'").count()
    hours = plans._run(spark, S.ctr_windows(events), "append").collect()
    assert hours and sum(r["impressions"] for r in hours) <= 1000
    joined = plans._run(spark, S.attributed(events, "48 hours", "72 hours"), "append")
    assert joined.where("seen > ts").count() == 0


def test_equal_clicks_and_impressions_meet_once(spark, tmp_path):
    kinds = "query_id long, document_id long, position long, type string, ts timestamp"
    rows = [(1, 1, 2, "impression", 10), (1, None, 2, "impression", 10), (1, 1, 3, "impression", 11), (1, 1, 2, "click", 12), (1, None, 2, "click", 12), (1, 1, 2, "click", 9), (2, 1, None, "impression", 5), (2, 1, 1, "click", 5)]
    times = [1500, 3, 2, 1200, 3, 4, 1, 1]
    one = spark.createDataFrame([(*r, n) for r, n in zip(rows, times)], kinds.replace("ts timestamp", "s long, n long")).withColumn("ts", F.timestamp_seconds("s"))
    one.withColumn("copy", F.explode(F.expr("sequence(1, n)"))).drop("copy", "n", "s").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    kept = plans._run(spark, S.attributed_counts(events), "append")
    assert kept.agg(F.max("times")).first()[0] <= 1024 and kept.count() < 100_000
    want = {(1, 12, 10, 2): 1500 * 1200, (1, 12, 11, 3): 2 * 1200, (2, 5, 5, None): 1}
    got = plans._run(spark, S.attributed(events), "append").groupBy("query_id", F.unix_timestamp("ts"), F.unix_timestamp("seen"), "seen_position").count().collect()
    assert {tuple(r)[:-1]: r["count"] for r in got} == want == {tuple(r)[:-1]: r["n"] for r in kept.groupBy("query_id", F.unix_timestamp("ts"), F.unix_timestamp("seen"), "seen_position").agg(F.sum("times").alias("n")).collect()}
