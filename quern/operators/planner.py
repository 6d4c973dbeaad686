"""What a search's planner and caches decide, as expressions over tables of requests, collections and accesses.

Spark plans its own jobs; these are the reference values for a service in front of it: which k to ask for, what a query costs, which index
suits a collection, what to keep hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.operators import feedback as B
from quern.operators import knn as K


def planned(requests: DataFrame, collections: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """request_id, optimal_k, fast_path, parallel, cost, cache of requests(request_id, collection, k, filtered[, query_hash]).

    collections are (collection, vectors, dimension, index_type, updates a second), patterns (query_hash, frequency, hit_rate) of queries seen before.
    """
    rows = requests.join(collections, "collection")
    n, hnsw = F.col("vectors"), F.col("index_type") == "hnsw"
    k = F.when(n < 1000, F.col("k")).when(F.col("updates") > 10, F.floor(F.col("k") * 1.2)).when(hnsw & (n > 100_000), F.floor(F.col("k") * 1.1)).otherwise(F.col("k"))
    fast = ((F.col("index_type") == "flat") & (F.col("k") <= 10) & (n < 10_000)) | (hnsw & ~F.col("filtered"))
    parallel = F.when(n < 10_000, 1).when(n < 100_000, 2).when(n < 1_000_000, 4).otherwise(8)
    cost = n * F.col("dimension") * 0.001 * F.when(hnsw, 0.1).otherwise(1.0) * F.when(F.col("filtered"), 1.5).otherwise(1.0) * F.col("k") * 0.1
    cache = F.lit(False)
    if patterns is not None:
        rows = rows.join(patterns, "query_hash", "left")
        cache = F.coalesce((F.col("frequency") > 10) | (F.col("hit_rate") > 0.5), F.lit(False))
    return rows.select("request_id", k.cast("int").alias("optimal_k"), fast.alias("fast_path"), parallel.alias("parallel"), D.round6(cost).alias("cost"), cache.alias("cache"))


def running_means(executions: DataFrame) -> DataFrame:
    """plan_id, n, mean_ms, mean_results of executions(plan_id, ts, ms, results): each mean is an integer at every step, as a counter keeps it.

    (mean * n + x) div (n + 1) depends on order, so a plan's executions come sorted by ts, ms and results and pass one by one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, n, ms, results = None, 0, 0, 0
        for batch in batches:
            out = []
            for p, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if p != plan:
                    if n:
                        out.append((plan, n, ms, results))
                    plan, n, ms, results = p, 0, 0, 0
                ms, results, n = (ms * n + x) // (n + 1), (results * n + y) // (n + 1), n + 1
            yield _mean_rows(out)
        yield _mean_rows([(plan, n, ms, results)] if n else [])

    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    rows = executions.where("plan_id is not null").select(F.col("plan_id").cast("bigint").alias("plan_id"), "ts", whole("ms"), whole("results"))
    rows = rows.repartition("plan_id").sortWithinPartitions("plan_id", "ts", "ms", "results").select("plan_id", "ms", "results")
    return rows.mapInArrow(work, "plan_id bigint, n bigint, mean_ms bigint, mean_results bigint")


def _mean_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["plan_id", "n", "mean_ms", "mean_results"])


def index_choice(collections: DataFrame, profiles: DataFrame) -> DataFrame:
    """collection, index_type, score: of profiles(index_type, latency, insert, memory, accuracy, least, most) the one of the highest score for each of collections(collection, vectors, qps).

    0.4 latency, 0.2 insert, 0.2 memory, 0.2 accuracy; from over 100 queries a second on 0.6 and 0.1 for the first two; 0 outside the profile's sizes; ties go to the first by name.
    """
    busy = F.col("qps") > 100
    score = F.col("latency") * F.when(busy, 0.6).otherwise(0.4) + F.col("insert") * F.when(busy, 0.1).otherwise(0.2) + F.col("memory") * 0.2 + F.col("accuracy") * 0.2
    rows = collections.select("collection", "vectors", "qps").crossJoin(F.broadcast(profiles)).withColumn("score", D.round6(F.when(F.col("vectors").between(F.col("least"), F.col("most")), score).otherwise(0.0)))  # a profile for each kind of index
    return rows.groupBy("collection").agg(F.min(F.struct((-F.col("score")).alias("s"), "index_type")).alias("b")).select("collection", "b.index_type", (-F.col("b.s")).alias("score"))


def confidence(progress: Column, gap: Column, full: Column) -> Column:
    """How sure a top k is at a share of the work: 0.7 * progress, 0.2 more if scores stand well apart (0.1 if a little), 0.1 more if there are k; at most 1."""
    return F.least(F.lit(1.0), 0.7 * progress + F.when(gap > 0.2, 0.2).when(gap > 0.1, 0.1).otherwise(0.0) + F.when(full, 0.1).otherwise(0.0))


def coarse_queries(queries: DataFrame, centroids: DataFrame, clusters: int, coarse: int, metric: str = "l2") -> DataFrame:
    """query_id, vector: for each of queries(id, vector) the mean of its `clusters` nearest centroids' first `coarse` values, each counting 1 / (distance + 0.1)."""
    c = centroids.select("cluster_id", "centroid")
    near = K.knn(queries, c, clusters, metric).select("query_id", F.col("id").alias("cluster_id"), (1 / (F.col("dist") + 0.1)).alias("w"))
    rows = near.join(c, "cluster_id").select("query_id", "w", F.posexplode(F.slice(F.col("centroid").cast("array<double>"), 1, coarse)).alias("d", "x"))
    mean = rows.groupBy("query_id", "d").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))


def registry(models: DataFrame, languages: list[str] | None = None, tags: list[str] | None = None, least: int = 0, most: int = 0) -> DataFrame:
    """name, relevance of models(name, languages, dimension, tags, accuracy, throughput, bytes) with any of the languages, any of the tags and a dimension in range (0 is open).

    relevance: 0.4 accuracy, 0.3 of the tags asked for that it has, 0.2 * throughput / 1000, 100 / MB; what isn't known adds nothing.
    """
    rows = models
    words = lambda x: F.array(*map(F.lit, x))
    if languages:
        rows = rows.where(F.arrays_overlap("languages", words(languages)))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", words(tags)))
    if least > 0:
        rows = rows.where(F.col("dimension") >= least)
    if most > 0:
        rows = rows.where(F.col("dimension") <= most)
    share = F.size(F.array_intersect("tags", words(tags))) / len(tags) * 0.3 if tags else F.lit(0.0)
    score = F.coalesce("accuracy", F.lit(0.0)) * 0.4 + share + F.coalesce(F.col("throughput") / 1000 * 0.2, F.lit(0.0)) + F.when(F.col("bytes") > 0, 100.0 / (F.col("bytes") / 1048576)).otherwise(0.0)
    return rows.select("name", D.round6(score).alias("relevance"))


def memory(collections: DataFrame, code_bytes: int, originals: bool = True) -> DataFrame:
    """collection, base, codes, originals, total in bytes of collections(collection, vectors, dimension): 64 a node, the codes, and 4 a value kept."""
    n = F.col("vectors").cast("bigint")
    kept = n * F.col("dimension") * 4 if originals else F.lit(0)
    return collections.select("collection", (n * 64).alias("base"), (n * code_bytes).alias("codes"), kept.cast("bigint").alias("originals"), (n * 64 + n * code_bytes + kept).cast("bigint").alias("total"))


def rebalance_impact(moves: DataFrame, most_moves: int = 1000) -> DataFrame:
    """One row: moves, ms (10 each), clusters (touched), impact of moves(id, source, target); moderate from over half of most_moves on."""
    touched = F.array_distinct(F.array_union(F.collect_set("source"), F.collect_set("target")))
    n = F.count(F.lit(1))
    return moves.agg(n.alias("moves"), (n * 10).alias("ms"), F.size(touched).alias("clusters"), F.when(n > most_moves / 2, "moderate").otherwise("minimal").alias("impact"))


def moved(assignments: DataFrame, moves: DataFrame) -> DataFrame:
    """assignments(id, cluster_id) with each vector of moves(id, target) in its new cluster."""
    return assignments.join(moves.select("id", "target"), "id", "left").select("id", F.coalesce("target", "cluster_id").alias("cluster_id"))


def search_stats(log: DataFrame, last: int = 1000) -> DataFrame:
    """One row: queries, mean_ms, p95_ms, success_rate, hit_rate of log(ts, ms, results, cached); p95 is of the last `last` by ts, the value at place 0.95 n from 0."""
    every = log.agg(F.count(F.lit(1)).alias("queries"), D.round6(F.coalesce(F.avg("ms"), F.lit(0.0))).alias("mean_ms"), D.round6(F.coalesce(F.avg((F.col("results") > 0).cast("int")), F.lit(0.0))).alias("success_rate"), D.round6(F.coalesce(F.avg(F.col("cached").cast("int")), F.lit(0.0))).alias("hit_rate"))
    recent = log.orderBy(F.col("ts").desc()).limit(last).agg(F.array_sort(F.collect_list("ms")).alias("v"))
    return every.crossJoin(recent.select(F.get("v", F.floor(F.size("v") * 0.95).cast("int")).alias("p95_ms")))  # one row each


# --- caches


def cache_key(collection: Column, vector: Column, k: Column, metric: Column, filters: Column, user: Column, with_vectors: Column, values: int | None = None) -> Column:
    """SHA-256 of a query: all its values to four decimals (only the first `values`, if given, which makes unlike queries collide), k, its filters by key, metric, user and options."""
    head = vector if values is None else F.slice(vector, 1, values)
    numbers = F.array_join(F.transform(head, lambda x: F.format_string("%.4f", x.cast("double"))), "")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit("|"))), "")
    who = F.when(F.coalesce(user, F.lit("")) != "", F.concat(F.lit("user:"), user, F.lit("|"))).otherwise("")
    return F.sha2(F.concat(collection, F.lit("|"), numbers, F.lit("|len:"), F.size(vector).cast("string"), F.lit("|k:"), k.cast("string"), F.lit("|"), F.coalesce(pairs, F.lit("")), metric, F.lit("|"), who, F.lit("vec:"), with_vectors.cast("string")), 256)


def adaptive_ttl(update_s: Column, least_s: float = 30.0, most_s: float = 300.0) -> Column:
    """Half of the time between updates, in bounds."""
    return F.least(F.lit(most_s), F.greatest(F.lit(least_s), update_s / 2))


def semantic_lookup(queries: DataFrame, past: DataFrame, clusters: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, id, cluster_id, confidence of past(id, vector, cluster_id) with a cosine of at least threshold to a query of queries(id, vector), in clusters that contain it.

    clusters are (cluster_id, centroid, radius); one contains a query within its radius, by cosine distance.  Only members of these are compared.
    """
    inside = K.range_search(queries, clusters.select("cluster_id", "centroid"), 2.0, "cosine").select("query_id", F.col("id").alias("cluster_id"), "dist")
    inside = inside.join(clusters.select("cluster_id", "radius"), "cluster_id").where("dist <= radius").select(F.col("query_id").alias("id"), "cluster_id")
    asked = inside.join(queries.toDF("id", "vector"), "id").select("id", "vector", "cluster_id")
    pairs = K.keyed_blocks(K.packed(asked, "q_", key="cluster_id"), K.packed(past.select("id", "vector", "cluster_id"), "v_", key="cluster_id"), "cluster_id")
    found = K.searched(pairs, "cosine", radius=round(1 - threshold, 6), key="cluster_id")
    return found.select("query_id", "id", "cluster_id", D.round6(1 - F.col("dist")).alias("confidence"))


def partitions(accesses: DataFrame, as_of: str) -> DataFrame:
    """partition_id, accesses, last, temperature of accesses(partition_id, ts)."""
    g = accesses.groupBy("partition_id").agg(F.count(F.lit(1)).alias("accesses"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    at = F.lit(as_of).cast("timestamp")
    heat = B.temperature(F.col("last").cast("timestamp"), F.col("first").cast("timestamp"), F.col("accesses"), at)
    return g.select("partition_id", "accesses", "last", D.round6(heat).alias("temperature"))


def hot(stats: DataFrame, count: int = 10, least: int = 5) -> DataFrame:
    """partition_id, rank, temperature: the hottest of those with `least` accesses, ties to the lower id."""
    rows = stats.where(F.col("accesses") >= least).orderBy(F.col("temperature").desc(), "partition_id").limit(count)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("temperature").desc(), "partition_id"))).select("partition_id", "rank", "temperature")  # `count` rows


def cold(stats: DataFrame, as_of: str, idle_s: int = 3600, below: float = 0.1) -> DataFrame:
    """partition_id of partitions idle for longer and cooler than below."""
    idle = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return stats.where((idle > idle_s) & (F.col("temperature") < below)).select("partition_id")


def access_analysis(accesses: DataFrame, as_of: str) -> DataFrame:
    """One row: partitions, hot (over 0.5), cold, accesses, mean temperature, peak_hour (the first of equal ones) and its accesses."""
    stats = partitions(accesses, as_of).agg(F.count(F.lit(1)).alias("partitions"), F.count(F.when(F.col("temperature") > 0.5, 1)).alias("hot"), F.count(F.when(F.col("temperature") <= 0.5, 1)).alias("cold"), F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"), D.round6(F.coalesce(F.avg("temperature"), F.lit(0.0))).alias("temperature"))
    hours = accesses.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), "hour")).alias("p"))
    return stats.crossJoin(hours.select(F.coalesce("p.hour", F.lit(0)).alias("peak_hour"), F.coalesce(-F.col("p.m"), F.lit(0).cast("bigint")).alias("peak_accesses")))  # one row each
