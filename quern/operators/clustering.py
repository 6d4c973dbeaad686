"""Clustering of vectors: assignment, Lloyd steps, quality, balance.

Vectors are (id, vector), assignments (id, cluster_id), centroids (cluster_id, centroid, ...).  Distances are L2,
rounded to six decimals, ties to the lower cluster.  Rows with null vectors belong to no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.operators import knn as K


def fit(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """cluster_id, centroid of k-means; the centroids, k of them, pass through the driver."""
    rows = vectors.toDF("id", "vector").where("vector is not null").select(array_to_vector("vector").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(rows)
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(found, "cluster_id bigint, centroid array<double>")


def step(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster_id, centroid, size after one assignment and update; a centroid without vectors is dropped."""
    own = K.assigned(vectors, centroids).select("id", "cluster_id")
    return K.centroids_of(own, vectors)


def with_centroids(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, cluster_id, vector, dist to the own centroid."""
    rows = vectors.toDF("id", "vector").join(assignments, "id").join(centroids.select("cluster_id", "centroid"), "cluster_id")
    return rows.select("id", "cluster_id", "vector", D.l2(F.col("vector"), F.col("centroid")).alias("dist"))


def inertia(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster_id, size, wcss (sum of squared distances), radius (1.2 times the largest distance)."""
    rows = with_centroids(vectors, assignments, centroids)
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum(F.col("dist") * F.col("dist")), 6).alias("wcss"), F.round(1.2 * F.max("dist"), 6).alias("radius"))


def quality(vectors: DataFrame, assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster_id, size, intra (mean distance), inter (to the nearest other centroid), silhouette, imbalance (of size against the mean)."""
    c = centroids.select("cluster_id", "centroid")
    intra = with_centroids(vectors, assignments, centroids).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("dist").alias("intra"))
    other = c.toDF("other", "o")
    inter = c.join(other, F.col("cluster_id") != F.col("other")).groupBy("cluster_id").agg(F.min(D.l2(F.col("centroid"), F.col("o"))).alias("inter"))
    rows = intra.join(inter, "cluster_id", "left")
    mean = F.avg("size").over(Window.partitionBy())  # one row for each cluster
    silhouette = F.when(F.col("intra") > 0, (F.col("inter") - F.col("intra")) / F.greatest("inter", "intra")).otherwise(0.0)
    return rows.select("cluster_id", "size", D.round6(F.col("intra")).alias("intra"), D.round6(F.col("inter")).alias("inter"), D.round6(silhouette).alias("silhouette"), D.round6(F.abs(F.col("size") - mean) / mean).alias("imbalance"))


def silhouette(vectors: DataFrame, assignments: DataFrame, block: int = K.BLOCK) -> DataFrame:
    """id, cluster_id, a (mean distance within the cluster), b (to the nearest other), silhouette.

    All pairs are compared, in blocks; each block of a side sends on one sum for each vector and cluster.
    """
    rows = vectors.toDF("id", "vector")
    sums = K.blocks(K.packed(rows, "q_", block), K.packed(rows.join(assignments, "id").select(F.col("id"), F.concat(F.array(F.col("cluster_id").cast("double")), F.col("vector").cast("array<double>"))), "v_", block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, q = K._matrix(batch, i, "q_")
                _, v = K._matrix(batch, i, "v_")
                if q.shape[1] != v.shape[1] - 1:
                    continue
                clusters, which = np.unique(v[:, 0], return_inverse=True)
                one = np.eye(len(clusters))[which]
                total = K.distances(q, np.ascontiguousarray(v[:, 1:]), "l2", 12) @ one  # means of six decimals would tie at the seventh
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, len(clusters))), pa.array(np.tile(clusters.astype(np.int64), len(q))), pa.array(total.ravel()), pa.array(np.tile(one.sum(axis=0).astype(np.int64), len(q)))], ["id", "other", "total", "n"])

    by = sums.mapInArrow(work, "id bigint, other bigint, total double, n bigint").groupBy("id", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    by = by.join(assignments, "id")
    own = F.col("cluster_id") == F.col("other")
    a = F.coalesce(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))), F.lit(0.0))
    b = F.min(F.when(~own, F.col("total") / F.col("n")))
    out = by.groupBy("id", "cluster_id").agg(a.alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"))
    top = F.greatest("a", "b")
    return out.select("id", "cluster_id", D.round6(F.col("a")).alias("a"), D.round6(F.col("b")).alias("b"), D.round6(F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)).alias("silhouette"))


def elbow(inertias: DataFrame) -> DataFrame:
    """k, inertia, bend (second difference), best: the k of inertias(k, inertia) where the curve bends most."""
    w = Window.partitionBy().orderBy("k")  # one row for each k tried
    bend = F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)
    rows = inertias.withColumn("bend", D.round6(bend))
    first = F.row_number().over(Window.partitionBy().orderBy(F.col("bend").desc_nulls_last(), "k"))
    return rows.withColumn("best", (first == 1) & F.col("bend").isNotNull())


def balanced(vectors: DataFrame, centroids: DataFrame, slack: float = 0.5) -> DataFrame:
    """id, cluster_id: each vector, in order of id, to its nearest centroid with room; a cluster holds (1 + slack) of an equal share.

    Greedy in one order, so one task assigns; sorted rows stream through it with each vector's centroids by distance, and it holds one number for each cluster.
    """
    near = K.knn(vectors, centroids.select("cluster_id", "centroid"), 1 << 20, "l2").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("order"))
    shape = near.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("order")), F.lit(1)).alias("k")).first()
    room = max(1, int(shape["n"] / shape["k"] * (1 + slack) + 0.999999))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        for batch in batches:
            out = []
            for order in batch.column(1).to_pylist():
                c = next((c for c in order if used.get(c, 0) < room), order[0])
                used[c] = used.get(c, 0) + 1
                out.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "cluster_id"])

    return near.repartition(1).sortWithinPartitions("query_id").mapInArrow(work, "id bigint, cluster_id bigint")


def rebalance(sizes: DataFrame, threshold: float = 0.3, most_moves: int = 1000) -> DataFrame:
    """cluster_id, size, kind (oversized, undersized, even), excess, split, merge of sizes(cluster_id, size).

    excess is what a cluster has over the mean size, rounded to zero and bounded by most_moves; split marks more than twice
    the mean, merge at most half of it.
    """
    mean = F.avg("size").over(Window.partitionBy())
    gap = F.col("size") - mean
    kind = F.when(gap > mean * threshold, "oversized").when(gap < -mean * threshold, "undersized").otherwise("even")
    excess = F.greatest(F.lit(-most_moves), F.least(F.lit(most_moves), gap.cast("bigint")))
    return sizes.select("cluster_id", "size", kind.alias("kind"), excess.cast("bigint").alias("excess"), (F.col("size") > 2 * mean).alias("split"), (F.col("size") <= mean / 2).alias("merge"))
