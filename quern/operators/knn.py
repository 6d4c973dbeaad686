"""Nearest neighbours, range search and candidate generation over vectors.

Tables are (id, vector).  Every query vector is a row of a table, so a search is a join.  Vectors are packed
in blocks, one row of ids and one matrix each; blocks of both sides are crossed and a matrix product gives
all distances of two blocks.  Per query only its k nearest of each block go on to the shuffle.
Spark broadcasts the packed queries where they are within spark.sql.autoBroadcastJoinThreshold and
crosses partitions otherwise; packed blocks are shuffled first, so that they are packed once and not for each partition they meet.

Distances are doubles rounded to six decimals; ties go to the lower id.  Null vectors, and vectors of another length than the
first of their table's block, match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
PARTS = 16
_PACKED = "{p}ids binary, {p}values binary, {p}width int"
PAIRS = "query_id bigint, id bigint, dist double"


def packed(vectors: DataFrame, prefix: str, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """Blocks of vectors(id bigint, vector): one row for each `block` rows of a partition and each length of vector.

    With the name of a key (bigint), vectors(id, vector, key) are sorted by it in their partitions, and blocks are of one key each.
    """

    def flush(ids: list[np.ndarray], rows: list[np.ndarray], width: int, own: int | None) -> pa.RecordBatch:
        columns = [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(rows).tobytes()], pa.binary()), pa.array([width], pa.int32())]
        names = [f"{prefix}ids", f"{prefix}values", f"{prefix}width"]
        return pa.RecordBatch.from_arrays(columns + [pa.array([own], pa.int64())] * bool(key), names + [key] * bool(key))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.RecordBatch]]:
        for batch in batches:
            if not key:
                yield None, batch
                continue
            own = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield int(own[a]), batch.slice(a, b - a)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        last = None
        for own, batch in runs(batches):
            if own != last:
                for width, part in held.items():
                    yield flush(*part, width, last)
                held, last = {}, own
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.values)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            starts = np.cumsum(sizes) - sizes
            for width in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == width)
                values = flat[starts[rows][:, None] + np.arange(width)]
                for a in range(0, len(rows), block):
                    part = held.setdefault(width, ([], []))
                    part[0].append(ids[rows[a : a + block]].astype(np.int64))
                    part[1].append(values[a : a + block].astype(np.float64))
                    if sum(map(len, part[0])) >= block:
                        yield flush(*held.pop(width), width, own)
        for width, part in held.items():
            yield flush(*part, width, last)

    rows = vectors.toDF("id", "vector", *([key] if key else [])).where("id is not null and vector is not null and not exists(vector, x -> x is null)")
    columns = [F.col("id").cast("bigint"), F.col("vector").cast("array<double>")]
    if not key:
        return rows.select(*columns).mapInArrow(work, _PACKED.format(p=prefix))
    rows = rows.select(*columns, F.col(key).cast("bigint").alias(key)).where(F.col(key).isNotNull())
    rows = rows.repartition(key, F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions(key)  # a large key's rows are spread
    return rows.mapInArrow(work, _PACKED.format(p=prefix) + f", {key} bigint")


def _matrix(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    get = lambda c: batch.column(batch.schema.get_field_index(prefix + c))[i]
    return np.frombuffer(get("ids").as_buffer(), np.int64), np.frombuffer(get("values").as_buffer(), np.float64).reshape(-1, get("width").as_py())


def distances(q: np.ndarray, v: np.ndarray, metric: str, digits: int = 6) -> np.ndarray:
    """Rounded distances of all rows of q and v; cosine of a vector without length is 1, dot is negated."""
    if metric == "l2":
        size = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :]
        d = q @ v.T
        d *= -2
        d += size
        near = d < 1e-5 * size  # where the product cancels, differences are exact: equal vectors are at 0
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        r, c = np.nonzero(near)
        for a in range(0, len(r), 1 << 16):
            i, j = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
            d[i, j] = np.sqrt(((q[i] - v[j]) ** 2).sum(axis=1))
    elif metric == "dot":
        d = -(q @ v.T)
    elif metric == "cosine":
        nq, nv = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        scale = np.outer(nq, nv)
        d = 1 - np.divide(q @ v.T, scale, out=np.zeros_like(scale), where=scale > 0)
    else:
        raise ValueError(f"unknown metric {metric!r}; known: cosine, l2, dot")
    return np.round(d, digits) + 0.0


def blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every packed block of left (q_) beside every one of right (v_)."""
    return left.repartition("q_ids").crossJoin(right.repartition("v_ids"))


def keyed_blocks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every packed block of left (q_) beside those of right (v_) with the same key; a large key's blocks on the right go to up to `PARTS` tasks."""
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return left.join(right.withColumn("part", F.pmod(F.xxhash64("v_ids"), F.lit(PARTS)).cast("int")), [key, "part"]).drop("part")


def searched(pairs: DataFrame, metric: str, k: int | None = None, radius: float | None = None, key: str | None = None) -> DataFrame:
    """query_id, id, dist (and key) within pairs of blocks: each query's k nearest of each block, or all within the radius."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, q = _matrix(batch, i, "q_")
                vid, v = _matrix(batch, i, "v_")
                if q.shape[1] != v.shape[1]:
                    continue
                step = max(1, (1 << 20) // max(1, len(v)))
                for a in range(0, len(q), step):
                    d = distances(q[a : a + step], v, metric)
                    if radius is not None:
                        r, c = np.nonzero(d <= radius)
                    else:
                        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
                        r, c = np.nonzero(d <= kth)  # all that tie with the k-th
                        order = np.lexsort((vid[c], d[r, c], r))
                        r, c = r[order], c[order]
                        nth = np.arange(len(r)) - np.searchsorted(r, r)
                        r, c = r[nth < k], c[nth < k]
                    columns = [pa.array(qid[a + r]), pa.array(vid[c]), pa.array(d[r, c])]
                    if key:
                        columns.append(pa.array(np.full(len(r), batch.column(batch.schema.get_field_index(key))[i].as_py(), np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "dist"] + [key] * bool(key))

    return pairs.mapInArrow(work, PAIRS + (f", {key} bigint" if key else ""))


def _crossed(queries: DataFrame, vectors: DataFrame, metric: str, k: int | None, radius: float | None, block: int) -> DataFrame:
    return searched(blocks(packed(queries, "q_", block), packed(vectors, "v_", block)), metric, k, radius)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, dist: the k nearest of pairs(query_id, id, dist)."""
    by = Window.partitionBy("query_id").orderBy("dist", "id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, dist: the exact k nearest vectors(id, vector) of each row of queries(id, vector)."""
    return nearest(_crossed(queries, vectors, metric, k, None, block), k)


def range_search(queries: DataFrame, vectors: DataFrame, radius: float, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """query_id, id, dist of all pairs within the radius."""
    return _crossed(queries, vectors, metric, None, radius, block)


def range_limited(pairs: DataFrame, limit: int) -> DataFrame:
    """query_id, rank, id, dist, count, limited: at most `limit` rows a query, the nearest; 0 is no limit.

    count is the number of rows given, limited whether it reaches the limit.
    """
    out = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id")))
    if limit > 0:
        out = out.where(F.col("rank") <= limit)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return out.withColumn("count", n).withColumn("limited", F.lit(limit > 0) & (F.col("count") >= limit)).select("query_id", "rank", "id", "dist", "count", "limited")


def matches(metadata: str, wanted: dict[str, object]) -> F.Column:
    """AND of metadata[key] = value; a missing key is false, no conditions are true."""
    found = F.lit(True)
    for key, value in wanted.items():
        found &= F.coalesce(F.try_element_at(F.col(metadata), F.lit(key)) == F.lit(str(value)), F.lit(False))
    return found


# --- candidates


def probes(k: int, clusters: int, overlap: float = 0.2) -> int:
    """Clusters to search: the root of their number, and more by the overlap."""
    return max(1, min(clusters, math.ceil(math.sqrt(clusters) * (1 + overlap))))


def centroids_of(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster_id, centroid, size: mean vectors of vectors(id, vector) by assignments(id, cluster_id)."""
    rows = vectors.toDF("id", "vector").join(assignments, "id")
    each = rows.select("cluster_id", F.posexplode(F.col("vector").cast("array<double>")).alias("d", "x"))
    mean = each.groupBy("cluster_id", "d").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("size"))
    return mean.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"), F.max("size").alias("size"))


def assigned(vectors: DataFrame, centroids: DataFrame, n: int = 1, metric: str = "l2") -> DataFrame:
    """id, cluster_id, rank, dist: the n nearest of centroids(cluster_id, centroid) for each vector."""
    near = knn(vectors, centroids.select("cluster_id", "centroid"), n, metric)
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("cluster_id"), "rank", "dist")


def knn_ivf(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 4, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """Approximate k nearest: the vectors of the nprobe clusters whose centroids are nearest to a query, re-ranked exactly.

    Queries and vectors are packed by cluster, and blocks of the same cluster meet, so that no task holds a cluster whole.
    """
    queries, vectors = queries.toDF("id", "vector"), vectors.toDF("id", "vector")
    probed = assigned(queries, centroids, nprobe, metric).join(queries, "id").select("id", "vector", "cluster_id")
    owned = assigned(vectors, centroids, 1, metric).join(vectors, "id").select("id", "vector", "cluster_id")
    pairs = keyed_blocks(packed(probed, "q_", block, "cluster_id"), packed(owned, "v_", block, "cluster_id"), "cluster_id")
    return nearest(searched(pairs, metric, k), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, hits, recall for each query of truth; both are (query_id, id)."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    out = hit.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return out.select("query_id", "hits", F.round(F.col("hits") / F.least(F.lit(k), F.col("n")), 6).alias("recall"))
