"""Scalar and product quantization, and two-stage search over codes.

Codes are arrays of integers.  Null vectors have null codes.  Training statistics are aggregated over all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.operators import clustering
from quern.operators import knn as K

BINS = 4096


def ranges(vectors: DataFrame, clip: float = 0.01) -> DataFrame:
    """d, lo, hi for each dimension of vectors(id, vector): the values at place max(1, n * clip) from either end.

    Values are counted in `BINS` bins of each dimension's range; only those of the two bins that hold the places are sorted, by their counts.
    """
    each = vectors.toDF("id", "vector").where("vector is not null").select(F.posexplode(F.col("vector").cast("array<double>")).alias("d", "x")).where("x is not null")
    span = each.groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n"))
    at = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * clip)), F.col("n") - 1).cast("bigint")
    span = span.select("d", "least", "most", at.alias("lo_at"), F.greatest(F.lit(0), F.col("n") - 1 - at).alias("hi_at"))
    place = F.when(F.col("most") > F.col("least"), F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("least")) / (F.col("most") - F.col("least")) * BINS))).otherwise(0).cast("int")
    binned = each.join(F.broadcast(span), "d").withColumn("bin", place)  # a row for each dimension
    counts = binned.groupBy("d", "bin", "lo_at", "hi_at").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("d").orderBy("bin"))
    counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    inside = lambda k: (F.col("before") <= F.col(k)) & (F.col("upto") > F.col(k))
    wanted = counts.where(inside("lo_at") | inside("hi_at")).select("d", "bin", "before")
    run = binned.join(F.broadcast(wanted), ["d", "bin"]).groupBy("d", "bin", "before", "lo_at", "hi_at", "x").agg(F.count(F.lit(1)).alias("c"))  # two bins a dimension
    run = run.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("d", "bin").orderBy("x"))).withColumn("before", F.col("upto") - F.col("c"))
    return run.groupBy("d").agg(F.max(F.when(inside("lo_at"), F.col("x"))).alias("lo"), F.max(F.when(inside("hi_at"), F.col("x"))).alias("hi"))


def packed_ranges(table: DataFrame) -> DataFrame:
    """One row: lows and highs as arrays by dimension."""
    both = F.array_sort(F.collect_list(F.struct("d", "lo", "hi")))
    return table.agg(both.alias("r")).select(F.transform("r", lambda s: s["lo"]).alias("lows"), F.transform("r", lambda s: s["hi"]).alias("highs"))


def encode(vector: Column, lows: Column, highs: Column, bits: int = 8) -> Column:
    """floor((x - lo) * (2**bits - 1) / (hi - lo) + 0.5), clipped to the levels; 1 stands for a range without width."""
    top = (1 << bits) - 1

    def one(x: Column, i: Column) -> Column:
        lo, hi = F.get(lows, i), F.get(highs, i)
        scale = F.when(hi > lo, F.lit(float(top)) / (hi - lo)).otherwise(F.lit(1.0))
        clipped = F.greatest(lo, F.least(hi, x))
        return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((clipped - lo) * scale + 0.5))).cast("int")

    return F.transform(D.as_double(vector), one)


def decode(code: Column, lows: Column, highs: Column, bits: int = 8) -> Column:
    top = (1 << bits) - 1

    def one(c: Column, i: Column) -> Column:
        lo, hi = F.get(lows, i), F.get(highs, i)
        return lo + c / F.when(hi > lo, F.lit(float(top)) / (hi - lo)).otherwise(F.lit(1.0))

    return F.transform(code, one)


def mse(a: Column, b: Column) -> Column:
    return D.squared_l2(a, b) / F.size(a)


def ratio(dimension: int, bits: int) -> float:
    """Bytes of floats over bytes of codes of `bits` in all."""
    return 4 * dimension / -(-bits // 8)


def pack_bits(code: Column, bits: int = 4) -> Column:
    """Two 4-bit codes in a byte, the first in the low half, as hexadecimal digits; or one of 8 bits."""
    if bits == 8:
        return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    if bits != 4:
        raise ValueError("4 or 8 bits")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(code) / 2).cast("int") - 1)), lambda i: F.get(code, 2 * i) + 16 * F.coalesce(F.get(code, 2 * i + 1), F.lit(0)))
    return F.array_join(F.transform(pairs, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def unpack_bits(packed: Column, size: Column, bits: int = 4) -> Column:
    width = bits // 4
    digit = lambda i: F.conv(F.substring(packed, i, F.lit(width)), 16, 10).cast("int")
    if bits == 8:
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: digit(2 * i + 1))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: digit(F.when(i % 2 == 0, i + 2).otherwise(i)))


def knn_two_stage(queries: DataFrame, vectors: DataFrame, k: int = 10, bits: int = 8, factor: int = 4, block: int = K.BLOCK) -> DataFrame:
    """query_id, rank, id, dist: k * factor candidates by L2 distance of decoded codes, then the k nearest of them by exact distance.

    Blocks hold codes beside vectors: a product with the codes' levels in single precision gives all approximate distances of two blocks, and only
    the candidates of each block are compared exactly, where they are.
    """
    most = max(10, min(100 * k, k * factor))
    r = packed_ranges(ranges(vectors)).first()
    lows, highs = (np.array(r[c] or [], np.float64) for c in ("lows", "highs"))
    top = (1 << bits) - 1
    scale = np.where(highs > lows, top / np.where(highs > lows, highs - lows, 1), 1.0)
    kind = np.uint8 if bits <= 8 else np.uint16

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for i in range(batch.num_rows):
                _, v = K._matrix(batch, i, "v_")
                codes.append(np.clip(np.floor((np.clip(v, lows, highs) - lows) * scale + 0.5), 0, top).astype(kind).tobytes() if v.shape[1] == len(lows) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "v_codes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, q = K._matrix(batch, i, "q_")
                vid, v = K._matrix(batch, i, "v_")
                raw = batch.column(batch.schema.get_field_index("v_codes"))[i].as_buffer()
                if q.shape[1] != v.shape[1] or not len(raw):
                    continue
                code = np.frombuffer(raw, kind).reshape(v.shape)
                # |q - (lo + code / scale)|^2 without |q - lo|^2, which is the same for all of a query's candidates
                level = (code / scale).astype(np.float32)
                size = (level * level).sum(axis=1)
                moved = q - lows
                for a in range(0, len(q), 1024):
                    near = (moved[a : a + 1024].astype(np.float32) @ level.T) * np.float32(-2) + size
                    c = np.argpartition(near, most - 1, axis=1)[:, :most] if len(v) > most else np.broadcast_to(np.arange(len(v)), near.shape)
                    rows = np.repeat(np.arange(len(near)), c.shape[1])
                    c = c.ravel()
                    exact = np.round(np.sqrt(((q[a + rows] - v[c]) ** 2).sum(axis=1)), 6) + 0.0
                    rough = near[rows, c].astype(np.float64) + (moved[a + rows] ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[a + rows]), pa.array(vid[c]), pa.array(rough), pa.array(exact)], ["query_id", "id", "rough", "dist"])

    left, right = K.packed(queries, "q_", block), K.packed(vectors, "v_", block)
    right = right.mapInArrow(coded, K._PACKED.format(p="v_") + ", v_codes binary")
    rows = K.blocks(left, right).mapInArrow(work, "query_id bigint, id bigint, rough double, dist double")
    by = F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "id"))
    return K.nearest(rows.withColumn("nth", by).where(F.col("nth") <= most).select("query_id", "id", "dist"), k)


def subvector(vector: Column, m: int, parts: int) -> Column:
    width = F.floor(F.size(vector) / parts).cast("int")
    return F.slice(vector, width * m + 1, width)


def parts_for(dimension: int) -> int:
    """Subvectors: 16 from 128 dimensions on, 8 from 64 on, else 4, where they divide the dimension."""
    return next((m for m in (16 if dimension >= 128 else 8 if dimension >= 64 else 4, 8, 4, 2) if dimension % m == 0), 1)


def train_pq(vectors: DataFrame, dimension: int, bits: int = 4, seed: int = 42) -> DataFrame:
    """m, k, centroid: a k-means of 2**bits centroids for each subvector."""
    parts = parts_for(dimension)
    rows = vectors.toDF("id", "vector").where(F.size("vector") == dimension)
    out = None
    for m in range(parts):
        c = clustering.fit(rows.select("id", subvector(F.col("vector"), m, parts)), 1 << bits, seed).select(F.lit(m).alias("m"), F.col("cluster_id").cast("int").alias("k"), "centroid")
        out = c if out is None else out.unionByName(c)
    return out


def pq_codes(vectors: DataFrame, codebook: DataFrame, parts: int) -> DataFrame:
    """id, code: for each subvector the nearest centroid of codebook(m, k, centroid), ties to the lower.  The book is one row."""
    book = book_of(codebook)

    def one(m: Column) -> Column:
        sub = F.slice(F.col("vector"), F.floor(F.size("vector") / parts).cast("int") * m + 1, F.floor(F.size("vector") / parts).cast("int"))
        d = F.transform(F.get(F.col("book"), m), lambda c: D.round6(D.squared_l2(sub, c)))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    rows = vectors.toDF("id", "vector").where("vector is not null").crossJoin(F.broadcast(book))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), one).alias("code"))


def pq_decode(code: Column, book: Column) -> Column:
    """The vector that a code stands for: its centroids of book(m, k, value), one after another."""
    return F.flatten(F.transform(code, lambda c, m: F.get(F.get(book, m), c)))


def table_of(query: Column, book: Column, parts: int) -> Column:
    """The asymmetric distance table of a query: for each subvector the squared L2 distance to each of its centroids."""
    width = F.floor(F.size(query) / parts).cast("int")
    return F.transform(book, lambda c, m: F.transform(c, lambda x: D.squared_l2(F.slice(query, width * m + 1, width), x)))


def by_table(table: Column, code: Column) -> Column:
    """Squared distance of a code by the query's table: one look-up for each subvector."""
    return F.aggregate(F.transform(code, lambda c, m: F.get(F.get(table, m), c)), F.lit(0.0), lambda a, x: a + x)


def asymmetric(query: Column, code: Column, book: Column, parts: int) -> Column:
    """Sum over subvectors of the squared L2 distance of the query's part to the code's centroid."""
    return by_table(table_of(query, book, parts), code)


def symmetric(a: Column, b: Column, book: Column) -> Column:
    """Sum over subvectors of the squared L2 distance of two codes' centroids."""
    each = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, m: D.squared_l2(F.get(F.get(book, m), x["a"]), F.get(F.get(book, m), x["b"])))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x)


def pq_pairs(queries: DataFrame, vectors: DataFrame, codebook: DataFrame, parts: int, block: int = K.BLOCK) -> DataFrame:
    """query_id, id, asymmetric, symmetric of every query and every vector: squared distances of its values, and of its own code, to the vector's code.

    The book passes through the driver.  A query's table holds both distances for each subvector and centroid; its product with blocks of codes, as
    ones in the places of their centroids, gives those of all pairs of two blocks.
    """
    book = [[list(map(float, c)) for c in cs] for cs in (book_of(codebook).first() or [None])["book"] or []]
    most = max(map(len, book), default=0)

    def coded(x: np.ndarray, width: int) -> np.ndarray:
        """The same codes as those of `pq_codes`."""
        each = [np.round(((x[:, None, m * width : (m + 1) * width] - np.array(cs)) ** 2).sum(axis=2), 6).argmin(axis=1) for m, cs in enumerate(book)]
        return np.stack(each, axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(parts) * most
        for batch in batches:
            for i in range(batch.num_rows):
                qid, q = K._matrix(batch, i, "q_")
                vid, v = K._matrix(batch, i, "v_")
                width = q.shape[1] // parts
                if not book or v.shape[1] != q.shape[1] or width != len(book[0][0]):
                    continue
                own, code = coded(q, width), coded(v, width)
                near, far = np.zeros((len(q), parts * most)), np.zeros((len(q), parts * most))
                for m, cs in enumerate(book):
                    c = np.array(cs)
                    near[:, m * most : m * most + len(c)] = ((q[:, None, m * width : (m + 1) * width] - c) ** 2).sum(axis=2)
                    far[:, m * most : m * most + len(c)] = ((c[own[:, m]][:, None] - c) ** 2).sum(axis=2)
                ones = np.zeros((parts * most, len(code)))
                ones[at + code, np.arange(len(code))[:, None]] = 1
                step = max(1, (1 << 18) // max(1, len(code)))
                for a in range(0, len(q), step):
                    found = [np.round(t[a : a + step] @ ones, 6).ravel() + 0.0 for t in (near, far)]
                    rows = len(found[0]) // len(code)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[a : a + rows], len(code))), pa.array(np.tile(vid, rows)), *map(pa.array, found)], ["query_id", "id", "asymmetric", "symmetric"])

    pairs = K.blocks(K.packed(queries, "q_", block), K.packed(vectors, "v_", block))
    return pairs.mapInArrow(work, "query_id bigint, id bigint, asymmetric double, symmetric double")


def book_of(codebook: DataFrame) -> DataFrame:
    """One row: book, the centroids of codebook(m, k, centroid) as an array by m and k."""
    book = codebook.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "centroid"))), lambda s: s["centroid"]).alias("c"))
    return book.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "c"))), lambda s: s["c"]).alias("book"))


def validation(vectors: DataFrame, codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """One row: vectors, mse (mean squared error a value of the decoded vectors), mean_error and max_error (of their L2 distance to the originals)."""
    rows = vectors.toDF("id", "vector").join(codes.select("id", "code"), "id").crossJoin(F.broadcast(book_of(codebook)))  # one book
    gap = D.squared_l2(F.col("vector"), pq_decode(F.col("code"), F.col("book")))
    rows = rows.select(gap.alias("g"), F.size("vector").alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("vectors"), D.round6(F.avg(F.col("g") / F.col("n"))).alias("mse"), D.round6(F.avg(F.sqrt("g"))).alias("mean_error"), D.round6(F.max(F.sqrt("g"))).alias("max_error"))


def recommend(dimension: int, bytes_per_vector: float | None = None) -> dict[str, object]:
    """Scalar quantization up to 64 dimensions, product quantization above; bits as the budget allows."""
    if dimension <= 64:
        bits = 8 if bytes_per_vector is None else max(1, min(8, int(bytes_per_vector * 8 / dimension)))
        return {"kind": "scalar", "bits": bits, "ratio": ratio(dimension, dimension * bits)}
    parts = parts_for(dimension)
    bits = 8 if bytes_per_vector is None else max(1, min(8, int(bytes_per_vector * 8 / parts)))
    return {"kind": "product", "bits": bits, "parts": parts, "ratio": ratio(dimension, parts * bits)}
