"""Exact duplicates by composable polynomial fingerprints.

A text's bytes b_1..b_n have the fingerprint sum(b_i * B**(n-i)) modulo three primes
below 2**31, with one base for each.  Fingerprints compose: of x followed by y it
is f(x) * B**len(y) + f(y), so chunks are hashed in parallel and combined by
length-shifted arithmetic (`combine`).  A text of more than `HUGE` bytes is cut in chunk rows, which
go to all tasks to be hashed, and `combine_chunks` makes its fingerprint of theirs.  A chunk is hashed as rows of a matrix product in doubles,
which is exact: 1,024 bytes times powers below 2**31 stay below 2**53.

Rows of one fingerprint and length are candidates only.  Their texts are cut in chunks of `CHUNK` bytes, and chunks of one
place and fingerprint are streamed past the first of them, so no task holds a whole text or group.
A chunk's class is the row that first had these bytes; rows are equal where all their chunks' classes are.

Null texts are no one's duplicates.  Empty texts are duplicates of one another.
Rows repeated with the same doc_id are duplicates.  The row with the lowest
doc_id is kept; a null doc_id comes after all others.  Other columns don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import stored
from quern.llm.textvec import hold, slices

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1664525 + (1 << 29), 22695477 + (1 << 30))
PIECE = 1024
CHUNK = 1 << 18
HUGE = 1 << 20
_P = np.array(PRIMES, np.uint64)
_rows = np.array([[pow(b, PIECE - 1 - i, p) for b, p in zip(BASES, PRIMES)] for i in range(PIECE)], np.float64)
_shift = np.ones((1, 3), np.uint64)  # powers of B**PIECE


def _shifts(n: int) -> np.ndarray:
    global _shift
    if len(_shift) < n:
        step = [pow(b, PIECE, p) for b, p in zip(BASES, PRIMES)]
        more = [[int(x) for x in _shift[-1]]]
        for _ in range(max(n, 2 * len(_shift)) - len(_shift)):
            more.append([x * s % p for x, s, p in zip(more[-1], step, PRIMES)])
        _shift = np.concatenate([_shift, np.array(more[1:], np.uint64)])
    return _shift[:n]


def combine(first: tuple[int, ...], second: tuple[int, ...], second_length: int) -> tuple[int, ...]:
    """The fingerprint of a concatenation from those of its parts."""
    return tuple((f * pow(b, second_length, p) + g) % p for f, g, b, p in zip(first, second, BASES, PRIMES))


def fingerprints(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte ranges [at[i], at[i+1]) of raw: one row of three numbers each.

    Pieces end where their text ends, and zeros before its first piece change nothing.
    """
    lengths = np.diff(at)
    pieces = (lengths + PIECE - 1) // PIECE
    grid = np.zeros(int(pieces.sum()) * PIECE, np.uint8)
    end = np.cumsum(pieces) * PIECE
    for a, b, e in zip(at[:-1].tolist(), at[1:].tolist(), end.tolist()):
        grid[e - (b - a) : e] = raw[a:b]
    grid = grid.reshape(-1, PIECE)
    hashed = np.empty((len(grid), 3), np.uint64)
    for a in range(0, len(grid), 2048):
        hashed[a : a + 2048] = (grid[a : a + 2048].astype(np.float64) @ _rows).astype(np.uint64) % _P
    out = np.zeros((len(lengths), 3), np.uint64)
    some = pieces > 0
    if some.any():
        n = pieces[some]
        starts = np.cumsum(n) - n
        place = np.repeat(starts + n, n) - 1 - np.arange(int(n.sum()))  # pieces after this one
        shifted = hashed * _shifts(int(n.max()))[place] % _P
        out[some] = np.add.reduceat(shifted, starts, axis=0) % _P
    return out


def fingerprint(text: bytes) -> tuple[int, ...]:
    return tuple(int(x) for x in fingerprints(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


FINGERPRINT = "doc_id bigint, n_bytes bigint, f1 bigint, f2 bigint, f3 bigint"


_KEY = ["n_bytes", "f1", "f2", "f3"]


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a large binary array points into, and the offsets of its values in them."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), at


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows(rid, chunk, data)."""
    for batch in batches:
        raw, at = _offsets(batch.column(2).cast(pa.large_binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), *map(pa.array, fingerprints(raw, at).astype(np.int64).T.copy())], ["rid", "chunk", *_KEY])


def fingerprinted(docs: DataFrame, carry: str | None = None, huge: int = HUGE) -> DataFrame:
    """rid, doc_id, n_bytes, f1, f2, f3[, carry] for each row of docs(doc_id, text[, carry]) that has a text, as a stored table; rid tells rows apart."""
    columns = ["doc_id", "text", *([carry] if carry else [])]
    extra = f", {carry} {docs.schema[carry].dataType.simpleString()}" if carry else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("exact_dedup")
        base, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for a, b in slices(texts, 8 << 20):
                part = texts.slice(a, b - a)
                raw, at = _offsets(part)
                size, rid = np.diff(at), base + n + np.arange(b - a)
                n += b - a
                whole = size <= huge
                ends = np.cumsum(np.where(whole, size, 0))
                small = raw[at[0] : at[-1]] if whole.all() else np.concatenate([raw[at[i] : at[i + 1]] for i in np.flatnonzero(whole)] or [raw[:0]])
                f = fingerprints(small, np.concatenate([[0], ends])).astype(np.int64)
                mask = ~whole
                own = [batch.column(0).slice(a, b - a), pa.nulls(b - a, pa.int32()), pa.array(size), *(pa.array(x, mask=mask) for x in f.T.copy()), pa.nulls(b - a, pa.binary()), *(c.slice(a, b - a) for c in batch.columns[2:])]
                yield pa.RecordBatch.from_arrays([pa.array(rid), *own], ["rid", "doc_id", "chunk", *_KEY, "data", *columns[2:]])
                for i in np.flatnonzero(mask).tolist():  # chunk rows, for other tasks to hash
                    for k, lo in enumerate(range(int(at[i]), int(at[i + 1]), CHUNK)):
                        data = raw[lo : min(lo + CHUNK, int(at[i + 1]))].tobytes()
                        one = [pa.array([rid[i]]), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in _KEY), pa.array([data], pa.binary()), *(pa.nulls(1, c.type) for c in batch.columns[2:])]
                        yield pa.RecordBatch.from_arrays(one, ["rid", "doc_id", "chunk", *_KEY, "data", *columns[2:]])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns[2:]).where(F.col("text").isNotNull())
    rows = stored(rows.mapInArrow(work, f"rid bigint, doc_id bigint, chunk int, n_bytes bigint, f1 bigint, f2 bigint, f3 bigint, data binary{extra}"), "fingerprints")
    out = rows.where("chunk is null").drop("chunk", "data")
    parts = rows.where("chunk is not null")
    if parts.isEmpty():
        return out
    made = parts.select("rid", "chunk", "data").repartition("rid", "chunk").mapInArrow(_hash_rows, "rid bigint, chunk int, n_bytes bigint, f1 bigint, f2 bigint, f3 bigint")
    made = combine_chunks(made.withColumnRenamed("rid", "doc_id")).withColumnRenamed("doc_id", "rid").drop("n_bytes")
    more = out.where("f1 is null").drop("f1", "f2", "f3").join(made, "rid")
    return stored(out.where("f1 is not null").unionByName(more), "fingerprints")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, f1, f2, f3 for each row of docs(doc_id, text) that has a text."""
    return fingerprinted(docs).drop("rid")


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """Fingerprints of texts stored as chunks(doc_id, chunk, n_bytes, f1, f2, f3), combined in the order of chunk.

    A text of several chunks that have the same number is undefined input and is refused.
    """

    def work(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        if pc.count_distinct(part["chunk"]).as_py() != len(part):
            raise ValueError(f"document {key[0]} has several chunks of one number")
        whole, n = (0, 0, 0), 0
        for c in part.to_pylist():
            whole, n = combine(whole, (c["f1"], c["f2"], c["f3"]), c["n_bytes"]), n + c["n_bytes"]
        return pa.table({"doc_id": [key[0].as_py()], "n_bytes": [n], "f1": [whole[0]], "f2": [whole[1]], "f3": [whole[2]]})

    return chunks.groupBy("doc_id").applyInArrow(work, FINGERPRINT)


_CHUNKS = "rid bigint, doc_id bigint, n_bytes bigint, f1 bigint, f2 bigint, f3 bigint, salt int, split boolean, chunk int, data binary"


def _chunk_rows(rows: DataFrame, size: int) -> DataFrame:
    """The chunks of rows(rid, doc_id, n_bytes, f1, f2, f3, salt, split, text), one row each; an empty text has one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(8).cast(pa.large_binary())
            n = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            short = pa.array(np.flatnonzero(n <= size))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(short) for i in range(8)), pa.array(np.zeros(len(short), np.int32)), texts.take(short).cast(pa.binary())], names)
            for i in np.flatnonzero(n > size).tolist():
                raw = texts[i].as_buffer()
                for k, lo in enumerate(range(0, len(raw), size)):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(8)), pa.array([k], pa.int32()), pa.array([raw[lo : lo + size].to_pybytes()], pa.binary())], names)

    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    return rows.select(*names[:8], "text").mapInArrow(work, _CHUNKS)


def _chunk_classes(chunks: DataFrame, *key: str) -> DataFrame:
    """chunks with rep, the rid that first, by doc_id, had the same bytes within the key; data stays where groups are split and the row is that first one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known = None, []  # of the key at hand: bytes and rid of each class
        at = [names.index(k) for k in key]
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in at], axis=1)
            rid, data = batch.column(0).to_pylist(), batch.column(9)
            rep, first = [], np.zeros(len(rid), bool)
            for i in range(len(rid)):
                if before is None or not np.array_equal(before, keys[i]):
                    before, known = keys[i], []
                own = memoryview(data[i].as_buffer()).cast("B")
                found = next((r for x, r in known if x == own), None)
                if found is None:
                    known.append((bytes(own), rid[i]))
                    first[i], found = True, rid[i]
                rep.append(found)
            stays = pc.and_(pa.array(first), batch.column(7))
            yield pa.RecordBatch.from_arrays([*batch.columns[:9], pc.if_else(stays, data, pa.scalar(None, data.type)), pa.array(rep, pa.int64())], [*names, "rep"])

    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    order = [*key, F.col("doc_id").asc_nulls_last(), "rid"]
    return chunks.repartition(*key).sortWithinPartitions(*order).select(*names).mapInArrow(work, _CHUNKS + ", rep bigint")


def classes(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """rid, doc_id, n_bytes, keep_id, copies, first of rows(rid, doc_id, n_bytes, f1, f2, f3, salt, split, text): what has equal texts; first marks one row of each class."""
    key = [*_KEY, "chunk"]
    near = stored(_chunk_classes(_chunk_rows(rows, size), *key, "salt"), "chunks")
    # a class may have a part under each salt: the parts' first chunks are compared in turn
    again = _chunk_classes(near.where("split and data is not null").drop("rep"), *key).select(*key, F.col("rid").alias("rep"), F.col("rep").alias("whole"))
    alike = near.where("not split").select("rid", "doc_id", *_KEY, "salt", "chunk", "rep")
    alike = alike.unionByName(near.where("split").drop("data").join(again, [*key, "rep"]).select("rid", "doc_id", *_KEY, "salt", "chunk", F.col("whole").alias("rep")))
    one = alike.where(F.col("n_bytes") <= size).select("rid", "doc_id", *_KEY, "salt", F.array("rep").alias("class"))
    several = alike.where(F.col("n_bytes") > size).groupBy("rid", "doc_id", *_KEY, "salt").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "rep"))), lambda x: x["rep"]).alias("class"))
    alike = stored(one.unionByName(several), "classes")
    by = alike.groupBy(*_KEY, "class", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("head"))
    w = Window.partitionBy(*_KEY, "class")
    by = by.select(*_KEY, "class", "salt", F.sum("n").over(w).alias("copies"), F.min("low").over(w).alias("keep_id"), F.min("head").over(w)["rid"].alias("head"))
    out = alike.join(by, [*_KEY, "class", "salt"])
    return out.select("rid", "doc_id", "n_bytes", "keep_id", "copies", (F.col("rid") == F.col("head")).alias("first"))


def _resolve(docs: DataFrame, row: bool, broadcast_rows: int, split_rows: int, huge: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that can't have a copy, untouched; the candidates(rid, doc_id, row); and rid, doc_id, n_bytes, keep_id, copies, first of these."""
    docs = docs.select(F.struct("*").alias("row"))
    docs = docs.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text"), *(["row"] if row else []))
    prints = fingerprinted(docs, huge=huge)
    groups = stored(prints.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    ids = stored(prints.join(groups, _KEY, "left_semi").select(F.col("doc_id").alias("c_id")).distinct(), "candidates")
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    match = F.col("doc_id").eqNullSafe(F.col("c_id"))
    texts = docs.where(F.col("text").isNotNull())
    alone = docs.where(F.col("text").isNull()).unionByName(texts.join(ids, match, "left_anti"))
    candidates = fingerprinted(texts.join(ids, match, "left_semi").withColumn("own", F.col("row" if row else "text")), "own", huge)
    parts = F.ceil(F.col("copies") / split_rows).cast("int")
    split = groups.where(F.col("copies") > split_rows).select(*_KEY, parts.alias("parts"))
    text = F.col("own.text").cast("string") if row else F.col("own")
    salted = candidates.select("rid", "doc_id", *_KEY, text.alias("text")).join(split, _KEY, "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"), F.lit(0))).withColumn("split", F.col("parts").isNotNull())
    return alone, candidates, classes(salted)


def exact_duplicates(docs: DataFrame, broadcast_rows: int = 500_000, split_rows: int = 1 << 16, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, copies, n_bytes: one row for each row of docs(doc_id, text).

    keep_id is the lowest doc_id with the same text and copies the number of rows that have it.
    A null text has itself as keep_id, copies 1 and n_bytes null.

    Only texts whose fingerprint occurs again are read a second time and shuffled.  Their ids are
    broadcast up to broadcast_rows and joined by a shuffle beyond; groups of over split_rows are
    compared in parts.
    """
    alone, _, found = _resolve(docs, False, broadcast_rows, split_rows, huge)
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    return alone.unionByName(found.select("doc_id", "keep_id", "copies", "n_bytes"))


def drop_exact_duplicates(docs: DataFrame, broadcast_rows: int = 500_000, split_rows: int = 1 << 16, huge: int = HUGE) -> DataFrame:
    """The rows of docs with the first row, by doc_id, of each text; all its columns, rows with null texts too."""
    alone, candidates, found = _resolve(docs, True, broadcast_rows, split_rows, huge)
    first = stored(found.where("first").select("rid"), "first")
    if first.count() <= broadcast_rows:
        first = F.broadcast(first)
    return alone.select("row.*").unionByName(candidates.join(first, "rid", "left_semi").select("own.*"))
