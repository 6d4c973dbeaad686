"""Near-duplicates by SimHash, compared bit-sliced.

A document's fingerprint has 256 bits, each the majority over its distinct words of a bit of
the word's hash.  Two documents are near where at most `radius` bits differ (48 of 256 is a
cosine of 0.83 of the word sets); groups are the connected components of near documents, and
the lowest doc_id of each is kept.

Equal fingerprints are joined first.  Then every fingerprint stands in `tables` of buckets, by
`bits` sampled bits each: so many tables that a pair at exactly the radius shares a bucket
of some table with probability `recall` (0.99), nearer pairs with more (at 40 bits 0.9998).  No scheme for 48 of 256 bits that can
miss none is within reach: by the pigeonhole principle it would take 49 tables of five bits.  Up to 2**27 fingerprints
there are 16 bits and 141 tables; beyond, one bit more each time their number doubles keeps buckets from growing.

Within buckets the comparison is exact and bit-sliced.  A bucket of more than `HOT` rows is cut in parts that are compared
each in itself; then all rows that aren't of the bucket's largest component so far are compared with all its
parts, so what two parts have in common is found as well.  Fingerprints are stored as bit planes,
64 to a word; a word of one plane against the same plane shifted by s places gives the bit
where 64 pairs differ.  Carry-save adders count these in vertical counters for all
pairs at once, and a block of 64 pairs is left as soon as all of them exceed the radius.  Of the
pairs found in a bucket a spanning forest goes on.

Texts that are null or without words have no fingerprint: each is kept, a group of its own.
A null doc_id is kept only in a group without any other.  Rows repeated with one doc_id are
of one group.  Texts are taken whole, and other columns don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import stored
from quern.llm.textvec import Slice, hold, mix, slices, spread

BITS = 256
RADIUS = 48
RECALL = 0.99
_FP = ["p0", "p1", "p2", "p3"]
_FP_TYPE = "p0 bigint, p1 bigint, p2 bigint, p3 bigint"
_TASKS = 1 << 14
_BLOCK = 1 << 15
HOT = 1 << 15  # rows of a bucket from which on it is cut in parts


def _lanes() -> np.ndarray:
    """For each byte its bits, one in each byte of a word: such words count eight bits by one addition."""
    v = np.arange(256, dtype=np.uint64)
    out = np.zeros(256, np.uint64)
    for b in range(8):
        out |= (v >> np.uint64(b) & np.uint64(1)) << np.uint64(8 * b)
    return out


_LANES = _lanes()
_RUN = 255  # words that a lane can count


def simhashes(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts of a slice as rows of four words, and whether each has any words."""
    h, _, doc = part.words()
    out = np.zeros((part.n, 4), np.uint64)
    if not len(h):
        return out, np.zeros(part.n, bool)
    _, once = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    once.sort()
    h, doc = h[once], doc[once]
    n = np.bincount(doc, minlength=part.n)
    salts = [np.uint64(k * 0x5851F42D4C957F2D % (1 << 64)) for k in range(1, 5)]
    run = np.flatnonzero((np.arange(len(h)) - (np.cumsum(n) - n)[doc]) % _RUN == 0)  # where runs of one text begin
    counts = np.zeros((len(run), BITS), np.uint8)
    a = 0
    while a < len(run):
        b = max(a + 1, int(np.searchsorted(run, run[a] + (1 << 14))))
        lo, hi = run[a], run[b] if b < len(run) else len(h)
        hashed = np.stack([mix(h[lo:hi] + s) for s in salts], 1).view(np.uint8)
        counts[a:b] = np.add.reduceat(_LANES[hashed], run[a:b] - lo, axis=0).view(np.uint8)
        a = b
    of = doc[run]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    ones = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    out[of[first]] = np.packbits(2 * ones > n[of[first], None], axis=1, bitorder="little").view(np.uint64)
    return out, n > 0


def with_simhashes(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, p0..p3 (null without words) of docs(doc_id, text[, carry])."""
    columns = ["doc_id", "text", *([carry] if carry else [])]
    extra = f", {carry} {docs.schema[carry].dataType.simpleString()}" if carry else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash")
        for batch in batches:
            for a, b in slices(batch.column(1)):
                fp, has = simhashes(Slice(batch.column(1).slice(a, b - a)))
                words = [pa.array(x.view(np.int64), mask=~has) for x in fp.T.copy()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *words, *(c.slice(a, b - a) for c in batch.columns[2:])], ["doc_id", *_FP, *columns[2:]])

    return docs.select(*columns).mapInArrow(work, f"doc_id bigint, {_FP_TYPE}{extra}")


def sampled_bits(tables: int, bits: int, seed: int = 20) -> np.ndarray:
    """Which bits make the key of each table: successive parts of shuffled bits, so that bits serve evenly."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < tables:
        order = rng.permutation(BITS)
        rows += [order[i : i + bits] for i in range(0, BITS - bits + 1, bits)]
    return np.array(rows[:tables])


def plan(n: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """Tables and sampled bits for n fingerprints: 16 bits, and one more each time n doubles from 2**27 on."""
    bits = min(60, max(16, math.ceil(math.log2(max(1, n) / 2048))))
    same = math.comb(BITS - radius, bits) / math.comb(BITS, bits)  # distinct bits, none of which differs
    return math.ceil(math.log(1 - recall) / math.log(1 - same)), bits


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds the radius."""
    more, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            more |= equal & counter[i]
            equal &= ~counter[i]
    return more


def near_in_buckets(fp: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket within the radius; fp has the buckets of `sizes` one after another."""
    n = len(fp)
    words = (n + 63) // 64
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    planes = np.zeros((BITS, words + 2), np.uint64)
    planes[:, :words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    reach = np.zeros(words * 64, np.int64)
    reach[:n] = ends - np.arange(n)  # shifts below it stay in the bucket
    reach = reach.reshape(words, 64)
    planes = np.concatenate([planes, np.zeros((BITS, int(reach.max(initial=1)) // 64 + 2), np.uint64)], axis=1)
    most = np.maximum(reach.max(axis=1) - 1, 0)
    last = np.cumsum(most)
    for lo in range(0, int(last[-1]) if words else 0, _TASKS):
        task = np.arange(lo, min(lo + _TASKS, int(last[-1])))
        w = np.searchsorted(last, task, "right")
        s = task - (last[w] - most[w]) + 1
        alive = np.packbits(reach[w] > s[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        q, r = w + (s >> 6), (s & 63).astype(np.uint64)
        counter = [np.zeros(len(w), np.uint64) for _ in range(9)]
        for k in range(0, BITS, 8):
            left = np.uint64(64) - r
            x = [planes[p][w] ^ ((planes[p][q] >> r) | np.where(r == 0, np.uint64(0), planes[p][q + 1] << (left & np.uint64(63)))) for p in range(k, k + 8)]
            ones, a = _csa(counter[0], x[0], x[1])
            ones, b = _csa(ones, x[2], x[3])
            twos, c = _csa(counter[1], a, b)
            ones, a = _csa(ones, x[4], x[5])
            ones, b = _csa(ones, x[6], x[7])
            twos, d = _csa(twos, a, b)
            fours, carry = _csa(counter[2], c, d)
            counter[0], counter[1], counter[2] = ones, twos, fours
            for i in range(3, 9):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            if k + 8 > radius and (k + 8 >= 96 or k + 8 == BITS) and k % 16 == 8:
                alive &= ~_over(counter, radius)
                keep = alive != 0
                if not keep.any():
                    w = w[:0]
                    break
                if keep.mean() < 0.7:
                    w, s, q, r, alive = w[keep], s[keep], q[keep], r[keep], alive[keep]
                    counter = [x[keep] for x in counter]
        if len(w):
            t, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = w[t] * 64 + lane
            yield i, i + s[t]


def forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label with the components of pairs i, j joined: the least row of each."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _bucket_edges(rows: DataFrame, radius: int) -> DataFrame:
    """a, b: a spanning forest of the near pairs in each bucket, or part of one, of rows(key, part, node, p0..p3)."""

    def edges(all_: np.ndarray) -> pa.RecordBatch:
        node, fp = all_[:, 2], all_[:, 3:].view(np.uint64)
        change = np.flatnonzero(np.concatenate([[True], (all_[1:, :2] != all_[:-1, :2]).any(axis=1)]))
        sizes = np.diff(np.append(change, len(all_)))
        by = np.argsort(sizes, kind="stable")
        by = by[sizes[by] > 1]
        rows = spread(change[by], sizes[by])
        label = np.arange(len(rows))
        if len(rows):
            for i, j in near_in_buckets(fp[rows], sizes[by], radius):
                label = forest(len(rows), i, j, label)
        low = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(node[rows[low]]), pa.array(node[rows[label[low]]])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash")
        held: list[np.ndarray] = []  # key, part, node and fingerprint in rows of seven
        n = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            n += batch.num_rows
            if n >= _BLOCK and (held[0][0, :2] != held[-1][-1, :2]).any():  # the last bucket may go on
                all_ = np.concatenate(held)
                cut = int(np.flatnonzero((all_[:, :2] != all_[-1, :2]).any(axis=1))[-1]) + 1
                yield edges(all_[:cut])
                held, n = [all_[cut:].copy()], len(all_) - cut
        if n:
            yield edges(np.concatenate(held))

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "node", *_FP).mapInArrow(work, "a bigint, b bigint")


def _hot(nodes: DataFrame, tables: int, bits: int, hot: int) -> DataFrame:
    """key, parts of buckets with about `hot` rows and more, by one fingerprint of 64; how a bucket is cut changes no result."""
    some = _keys(nodes.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0), tables, bits)
    size = F.count(F.lit(1)) * 64
    return some.groupBy("key").agg(size.alias("size")).where(F.col("size") >= hot).select("key", F.ceil(F.col("size") / hot).cast("bigint").alias("parts"))


def _across(rows: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """a, b: the near pairs of rows(key, part, parts, node, p0..p3), buckets cut in parts, that are in different components by roots(node, root).

    Of each bucket one component, its largest, isn't compared with itself; all other rows are compared with every part.  So a bucket
    filled by one group of copies takes time in proportion to its rows.
    """
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"))
    rows = stored(rows.join(by, "key").withColumn("minor", F.col("root") != F.col("major")), "hot")
    minor = rows.where("minor").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("bigint").alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    here = rows.join(minor, "key").select("key", "part", every(F.col("blocks")).alias("block"), F.lit(False).alias("asks"), "node", "root", *_FP)
    asks = rows.where("minor").join(minor, "key").select("key", every(F.col("parts")).alias("part"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.lit(True).alias("asks"), "node", "root", *_FP)

    def work(part: pa.Table) -> pa.Table:
        node, root = part["node"].to_numpy(), part["root"].to_numpy()
        fp = np.stack([part[c].to_numpy() for c in _FP], axis=1).view(np.uint64)
        asks = part["asks"].to_numpy(zero_copy_only=False)
        q, v, out = np.flatnonzero(asks), np.flatnonzero(~asks), [np.zeros((0, 2), np.int64)]
        for a in range(0, len(q), 256):
            mine = q[a : a + 256]
            for b in range(0, len(v), 4096):
                own = v[b : b + 4096]
                differ = np.zeros((len(mine), len(own)), np.uint16)
                for k in range(4):
                    differ += np.bitwise_count(fp[mine, None, k] ^ fp[None, own, k])
                i, j = np.nonzero((differ <= radius) & (root[mine][:, None] != root[own][None, :]))
                out.append(np.stack([node[mine[i]], node[own[j]]], axis=1))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return here.unionByName(asks).groupBy("key", "part", "block").applyInArrow(work, "a bigint, b bigint")


def _keys(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """key, node, p0..p3: each node once in every table."""
    chosen = sampled_bits(tables, bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # each makes `tables` rows
                part = batch.slice(a, 500)
                fp = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1)
                set_ = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
                keys = np.stack([mix(set_[:, c].astype(np.uint64) @ weights + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for t, c in enumerate(chosen)])
                again = pa.array(np.tile(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(c.take(again) for c in part.columns)], ["key", "node", *_FP])

    return nodes.select("node", *_FP).mapInArrow(work, f"key bigint, node bigint, {_FP_TYPE}")


def _groups(prints: DataFrame, radius: int, recall: float, hot: int = HOT) -> DataFrame:
    """p0..p3, root for every fingerprint of prints(doc_id, p0..p3)."""
    own = F.coalesce(F.min("doc_id"), -F.abs(F.xxhash64(*_FP)))  # a node of its own where all its ids are null
    nodes = stored(prints.where("p0 is not null").groupBy(*_FP).agg(own.alias("node")), "nodes")
    # one doc_id may stand for several texts: nodes are told apart by fingerprint then
    several = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not several.isEmpty():
        nodes = nodes.join(several.withColumn("twice", F.lit(True)), "node", "left").select(F.when(F.col("twice"), -F.abs(F.xxhash64(*_FP))).otherwise(F.col("node")).alias("node"), *_FP)
        nodes = stored(nodes, "nodes")
    shape = plan(nodes.count(), radius, recall)
    keys = _keys(nodes, *shape)
    large = stored(_hot(nodes, *shape, hot), "hot")
    if large.isEmpty():
        roots = components(_bucket_edges(keys.withColumn("part", F.lit(0).cast("bigint")), radius))
    else:
        part = F.pmod(F.xxhash64("node", "key"), F.coalesce("parts", F.lit(1).cast("bigint")))
        cut = keys.join(large, "key", "left").withColumn("part", part)
        edges = stored(_bucket_edges(cut, radius), "near")
        again = _across(cut.where("parts > 1"), components(edges), radius)
        roots = components(edges.unionByName(again))
    return nodes.join(roots, "node", "left").select(*_FP, F.coalesce("root", "node").alias("root"))


def _resolved(prints: DataFrame, radius: int, recall: float) -> DataFrame:
    """doc_id, p0..p3, root, keep_id, size for each row that has a fingerprint."""
    rows = prints.where("p0 is not null").join(_groups(prints, radius, recall), _FP)
    sizes = rows.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """doc_id, keep_id, size: for each row of docs(doc_id, text) the lowest doc_id of its group and the group's rows."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(with_simhashes(docs), "simhashes")
    alone = prints.where("p0 is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("size"))
    return alone.unionByName(_resolved(prints, radius, recall).select("doc_id", "keep_id", "size"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs with one row of each group, the first by doc_id; all columns.

    Rows of groups of several are read again and shuffled, found by ids that are broadcast up to broadcast_rows.
    """
    docs = docs.select(F.struct("*").alias("row"))
    docs = docs.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "row")
    prints = stored(with_simhashes(docs.drop("row")), "simhashes")
    found = stored(_resolved(prints, radius, recall).where("size > 1"), "groups")
    ids = found.select(F.col("doc_id").alias("c_id")).distinct()
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    match = F.col("doc_id").eqNullSafe(F.col("c_id"))
    alone = docs.join(ids, match, "left_anti").select("row.*")
    again = with_simhashes(docs.join(ids, match, "left_semi"), "row")
    again = again.join(found.select(*_FP, "root").distinct(), _FP, "left")
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), *_FP))
    some = again.where("root is not null").withColumn("nth", first).where("nth = 1").select("row.*")
    return alone.unionByName(again.where("root is null").select("row.*")).unionByName(some)
