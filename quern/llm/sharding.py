"""Sharding by vector bin packing.

Groups of rows that must stay together (here the copies of one text) are packed into a fixed number of
shards so that bytes, tokens and rows are all balanced.  Each shard has as capacity its equal
part of each total.  Groups go from the heaviest (by their largest share of a total) on, each into the shard where the
dot product of its shares with the shard's residual capacity is highest; of equal products the
shard of the lowest number.  A group's shares are its amounts divided by the totals.

Packing is sequential, with one residual capacity for all.  So that it takes bounded time and memory at any size, a group lighter
than `heavy` of a shard's capacity is placed with those of its bundle, one of `bundles` for each shard by a hash of its key;
heavier groups are placed alone.  There are at most 3 / heavy of those for each shard, so one task gets at most
(bundles + 3 / heavy) * shards rows of numbers, never texts, and the table of places that it gives is as bounded and is broadcast.
What a shard has over its equal part is at most what the last group or bundle placed there weighs, or its rest
where no shard had room: a bundle of 4,096 a shard weighs about 1/4,096 of a shard and at most that and `heavy` of one more group.

Null texts are groups of their own by doc_id, and of no bytes and tokens; empty texts are one group.  Rows repeated count each
and stay together.  Tokens are runs of characters other than white space unless a column of counts is given.  Columns
of docs named as one of the result don't count.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import stored

AMOUNTS = ["bytes", "tokens", "rows"]
HEAVY = 0.02
BUNDLES = 4096


def pack(shares: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A shard for each row of shares (groups by amounts), which come in the order of packing; residual (shards by amounts) is used up."""
    out = np.zeros(len(shares), np.int32)
    columns = [np.ascontiguousarray(residual[:, k]) for k in range(residual.shape[1])]
    for i, share in enumerate(shares.tolist()):
        score = columns[0] * share[0]
        for c, s in zip(columns[1:], share[1:]):
            score += c * s
        best = int(score.argmax())
        out[i] = best
        for c, s in zip(columns, share):
            c[best] -= s
    for k, c in enumerate(columns):
        residual[:, k] = c
    return out


def order_of(shares: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Heaviest first by the largest share, then by the sum of shares, then by key."""
    return np.lexsort((keys, -shares.sum(axis=1), -shares.max(axis=1)))


def tokens_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def placed(rows: DataFrame, shards: int, heavy: float = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """The rows of rows(key bigint, bytes, tokens, ...) with their shard; rows are stored, and read twice.

    Rows of one key are in one shard.
    """
    groups = rows.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    totals = np.array([max(1, total[c]) for c in AMOUNTS], np.float64)
    share = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip(AMOUNTS, totals)))
    bundle = lambda key: F.pmod(F.xxhash64(F.lit("bundle"), key), F.lit(shards * bundles))
    # an item is a heavy group, or a bundle of others
    alone = F.when(share > heavy / shards, F.col("key"))
    items = groups.select(alone.alias("alone"), F.when(alone.isNull(), bundle(F.col("key"))).alias("bundle"), *AMOUNTS)
    items = items.groupBy("alone", "bundle").agg(*(F.sum(c).alias(c) for c in AMOUNTS))

    def work(part: pa.Table) -> pa.Table:
        shares = np.stack([part[c].to_numpy() for c in AMOUNTS], axis=1) / totals
        by = order_of(shares, np.lexsort((part["bundle"].fill_null(-1).to_numpy(), part["alone"].fill_null(0).to_numpy())).argsort())
        shard = np.empty(len(part), np.int32)
        shard[by] = pack(shares[by], np.full((shards, len(AMOUNTS)), 1.0 / shards))
        return pa.table({"alone": part["alone"], "bundle": part["bundle"], "shard": shard})

    places = stored(items.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: work(t), "alone bigint, bundle bigint, shard int"), "places")
    own = places.where("alone is not null").select(F.col("alone").alias("key"), F.col("shard").alias("own"))
    other = places.where("bundle is not null").select("bundle", F.col("shard").alias("other"))
    rows = rows.join(F.broadcast(own), "key", "left").withColumn("bundle", bundle(F.col("key"))).join(F.broadcast(other), "bundle", "left")
    return rows.withColumn("shard", F.coalesce("own", "other")).drop("own", "other", "bundle")


def shard_documents(docs: DataFrame, shards: int = 64, tokens: str | None = None, heavy: float = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, bytes, tokens, shard for each row of docs(doc_id, text); rows of equal text are in one shard.

    tokens names a column of docs with token counts; nulls in it count as 0.
    """
    text = F.col("text").cast("string")
    key = F.when(text.isNull(), F.xxhash64(F.lit("null text"), F.col("doc_id"))).otherwise(F.xxhash64(text, F.md5(text)))
    count = F.coalesce(F.col(tokens).cast("bigint") if tokens else tokens_in(text), F.lit(0).cast("bigint"))
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"), count.alias("tokens")), "rows")
    return placed(rows, shards, heavy, bundles).select("doc_id", "bytes", "tokens", "shard")
