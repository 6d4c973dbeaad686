"""Fusion of ranked lists into one ranking.

hits are (query_id, list, rank, id, score) with ranks from 1 within each query's list; weights are by list, 1 where a list has none.
The result is query_id, id, score with more as better, rounded to six decimals; `ranked` puts ranks on it, ties to the
lower id.  One aggregation by query and id, and at most one window by query and list.  Null scores count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import weights as mapped


def _weight(weights: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(mapped(weights), F.col("list")), F.lit(1.0)) if weights else F.lit(1.0)


def _sum(hits: DataFrame, part: Column) -> DataFrame:
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def check_weights(weights: dict[str, float]) -> None:
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights sum to {sum(weights.values()):g}, not 1")


def rrf(hits: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Sum of w / (rank + k)."""
    return _sum(hits, _weight(weights) / (F.col("rank") + k))


def linear(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of w * score."""
    return _sum(hits, _weight(weights) * F.coalesce("score", F.lit(0.0)))


def borda(hits: DataFrame, weights: dict[str, float], most: int = 100) -> DataFrame:
    """Sum of w * exp(-0.1 * (rank - 1)); beyond `most` the exponential is left out."""
    return _sum(hits, _weight(weights) * F.when(F.col("rank") > most, 1.0).otherwise(F.exp(-0.1 * (F.col("rank") - 1))))


def _within() -> Window:
    return Window.partitionBy("query_id", "list")


def combsum(hits: DataFrame, weights: dict[str, float], normalize: bool = True) -> DataFrame:
    """Sum of w * score, scores of each list put into 0 to 1 first; a list of equal scores stays as it is."""
    score = F.coalesce("score", F.lit(0.0))
    if normalize:
        lo, hi = F.min(score).over(_within()), F.max(score).over(_within())
        hits = hits.withColumn("score", F.when(hi > lo, (score - lo) / (hi - lo)).otherwise(score))
    return _sum(hits, _weight(weights) * F.coalesce("score", F.lit(0.0)))


def inverse_square(hits: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Sum of w / (rank + k)**2, in millionths, as six decimals would leave little of it."""
    return _sum(hits, 1e6 * _weight(weights) / ((F.col("rank") + k) * (F.col("rank") + k)))


def relative(hits: DataFrame, weights: dict[str, float], threshold: float = 0.0) -> DataFrame:
    """Sum of w * score / the list's first score, where that share is at least threshold."""
    first = F.first("score").over(_within().orderBy("rank", "id"))
    share = F.when(first != 0, F.col("score") / first).otherwise(0.0)
    rows = hits.withColumn("share", share).where(F.col("share") >= threshold)
    return _sum(rows, _weight(weights) * F.col("share"))


def probabilistic(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """exp of the sum of w * ln(p + 1e-10), p a score's share of its list's sum, or equal shares where that isn't positive."""
    total, n = F.sum("score").over(_within()), F.count(F.lit(1)).over(_within())
    rows = hits.withColumn("p", F.when(total > 0, F.greatest(F.lit(0.0), F.col("score")) / total).otherwise(1 / n))
    part = _weight(weights) * F.log(F.coalesce("p", F.lit(0.0)) + 1e-10)
    return rows.groupBy("query_id", "id").agg(F.round(F.exp(F.sum(part)), 6).alias("score"))


METHODS = {"rrf": rrf, "linear": linear, "borda": borda, "combsum": combsum, "isr": inverse_square, "relative": relative, "probabilistic": probabilistic}


def ranked(fused: DataFrame, k: int | None = None) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    out = fused.withColumn("rank", F.row_number().over(by))
    return out if k is None else out.where(F.col("rank") <= k)


def boosted(score: Column, created: Column, as_of: Column, source: Column) -> Column:
    """1.2 times within a day of as_of, 1.1 within a week; 1.3 times for official and verified sources."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(created)
    fresh = F.when(age < 86400, 1.2).when(age < 7 * 86400, 1.1).otherwise(1.0)
    return score * F.coalesce(fresh, F.lit(1.0)) * F.when(F.coalesce(F.lower(source).isin("official", "verified"), F.lit(False)), 1.3).otherwise(1.0)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, method: str = "rrf", vector: float = 0.6, text: float = 0.4, k: int = 10, info: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """query_id, rank, id, score from vector_hits(query_id, rank, id, dist) and text_hits(query_id, rank, id, score); a distance counts as similarity 1 - dist.

    With info(id, created, source), scores are boosted by age at as_of and by source before the k best are taken; a document without info isn't.
    """
    check_weights({"vector": vector, "text": text})
    a = vector_hits.select("query_id", F.lit("vector").alias("list"), "rank", "id", (1 - F.col("dist")).alias("score"))
    b = text_hits.select("query_id", F.lit("text").alias("list"), "rank", "id", "score")
    fused = METHODS[method](a.unionByName(b), {"vector": vector, "text": text})
    if info is not None:
        score = F.coalesce(boosted(F.col("score"), F.col("created"), F.current_timestamp() if as_of is None else as_of, F.col("source")), F.col("score"))
        fused = fused.join(info.select("id", "created", "source"), "id", "left").select("query_id", "id", F.round(score, 6).alias("score"))
    return ranked(fused, k).select("query_id", "rank", "id", "score")
