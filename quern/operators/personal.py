"""Personalized search: filters of interactions, sessions, profiles' weights and interests, features of results.

Interactions are those of `feedback`.  Null ids match no filter; a null value counts as 0.  Ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import distance as D

GAIN = {"click": 0.3, "bookmark": 1.0, "share": 0.8}
DEFAULTS = (0.5, 0.5)


def filtered(interactions: DataFrame, start: str | None = None, end: str | None = None, limit: int = 0, **wanted: object) -> DataFrame:
    """The interactions with all wanted values (user_id, query_id, document_id, type, ...) from start to end, both included; of these the first `limit` by ts, if it isn't 0."""
    rows = interactions
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return rows.orderBy("ts", "user_id", "query_id", "document_id").limit(limit) if limit > 0 else rows


def lookup(feedback: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of feedback whose key is in ids."""
    return feedback.join(ids.select(key).distinct(), key, "left_semi")


# --- sessions as they are created, ended and forgotten


def lifecycle(sessions: DataFrame, as_of: str, timeout_s: int = 1800) -> DataFrame:
    """session_id, user_id, nth (of the user, by start), start, expires, state of sessions(session_id, user_id, start, end).

    A session lasts timeout_s from its start: it is ended where it has an end by as_of, else expired, active, or to come.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    expires = F.col("start") + F.make_dt_interval(secs=F.lit(timeout_s))
    state = F.when(F.col("start") > at, "future").when(F.col("end") <= at, "ended").when(expires < at, "expired").otherwise("active")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("start", "session_id"))
    return sessions.select("session_id", "user_id", nth.alias("nth"), "start", expires.alias("expires"), state.alias("state"))


def active(sessions: DataFrame, as_of: str, timeout_s: int = 1800) -> DataFrame:
    """session_id, user_id: each user's latest active session."""
    rows = lifecycle(sessions, as_of, timeout_s).where("state = 'active'")
    return rows.groupBy("user_id").agg(F.max_by("session_id", "nth").alias("session_id"))


# --- weights


def weights(requests: DataFrame, profiles: DataFrame, defaults: tuple[float, float] = DEFAULTS) -> DataFrame:
    """request_id, vector_weight, text_weight (of sum 1 unless both are 0), mode.

    requests are (request_id, user_id, personalize, vector_weight, text_weight, mode, has_vector, query), profiles (user_id, vector_weight,
    text_weight): a request's own weight goes before its user's, if it is to be personalized, and that before the default.
    """
    p = profiles.select("user_id", F.col("vector_weight").alias("pv"), F.col("text_weight").alias("pt"))
    rows = requests.join(p, "user_id", "left")
    own = lambda mine, theirs, default: F.coalesce(mine, F.when(F.col("personalize"), theirs), F.lit(float(default)))
    rows = rows.withColumn("v", own(F.col("vector_weight"), F.col("pv"), defaults[0])).withColumn("t", own(F.col("text_weight"), F.col("pt"), defaults[1]))
    total = F.col("v") + F.col("t")
    share = lambda x: F.when(total > 0, x / total).otherwise(x)
    asked = F.coalesce(F.col("query"), F.lit("")) != ""
    auto = F.when(F.col("has_vector") & asked, "hybrid").when(F.col("has_vector"), "vector").when(asked, "text").when(share(F.col("v")) > share(F.col("t")), "vector").otherwise("text")
    mode = F.when(F.coalesce(F.col("mode"), F.lit("")).isin("", "auto"), auto).otherwise(F.col("mode"))
    return rows.select("request_id", D.round6(share(F.col("v"))).alias("vector_weight"), D.round6(share(F.col("t"))).alias("text_weight"), mode.alias("mode"))


# --- interests


def query_interests(results: DataFrame, most: int = 5) -> DataFrame:
    """user_id, topic, value: what a search adds, 0.1 / rank for each topic of its first `most` results(user_id, list_id, rank, topics)."""
    rows = results.where(F.col("rank") <= most).select("user_id", "list_id", F.explode("topics").alias("topic"), (0.1 / F.col("rank")).alias("x"))
    return rows.groupBy("user_id", "list_id", "topic").agg(D.round6(F.sum("x")).alias("value"))


def gain(kind: Column, value: Column) -> Column:
    """What an interaction adds to its document's topics: of clicks, bookmarks and shares a fixed value, of dwells minutes, of ratings a fifth; 0 of others."""
    value = F.coalesce(value, F.lit(0.0))
    out = F.when(kind == "dwell", value / 60).when(kind == "rating", value / 5)
    for name, x in GAIN.items():
        out = out.when(kind == name, x)
    return out.otherwise(0.0)


def interaction_interests(interactions: DataFrame, documents: DataFrame) -> DataFrame:
    """user_id, ts, topic, value of interactions that add something, by the topics (separated by commas) of documents(document_id, topics) that are known."""
    rows = interactions.withColumn("value", gain(F.col("type"), F.col("value"))).where("value > 0").join(documents.select("document_id", "topics"), "document_id")
    topics = F.filter(F.transform(F.split("topics", ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("user_id", "ts", F.explode(F.array_distinct(topics)).alias("topic"), D.round6(F.col("value")).alias("value"))


def interests(increments: DataFrame, decay: float = 0.95, least: float = 0.01) -> DataFrame:
    """user_id, topic, score of increments(user_id, ts, topic, value): at each, in order of ts and topic, all of the user's scores decay, its topic's grows, and those under least are dropped.

    What is dropped depends on order, so a user's increments pass one by one; rows come sorted, and only one user's scores are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, scores, out = None, {}, []
        for batch in batches:
            for u, topic, value in zip(*(c.to_pylist() for c in batch.columns)):
                if u != user:
                    out += [(user, t, s) for t, s in scores.items()]
                    user, scores = u, {}
                scores = {t: s * decay for t, s in scores.items()}
                scores[topic] = scores.get(topic, 0.0) + (value or 0.0)
                scores = {t: s for t, s in scores.items() if s >= least}
            if len(out) > 10_000:
                yield _profile_rows(out)
                out = []
        yield _profile_rows(out + [(user, t, s) for t, s in scores.items()])

    rows = increments.where("user_id is not null").select(F.col("user_id").cast("bigint").alias("user_id"), "ts", "topic", F.col("value").cast("double").alias("value"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "topic").select("user_id", "topic", "value")
    return rows.mapInArrow(work, "user_id bigint, topic string, score double").select("user_id", "topic", D.round6(F.col("score")).alias("score"))


def _profile_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()))], ["user_id", "topic", "score"])


# --- search


def in_store(hits: DataFrame, store: DataFrame, *columns: str) -> DataFrame:
    """The hits whose document is in store(id, ...), with columns of it."""
    return hits.join(store.select("id", *columns), "id")


def personalized(hits: DataFrame, requests: DataFrame, documents: DataFrame, interest: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, score: hits(query_id, rank, id, score) of documents(id, topics array) that are there, times 1 + 0.2 of the user's interest in each topic.

    requests are (query_id, user_id), interest (user_id, topic, score).  A user without a profile gets the hits as they are.
    """
    rows = in_store(hits, documents, "topics").join(requests.select("query_id", "user_id"), "query_id")
    boost = rows.select("query_id", "id", "user_id", F.explode(F.array_distinct("topics")).alias("topic")).join(interest.withColumnRenamed("score", "own"), ["user_id", "topic"])
    boost = boost.groupBy("query_id", "id").agg(F.product(1 + 0.2 * F.col("own")).alias("boost"))
    rows = rows.join(boost, ["query_id", "id"], "left").withColumn("score", D.round6(F.col("score") * F.coalesce("boost", F.lit(1.0))))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


AUTHORITY = {"wikipedia": 0.9, "arxiv": 0.85, "github": 0.8, "stackoverflow": 0.75, "medium": 0.6, "blog": 0.5}


def features(results: DataFrame, interactions: DataFrame, interest: DataFrame, as_of: str) -> DataFrame:
    """The features of results(list_id, user_id, query, position, id, score, vector_score, text_score, views, rating, created, source, topics) that re-ranking weighs.

    interactions(user_id, document_id, type, value, topics) are the users' histories.  What lacks its data is null; of a user without a history
    consistency and diversity are null.
    """
    own = interactions.where("type in ('click', 'dwell')").groupBy("user_id", F.col("document_id").alias("id")).agg(F.count(F.when(F.col("type") == "click", 1)).cast("double").alias("user_doc_clicks"), F.coalesce(F.avg(F.when(F.col("type") == "dwell", F.col("value"))), F.lit(0.0)).alias("user_doc_dwell"))
    seen = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("topics"))).alias("known"))
    profile = interest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "score"))).alias("likes"))
    rows = results.join(own, ["user_id", "id"], "left").join(seen, "user_id", "left").join(profile, "user_id", "left")
    some = F.size("topics") > 0
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("created").cast("timestamp"))) / 3600
    liked = F.aggregate("topics", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at("likes", t), F.lit(0.0)))
    both = F.size(F.filter("topics", lambda t: F.array_contains("known", t)))
    consistency = F.when(some & (F.size("known") > 0), 0.3 + 0.7 * both / F.size("topics")).otherwise(0.5)
    source = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair)), F.col("source")), F.lit(0.5))
    length = F.octet_length("query")
    every = {
        "original_score": F.col("score"),
        "vector_score": F.col("vector_score"),
        "text_score": F.col("text_score"),
        "score_variance": F.abs(F.col("vector_score") - F.col("text_score")),
        "original_position": F.col("position").cast("double"),
        "inverse_position": 1 / F.col("position"),
        "document_popularity": F.log1p(F.col("views").cast("double")),
        "document_rating": F.col("rating"),
        "document_freshness": 1 / (1 + hours / 24),
        "source_authority": F.when(F.col("source").isNotNull(), source),
        "topic_relevance": F.when(F.col("likes").isNotNull(), F.when(some, liked / F.size("topics")).otherwise(0.0)),
        "user_doc_clicks": F.coalesce("user_doc_clicks", F.lit(0.0)),
        "user_doc_dwell": F.coalesce("user_doc_dwell", F.lit(0.0)),
        "session_topic_consistency": F.when(F.col("n") > 0, consistency),
        "session_diversity_needed": F.when(F.col("n") > 5, 0.8).when(F.col("n") > 0, 0.2),
        "query_length": length.cast("double"),
        "query_complexity": F.least(F.lit(1.0), F.floor(length / 5) / 10),
    }
    return rows.select("list_id", "id", *(D.round6(x).alias(name) for name, x in every.items()))


def sgd_step(w: Column, x: Column, label: Column, predicted: Column, rate: float = 0.01, weight: Column | float = 1.0) -> Column:
    """A weight after one example: w + rate * (label - predicted) * x * weight."""
    return w + rate * (label - predicted) * x * weight


def trained(examples: DataFrame, names: list[str], epochs: int = 10, rate: float = 0.01, decay: float = 0.95, l2: float = 0.001) -> DataFrame:
    """name, weight of logistic relevance, 1 / (1 + exp(-(0.5 + sum w x))), after `epochs` steps along the mean gradient over all examples(label, and a column for each name).

    One aggregation of a number for each name an epoch.  Null features count as 0.
    """
    w = dict.fromkeys(names, 0.0)
    value = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names}
    for epoch in range(epochs):
        total = F.lit(0.5)
        for n in names:
            total = total + w[n] * value[n]
        error = F.col("label") - 1 / (1 + F.exp(-total))
        mean = examples.agg(*(F.coalesce(F.avg(error * value[n]), F.lit(0.0)).alias(n) for n in names)).first()
        w = {n: w[n] + rate * decay**epoch * (mean[n] - l2 * w[n]) for n in names}
    return examples.sparkSession.createDataFrame([(n, round(x, 6)) for n, x in w.items()], "name string, weight double")
