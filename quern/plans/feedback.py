"""Feedback queries over all events: views are impressions, purchases dwell, errors ratings, sign-ups bookmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.operators import feedback as B
from quern.operators import personal as P

TYPES = {"view": "impression", "click": "click", "purchase": "dwell", "error": "rating", "signup": "bookmark"}


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), F.col("event_type"))
    return e.select("user_id", (F.col("event_id") % 200).alias("query_id"), (F.col("event_id") % 50).alias("document_id"), (F.col("event_id") % 20 + 1).alias("position"), kind.alias("type"), (F.col("value") % 100).alias("value"), "ts")


def _of(f):
    return lambda spark, sf_dir: f(interactions(spark, sf_dir))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = interactions(spark, sf_dir)
    return B.attributed(x.where("type = 'click'").select("query_id", "document_id", "ts"), x.where("type = 'impression'"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.quality(B.document_feedback(interactions(spark, sf_dir)))


def click_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.ctr(interactions(spark, sf_dir), "position", "position")
    return x.select("position", D.round6(B.click_probability(F.col("position"), F.col("ctr"))).alias("p"))


def ctr_optimal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each query that were clicked, by id, in a better order."""
    from pyspark.sql import Window

    x = interactions(spark, sf_dir)
    lists = x.where("type = 'click'").select(F.col("query_id").alias("list_id"), "document_id").distinct()
    lists = lists.withColumn("position", F.row_number().over(Window.partitionBy("list_id").orderBy("document_id")))
    return B.optimal_ranking(lists, x)


def interest_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = interactions(spark, sf_dir).where("type in ('click', 'dwell', 'rating')")
    return P.interests(x.select("user_id", "ts", (F.col("document_id") % 7).cast("string").alias("topic"), P.gain(F.col("type"), F.col("value")).alias("value")))


def interest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_interests(interest_decay(spark, sf_dir), 2)


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latency(interactions(spark, sf_dir).select(F.col("type").alias("key"), "ts", "value"))


def rerank_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's clicks as results, by position."""
    x = interactions(spark, sf_dir).where("type = 'click'")
    source = F.element_at(F.array(*map(F.lit, ["wikipedia", "arxiv", "blog", "elsewhere"])), (F.col("document_id") % 4 + 1).cast("int"))
    topics = F.array((F.col("document_id") % 3).cast("string"), (F.col("document_id") % 5).cast("string"))
    rows = x.select(F.col("query_id").alias("list_id"), "position", F.unix_micros(F.col("ts").cast("timestamp")).alias("id"), (1 / F.col("position")).alias("score"), (F.col("value") / 100).alias("vector_score"), F.lit(0.5).alias("text_score"), F.col("document_id").alias("views"), (F.col("value") % 5).alias("rating"), F.col("ts").alias("created"), source.alias("source"), topics.alias("topics"))
    return B.rerank(rows, "2024-02-01 00:00:00", F.create_map(F.lit("0"), F.lit(0.5), F.lit("4"), F.lit(1.0)))


QUERIES = {
    "ctr_document": _of(lambda x: B.ctr(x, "document_id", "document_id")),
    "ctr_query": _of(lambda x: B.ctr(x, "query_id", "query_id")),
    "ctr_position": _of(lambda x: B.ctr(x, "position", "position")),
    "ctr_hourly": _of(B.hourly),
    "ctr_report": _of(B.report),
    "document_feedback": _of(B.document_feedback),
    "query_satisfaction": _of(B.satisfaction),
    "click_pattern": _of(lambda x: B.click_pattern(x).drop("positions")),
    "anomalies": _of(lambda x: B.anomalies(x, 10, 0.00001, 5)),
    "click_model": _of(B.click_model),
    "position_bias": _of(B.position_bias),
    "pairwise_signals": _of(B.pairwise),
    "sessions_gap": _of(B.sessions),
    "sessions_start": _of(lambda x: B.sessions_from_start(x, 86400)),
} | {f.__name__: f for f in (attribution, quality_score, click_probability, ctr_optimal_ranking, interest_decay, interest_top, latency_stats, rerank_contextual)}

_X = "x AS (SELECT user_id, event_id % 200 AS query_id, event_id % 50 AS document_id, event_id % 20 + 1 AS position, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " END AS type, value % 100 AS value, ts FROM events)"


def _ctr(key: str, name: str) -> str:
    return f"""SELECT {name}, impressions, clicks, round(CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END, 6) AS ctr, round(coalesce(p, 0), 6) AS avg_position, round(coalesce(d, 0), 6) AS avg_dwell, round(1 - 1 / (impressions + 1), 6) AS confidence FROM
        (SELECT {key} AS {name}, count(*) FILTER (type = 'impression') AS impressions, count(*) FILTER (type = 'click') AS clicks, avg(position) FILTER (type = 'impression') AS p, avg(value) FILTER (type = 'click' AND value > 0) AS d FROM x GROUP BY ALL)"""


_FEEDBACK = """f AS (SELECT document_id, count(*) AS views, count(*) FILTER (type = 'click') AS clicks, coalesce(avg(value) FILTER (type = 'rating'), 0) AS avg_rating, count(*) FILTER (type = 'rating') AS ratings FROM x GROUP BY ALL),
    o AS (SELECT document_id, type, value, row_number() OVER (PARTITION BY document_id ORDER BY ts, query_id, type, value) AS i FROM x),
    dw AS (SELECT document_id, list([i, value] ORDER BY i) AS l FROM o WHERE type = 'dwell' GROUP BY document_id),
    fb AS (SELECT f.*, coalesce(list_reduce(l, lambda a, b: [b[1], (a[2] * (b[1] - 1) + b[2]) / b[1]], [0.0::DOUBLE, 0.0::DOUBLE])[2], 0) AS avg_dwell FROM f LEFT JOIN dw USING (document_id))"""
_GAIN = """g AS (SELECT user_id, ts, document_id % 7 AS topic, CASE type WHEN 'click' THEN 0.3::DOUBLE WHEN 'dwell' THEN value / 60 ELSE value / 5 END AS value FROM x WHERE type IN ('click', 'dwell', 'rating')),
    gi AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, topic) AS i FROM g),
    st AS (SELECT user_id, 0::BIGINT AS i, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0] AS s FROM g GROUP BY user_id
        UNION ALL SELECT user_id, gi.i, list_transform(range(0, 7), lambda k: CASE WHEN s[k + 1] * 0.95::DOUBLE + CASE WHEN k = topic THEN value ELSE 0 END < 0.01 THEN 0 ELSE s[k + 1] * 0.95::DOUBLE + CASE WHEN k = topic THEN value ELSE 0 END END) FROM st JOIN gi USING (user_id) WHERE gi.i = st.i + 1),
    last AS (SELECT user_id, s FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1), sc AS (SELECT user_id, topic::VARCHAR AS topic, round(s[topic + 1], 6) AS score FROM last, range(0, 7) t(topic) WHERE s[topic + 1] >= 0.01)"""

ORACLE_SQL = {
    "ctr_document": f"WITH {_X} {_ctr('document_id', 'document_id')}",
    "ctr_query": f"WITH {_X} {_ctr('query_id', 'query_id')}",
    "ctr_position": f"WITH {_X} {_ctr('position', 'position')}",
    "ctr_hourly": f"WITH {_X} SELECT hour::INT AS hour, impressions, clicks, ctr FROM ({_ctr('hour(ts)', 'hour')}) WHERE impressions > 0",
    "ctr_report": f"""WITH {_X}, c AS ({_ctr("'all'", 'key')}), d AS ({_ctr('document_id', 'key')}), q AS ({_ctr('query_id', 'key')}), p AS ({_ctr('position', 'key')}), h AS ({_ctr('hour(ts)', 'key')})
        SELECT 'total' AS section, key, impressions, clicks, ctr FROM c UNION ALL SELECT * FROM (SELECT 'documents', key::VARCHAR, impressions, clicks, ctr FROM d WHERE impressions >= 10 ORDER BY ctr DESC, key LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'queries', key::VARCHAR, impressions, clicks, ctr FROM q WHERE impressions >= 5 ORDER BY ctr DESC, key LIMIT 10) UNION ALL SELECT 'positions', key::VARCHAR, impressions, clicks, ctr FROM p
        UNION ALL SELECT 'hours', key::VARCHAR, impressions, clicks, ctr FROM h WHERE impressions > 0""",
    "document_feedback": f"WITH {_X}, {_FEEDBACK} SELECT document_id, views, clicks, round(clicks / views, 6) AS ctr, round(avg_rating, 6) AS avg_rating, ratings, round(avg_dwell, 6) AS avg_dwell FROM fb",
    "quality_score": f"WITH {_X}, {_FEEDBACK} SELECT document_id, round(greatest(0, least(1, 0.3 * round(clicks / views, 6) + CASE WHEN ratings > 0 THEN 0.4 * round(avg_rating, 6) / 5 ELSE 0 END + CASE WHEN avg_dwell > 0 THEN 0.3 * least(round(avg_dwell, 6) / 60, 1) ELSE 0 END)), 6) AS quality FROM fb",
    "query_satisfaction": f"""WITH {_X}, g AS (SELECT query_id, count(*) FILTER (type = 'click') AS n, max(position) FILTER (type = 'click') AS last, avg(value) FILTER (type = 'dwell') AS dwell, coalesce(bool_or(type = 'rating' AND value < 3), false) AS bad FROM x GROUP BY ALL),
        s AS (SELECT query_id, CASE WHEN bad THEN 0 ELSE CASE WHEN n > 0 AND last <= 3 THEN 0.4 WHEN n > 0 AND last <= 5 THEN 0.2 ELSE 0 END - CASE WHEN n >= 3 THEN 0.1 ELSE 0 END + CASE WHEN dwell > 30 THEN 0.3 WHEN dwell > 10 THEN 0.1 ELSE 0 END END AS score,
        CASE WHEN bad THEN 1 ELSE CASE WHEN n > 0 AND last <= 3 THEN 0.3 WHEN n > 0 AND last <= 5 THEN 0.2 ELSE 0 END + CASE WHEN dwell > 30 THEN 0.3 WHEN dwell > 10 THEN 0.2 ELSE 0 END END AS confidence FROM g)
        SELECT query_id, score::DOUBLE AS score, score > 0.3 AS satisfied, confidence::DOUBLE AS confidence FROM s""",
    "click_pattern": f"""WITH {_X}, g AS (SELECT query_id, count(*) FILTER (type = 'click') AS clicks, avg(position) FILTER (type = 'click') AS p FROM x GROUP BY ALL)
        SELECT query_id, clicks, round(p, 6) AS avg_position, CASE WHEN p IS NULL THEN 'no_clicks' WHEN p <= 2 THEN 'top_heavy' WHEN p <= 5 THEN 'moderate' ELSE 'exploratory' END AS pattern, CASE WHEN p <= 2 THEN 'high' WHEN p <= 5 THEN 'medium' WHEN p > 5 THEN 'low' END AS position_bias FROM g""",
    "anomalies": f"""WITH {_X}, g AS (SELECT user_id, count(*) FILTER (type = 'click') AS n, epoch_us(max(ts) FILTER (type = 'click')) - epoch_us(min(ts) FILTER (type = 'click')) AS us, count(*) FILTER (type = 'rating' AND value < 2) AS bad FROM x GROUP BY ALL)
        SELECT user_id, 'rapid_clicking' AS anomaly FROM g WHERE n > 10 AND n * 1e6 > 0.00001 * us UNION ALL SELECT user_id, 'excessive_negative_ratings' FROM g WHERE bad > 5""",
    "click_model": f"WITH {_X}, b AS (SELECT position, count(*) AS n, count(*) FILTER (type = 'click') AS c FROM x WHERE position BETWEEN 1 AND 20 GROUP BY ALL HAVING c > 0) SELECT round(0.9 + 0.1 * exp(sum(ln(c / n) * c) / count(*)), 6) AS alpha, round(0.45 - 0.1 * sum(ln(position) * c) / count(*), 6) AS beta FROM b",
    "position_bias": f"WITH {_X} SELECT position, round(0.9 * pow(position, -0.5) + 0.1 * count(*) FILTER (type = 'click') / count(*), 6) AS bias FROM x GROUP BY position",
    "pairwise_signals": f"""WITH {_X}, r AS (SELECT *, max((type = 'click')::INT) OVER (PARTITION BY query_id, position) = 1 AS hit, row_number() OVER (PARTITION BY query_id ORDER BY position, ts, document_id) AS nth FROM x)
        SELECT a.query_id, a.document_id AS doc1, b.document_id AS doc2, CASE WHEN a.hit AND NOT b.hit THEN 1.0 WHEN NOT a.hit AND b.hit THEN 0.0 WHEN a.value > b.value THEN 1.0 WHEN a.value < b.value THEN 0.0 ELSE 0.5 END::DOUBLE AS label, (b.position - a.position)::DOUBLE AS pos_diff, round(a.position / b.position, 6) AS pos_ratio
        FROM r a JOIN r b ON a.query_id = b.query_id AND a.nth < b.nth AND (a.hit OR b.hit)""",
    "sessions_gap": f"""WITH {_X}, l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM x), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
        SELECT user_id, session::INT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM s GROUP BY user_id, session""",
    "attribution": f"WITH {_X}, i AS (SELECT query_id, document_id, arg_min(position, ts) AS first_position, min(ts) AS first_ts FROM x WHERE type = 'impression' GROUP BY ALL) SELECT x.query_id, x.document_id, x.ts, first_position, first_ts FROM x LEFT JOIN i USING (query_id, document_id) WHERE type = 'click'",
    "click_probability": f"WITH {_X} SELECT position, round(greatest(0, least(1, pow(position, -0.5) * ctr)), 6) AS p FROM ({_ctr('position', 'position')})",
    "ctr_optimal_ranking": f"""WITH {_X}, d AS ({_ctr('document_id', 'document_id')}), p AS ({_ctr('position', 'position')}), l AS (SELECT query_id AS list_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY document_id) AS position FROM (SELECT DISTINCT query_id, document_id FROM x WHERE type = 'click')),
        s AS (SELECT list_id, position, document_id, round(CASE WHEN p.ctr > 0 THEN coalesce(d.ctr * 0.5, 0) / p.ctr ELSE coalesce(d.ctr * 0.5, 0) END, 6) AS score FROM l LEFT JOIN d USING (document_id) LEFT JOIN p USING (position))
        SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, position) AS rank, document_id, score FROM s""",
    "interest_decay": f"WITH RECURSIVE {_X}, {_GAIN} SELECT * FROM sc",
    "interest_top": f"WITH RECURSIVE {_X}, {_GAIN} SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, topic) AS rank FROM sc QUALIFY rank <= 2",
    "latency_stats": f"WITH {_X}, r AS (SELECT type AS key, value, row_number() OVER (PARTITION BY type ORDER BY ts DESC) AS nth FROM x), g AS (SELECT key, count(*) AS n, avg(value) AS mean, list_sort(list(value)) AS v FROM r WHERE nth <= 1000 GROUP BY key) SELECT key, n, round(mean, 6) AS mean, v[floor(n * 0.5)::INT + 1] AS p50, v[floor(n * 0.95)::INT + 1] AS p95, v[floor(n * 0.99)::INT + 1] AS p99 FROM g",
}

ORACLE_SQL |= {
    "sessions_start": f"""WITH RECURSIVE {_X}, r AS (SELECT user_id, 1 AS session, min(ts) AS start FROM x GROUP BY user_id
        UNION ALL SELECT r.user_id, r.session + 1, n.start FROM r JOIN LATERAL (SELECT min(ts) AS start FROM x WHERE x.user_id = r.user_id AND x.ts > r.start + INTERVAL 1 DAY) n ON n.start IS NOT NULL)
        SELECT r.user_id, session, start, count(*) AS events FROM r JOIN x ON x.user_id = r.user_id AND x.ts >= start AND x.ts <= start + INTERVAL 1 DAY GROUP BY ALL""",
    "rerank_contextual": f"""WITH {_X}, c AS (SELECT query_id AS list_id, position, epoch_us(ts) AS id, 1 / position AS score, value / 100 AS vs, document_id AS views, value % 5 AS rating, ts, [0.85::DOUBLE, 0.5, 0.5, 0.9][CASE document_id % 4 WHEN 0 THEN 4 ELSE document_id % 4 END] AS authority, document_id % 3 AS t1, document_id % 5 AS t2 FROM x WHERE type = 'click'),
        b AS (SELECT *, [t1, t2] AS topics, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400 AS days, row_number() OVER (PARTITION BY list_id ORDER BY position, id) AS nth FROM c),
        l AS (SELECT a.list_id, a.id, a.nth, max(len(list_intersect(a.topics, p.topics)) / greatest(1, len(list_distinct(a.topics)) + 2 - len(list_intersect(a.topics, p.topics)))) AS alike FROM b a JOIN b p ON a.list_id = p.list_id AND p.nth < a.nth GROUP BY ALL),
        s AS (SELECT b.list_id, b.position, b.id, round((2 * score + 0.5 * vs + 0.5 * 0.5 - 0.1 * abs(vs - 0.5) + 0.2 * ln(1 + views) + 0.3 * rating + 0.15 / (1 + days) + 0.25 * authority)
            * (1 + 0.2::DOUBLE * CASE t1 WHEN 0 THEN 0.5 WHEN 4 THEN 1 ELSE 0 END) * (1 + 0.2::DOUBLE * CASE t2 WHEN 0 THEN 0.5 WHEN 4 THEN 1 ELSE 0 END) * (0.8::DOUBLE + 0.2 * exp(-days / 30)) * (1 - 0.3::DOUBLE * coalesce(alike, 0)), 6) + 0.0 AS score FROM b LEFT JOIN l USING (list_id, id, nth))
        SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, position, id) AS rank, id, score FROM s""",
}
