"""Queries of personalization, planning and caching, over events, documents, vectors, parts and suppliers as what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.operators import personal as P
from quern.operators import planner as L
from quern.operators import text_search as S
from quern.plans.feedback import _X, _ctr, interactions
from quern.plans.search import _HITS, _INDEX, asked, documents
from quern.plans.tables import table
from quern.plans.vectors import label_centroids, vectors

AS_OF = "2024-01-15 00:00:00"


def interaction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clicks of the middle of the month on one document."""
    return P.filtered(interactions(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-20 00:00:00", type="click", document_id=7)


def interaction_filter_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filtered(interactions(spark, sf_dir), limit=25, type="impression")


def feedback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click-through of documents that the tenth query clicked."""
    from quern.operators import feedback as B

    x = interactions(spark, sf_dir)
    return P.lookup(B.ctr(x, "document_id", "document_id"), x.where("query_id = 9 and type = 'click'"), "document_id")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups and purchases as sessions, every other one ended after as many minutes as its value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('signup', 'purchase')")
    end = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") % 60).cast("int")))
    return e.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("start"), end.alias("end"))


def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lifecycle(_sessions(spark, sf_dir), AS_OF, 86400)


def session_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.active(_sessions(spark, sf_dir), AS_OF, 86400)


def search_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: some with weights, some to be personalized, of users of whom every third has a profile."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 4
    requests = e.select(F.col("event_id").alias("request_id"), "user_id", (F.col("event_id") % 3 > 0).alias("personalize"), F.when(kind == 0, F.col("value") % 2).alias("vector_weight"), F.when(kind == 1, 0.25).alias("text_weight"), F.when(kind == 2, F.lit("text")).when(kind == 3, F.lit("auto")).alias("mode"), (F.col("event_id") % 5 < 2).alias("has_vector"), F.when(F.col("event_id") % 7 < 4, F.col("props")).alias("query"))
    profiles = e.where("user_id % 3 = 0").groupBy("user_id").agg((F.max("event_id") % 10 / 10).alias("vector_weight"), F.lit(0.3).alias("text_weight"))
    return P.weights(requests, profiles)


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat("lang", F.lit(", "), "source", F.lit(",,"), "lang").alias("topics"))


def query_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each benchmark text, asked by a user of its own, adds by the topics of its best documents."""
    found = S.bm25(documents(spark, sf_dir), asked(spark, sf_dir))
    topics = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("topics"))
    return P.query_interests(found.join(topics, "id").select((F.col("query_id") % 10).alias("user_id"), F.col("query_id").alias("list_id"), "rank", "topics"))


def interaction_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.interaction_interests(interactions(spark, sf_dir), _topics(spark, sf_dir))


def personalized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts against documents that have a vector, for users whose interests their searches made."""
    found = S.bm25(documents(spark, sf_dir), asked(spark, sf_dir), 20)
    info = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("topics"))
    store = P.in_store(info, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
    interest = query_interests(spark, sf_dir).groupBy("user_id", "topic").agg(F.round(F.sum("value"), 6).alias("score"))
    requests = asked(spark, sf_dir).select("query_id", (F.col("query_id") % 10).alias("user_id"))
    return P.personalized(found, requests, store, interest)


def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as results of lists, with all interactions as the users' histories."""
    x = interactions(spark, sf_dir)
    topics = F.array((F.col("document_id") % 3).cast("string"), (F.col("document_id") % 5).cast("string"))
    results = x.where("type = 'click'").select(F.col("query_id").alias("list_id"), "user_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query"), "position", F.col("document_id").alias("id"), (1 / F.col("position")).alias("score"), (F.col("value") / 100).alias("vector_score"), F.lit(0.5).alias("text_score"), (F.col("document_id") * 3).alias("views"), (F.col("value") % 5).alias("rating"), F.col("ts").alias("created"), F.when(F.col("document_id") % 2 == 0, "github").alias("source"), topics.alias("topics"))
    interest = x.where("type = 'dwell'").groupBy("user_id", (F.col("document_id") % 5).cast("string").alias("topic")).agg(F.round(F.avg("value"), 4).alias("score"))  # means of two then don't tie at the seventh place
    return P.features(results, x.withColumn("topics", topics), interest, "2024-02-01 00:00:00")


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as collections: many vectors, an index by the parity of their number, updates by the mean size."""
    g = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("collection")).agg((F.sum("p_size") * F.sum("p_size")).cast("bigint").alias("vectors"), F.avg("p_size").alias("m"))
    return g.select("collection", "vectors", F.lit(64).alias("dimension"), F.when(F.col("vectors") % 2 == 0, "hnsw").otherwise("flat").alias("index_type"), (F.col("m") - 15).alias("updates"), (F.col("m") * 4).alias("qps"))


def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    requests = p.select(F.col("p_partkey").alias("request_id"), F.col("p_brand").alias("collection"), F.col("p_size").alias("k"), (F.col("p_partkey") % 3 == 0).alias("filtered"), F.col("p_name").alias("query_hash"))
    patterns = p.groupBy(F.col("p_name").alias("query_hash")).agg((F.count(F.lit(1)) % 15).alias("frequency"), F.avg((F.col("p_size") > 25).cast("int")).alias("hit_rate"))
    return L.planned(requests, _collections(spark, sf_dir), patterns)


def plan_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_means(interactions(spark, sf_dir).select(F.col("query_id").alias("plan_id"), "ts", F.floor("value").alias("ms"), F.col("position").alias("results")))


PROFILES = [("flat", 0.3, 1.0, 1.0, 1.0, 0, 100_000), ("hnsw", 0.9, 0.5, 0.4, 0.95, 1_000, 10_000_000), ("ivf", 0.8, 0.7, 0.8, 0.85, 50_000, 1_000_000_000)]


def index_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.createDataFrame(PROFILES, "index_type string, latency double, insert double, memory double, accuracy double, least bigint, most bigint")
    return L.index_choice(_collections(spark, sf_dir), profiles)


def progressive_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = interactions(spark, sf_dir)
    return x.select("query_id", "document_id", "ts", D.round6(L.confidence(F.col("position") / 20, F.col("value") / 100, F.col("document_id") > 25)).alias("confidence"))


def coarse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.coarse_queries(vectors(spark, sf_dir), label_centroids(spark, sf_dir), 3, 16)
    return found.select("query_id", F.posexplode("vector").alias("d", "x")).select("query_id", "d", D.round6(F.col("x")).alias("x"))


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    pick = lambda words, by: F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))
    models = s.select(F.col("s_name").alias("name"), F.array(pick(["en", "fr", "de"], F.col("s_nationkey")), pick(["es", "en"], F.col("s_suppkey"))).alias("languages"), (128 * (F.col("s_suppkey") % 8 + 1)).alias("dimension"), F.array(pick(["fast", "small", "large"], F.col("s_suppkey")), pick(["code", "chat"], F.col("s_nationkey"))).alias("tags"), (F.col("s_suppkey") % 100 / 100).alias("accuracy"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal").cast("double")).alias("throughput"), (F.col("s_nationkey") * 10_000_000).alias("bytes"))
    return L.registry(models, ["en", "fr"], ["fast", "code"], 256, 896)


def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.memory(_collections(spark, sf_dir), 16)


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("source"), ((F.col("label") + 1) % 10).cast("bigint").alias("target"))


def rebalance_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rebalance_impact(_moves(spark, sf_dir), 300)


def cluster_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("cluster_id"))
    return L.moved(own, _moves(spark, sf_dir))


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = interactions(spark, sf_dir)
    return L.search_stats(x.select("ts", F.col("value").alias("ms"), (F.col("document_id") % 4).alias("results"), (F.col("position") > 14).alias("cached")))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string")
    filters = F.when(F.col("label") % 2 == 0, F.create_map(F.lit("label"), label, F.lit("kind"), F.lit("x")))
    key = lambda n: L.cache_key(F.lit("all"), F.col("embedding"), F.lit(10), F.lit("cosine"), filters, F.when(F.col("label") > 4, label), F.col("label") == 3, n)
    return v.select("vec_id", key(None).alias("key"), key(8).alias("short_key"), D.round6(L.adaptive_ttl(F.col("vec_id").cast("double"))).alias("ttl"))


def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asked of all, by labels as clusters whose radius is 0.9."""
    v = vectors(spark, sf_dir)
    past = v.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("cluster_id")), "id")
    clusters = label_centroids(spark, sf_dir).select("cluster_id", "centroid", F.lit(0.9).alias("radius"))
    return L.semantic_lookup(v.where("id % 50 = 0"), past.select("id", "vector", "cluster_id"), clusters, 0.2)


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 97).alias("partition_id"), "ts")


def partition_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.partitions(_accesses(spark, sf_dir), "2024-01-31 00:00:00")


def partitions_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hot(partition_temperature(spark, sf_dir))


def partitions_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cold(partition_temperature(spark, sf_dir), "2024-01-31 00:00:00", 36_000)


def partition_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.access_analysis(_accesses(spark, sf_dir), "2024-01-31 00:00:00")


QUERIES = {f.__name__: f for f in (interaction_filter, interaction_filter_limited, feedback_lookup, session_lifecycle, session_active, search_weights, query_interests, interaction_interests, personalized_search, rerank_features, query_plans, plan_means, index_choice, progressive_confidence, coarse_queries, model_registry, memory_estimate, rebalance_impact, cluster_moved, search_stats, cache_keys, semantic_cache, partition_temperature, partitions_hot, partitions_cold, partition_access)}

_SESSIONS = "ss AS (SELECT event_id AS session_id, user_id, ts AS start, CASE WHEN event_id % 2 = 0 THEN ts + to_minutes(floor(value % 60)::INT) END AS stop FROM events WHERE event_type IN ('signup', 'purchase'))"
_LIFE = f"""{_SESSIONS}, lf AS (SELECT session_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, session_id) AS nth, start, start + INTERVAL 1 DAY AS expires,
    CASE WHEN start > TIMESTAMP '{AS_OF}' THEN 'future' WHEN stop <= TIMESTAMP '{AS_OF}' THEN 'ended' WHEN start + INTERVAL 1 DAY < TIMESTAMP '{AS_OF}' THEN 'expired' ELSE 'active' END AS state FROM ss)"""
_TOP = f"{_INDEX}, {_HITS}, bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM h QUALIFY rank <= 20)"
_QI = "qi AS (SELECT query_id % 10 AS user_id, query_id AS list_id, topic, round(sum(0.1::DOUBLE / rank), 6) AS value FROM (SELECT query_id, rank, unnest([lang, source]) AS topic FROM bm JOIN documents ON doc_id = id WHERE rank <= 5) GROUP BY ALL)"
_COLL = "co AS (SELECT p_brand AS collection, (sum(p_size) * sum(p_size))::BIGINT AS vectors, 64 AS dimension, avg(p_size) AS m FROM part GROUP BY 1), cl AS (SELECT *, CASE WHEN vectors % 2 = 0 THEN 'hnsw' ELSE 'flat' END AS index_type, m - 15 AS updates, m * 4 AS qps FROM co)"
_PART = "pt AS (SELECT user_id % 97 AS partition_id, count(*) AS accesses, min(ts) AS a, max(ts) AS last FROM events GROUP BY 1), pp AS (SELECT partition_id, accesses, last, round(0.7::DOUBLE / (1 + (epoch(TIMESTAMP '2024-01-31') - floor(epoch(last))) / 3600) + 0.3::DOUBLE * CASE WHEN accesses > 1 AND floor(epoch(last)) > floor(epoch(a)) THEN accesses / ((floor(epoch(last)) - floor(epoch(a))) / 3600) ELSE 0 END, 6) AS temperature FROM pt)"
_CENTROIDS = "cen AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(embedding[d]::DOUBLE) AS m FROM embeddings, range(1, 65) t(d) GROUP BY ALL) GROUP BY label)"
_KEY = "sha256('all|' || array_to_string(list_transform({v}, lambda x: printf('%.4f', x::DOUBLE)), '') || '|len:64|k:10|' || CASE WHEN label % 2 = 0 THEN 'kind:x|label:' || label || '|' ELSE '' END || 'cosine|' || CASE WHEN label > 4 THEN 'user:' || label || '|' ELSE '' END || 'vec:' || CASE WHEN label = 3 THEN 'true' ELSE 'false' END)"
_MOVES = "mv AS (SELECT vec_id AS id, label AS source, (label + 1) % 10 AS target FROM embeddings WHERE vec_id % 3 = 0)"

ORACLE_SQL = {
    "interaction_filter": f"WITH {_X} SELECT * FROM x WHERE type = 'click' AND document_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'",
    "interaction_filter_limited": f"WITH {_X} SELECT * FROM x WHERE type = 'impression' ORDER BY ts, user_id, query_id, document_id LIMIT 25",
    "feedback_lookup": f"WITH {_X}, f AS ({_ctr('document_id', 'document_id')}) SELECT * FROM f WHERE document_id IN (SELECT document_id FROM x WHERE query_id = 9 AND type = 'click')",
    "session_lifecycle": f"WITH {_LIFE} SELECT * FROM lf",
    "session_active": f"WITH {_LIFE} SELECT user_id, arg_max(session_id, nth) AS session_id FROM lf WHERE state = 'active' GROUP BY user_id",
    "search_weights": """WITH pf AS (SELECT user_id, max(event_id) % 10 / 10 AS pv, 0.3::DOUBLE AS pt FROM events WHERE user_id % 3 = 0 GROUP BY user_id),
        r AS (SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN value % 2 END, CASE WHEN event_id % 3 > 0 THEN pv END, 0.5::DOUBLE) AS v, coalesce(CASE WHEN event_id % 4 = 1 THEN 0.25::DOUBLE END, CASE WHEN event_id % 3 > 0 THEN pt END, 0.5::DOUBLE) AS t, event_id % 5 < 2 AS has, event_id % 7 < 4 AS asked FROM events LEFT JOIN pf USING (user_id))
        SELECT event_id AS request_id, round(CASE WHEN v + t > 0 THEN v / (v + t) ELSE v END, 6) AS vector_weight, round(CASE WHEN v + t > 0 THEN t / (v + t) ELSE t END, 6) AS text_weight,
        CASE WHEN event_id % 4 = 2 THEN 'text' WHEN has AND asked THEN 'hybrid' WHEN has THEN 'vector' WHEN asked THEN 'text' WHEN v > t THEN 'vector' ELSE 'text' END AS mode FROM r""",
    "query_interests": f"WITH {_TOP}, {_QI} SELECT * FROM qi",
    "interaction_interests": f"WITH {_X}, g AS (SELECT user_id, ts, document_id, CASE type WHEN 'click' THEN 0.3::DOUBLE WHEN 'dwell' THEN value / 60 WHEN 'rating' THEN value / 5 WHEN 'bookmark' THEN 1 ELSE 0 END AS value FROM x) SELECT user_id, ts, unnest([lang, source]) AS topic, round(value, 6) AS value FROM g JOIN documents ON doc_id = document_id WHERE value > 0",
    "personalized_search": f"""WITH {_TOP}, {_QI}, it AS (SELECT user_id, topic, round(sum(value), 6) AS score FROM qi GROUP BY ALL), sto AS (SELECT doc_id AS id, [lang, source] AS topics FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
        b AS (SELECT query_id, sto.id, score, unnest(topics) AS topic FROM bm JOIN sto USING (id)), s AS (SELECT b.query_id, b.id, round(b.score * product(1 + 0.2::DOUBLE * coalesce(it.score, 0)), 6) AS score FROM b LEFT JOIN it ON it.user_id = b.query_id % 10 AND it.topic = b.topic GROUP BY b.query_id, b.id, b.score)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 10""",
    "rerank_features": f"""WITH {_X}, r AS (SELECT * FROM x WHERE type = 'click'), own AS (SELECT user_id, document_id, count(*) FILTER (type = 'click')::DOUBLE AS c, coalesce(avg(value) FILTER (type = 'dwell'), 0) AS d FROM x GROUP BY ALL), n AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1),
        kn AS (SELECT DISTINCT user_id, unnest([document_id % 3, document_id % 5]) AS topic FROM x), lk AS (SELECT user_id, document_id % 5 AS topic, round(avg(value), 4) AS score FROM x WHERE type = 'dwell' GROUP BY ALL), pr AS (SELECT DISTINCT user_id FROM lk)
        SELECT query_id AS list_id, document_id AS id, round(1 / position, 6) AS original_score, round(value / 100, 6) AS vector_score, 0.5::DOUBLE AS text_score, round(abs(value / 100 - 0.5), 6) + 0.0 AS score_variance, position::DOUBLE AS original_position, round(1 / position, 6) AS inverse_position,
        round(ln(1 + document_id * 3), 6) AS document_popularity, round(value % 5, 6) AS document_rating, round(1 / (1 + (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600 / 24), 6) AS document_freshness, CASE WHEN document_id % 2 = 0 THEN 0.8::DOUBLE END AS source_authority,
        CASE WHEN user_id IN (FROM pr) THEN round((coalesce((SELECT score FROM lk WHERE lk.user_id = r.user_id AND topic = document_id % 3), 0) + coalesce((SELECT score FROM lk WHERE lk.user_id = r.user_id AND topic = document_id % 5), 0)) / 2, 6) END AS topic_relevance,
        own.c AS user_doc_clicks, round(own.d, 6) AS user_doc_dwell, 1.0::DOUBLE AS session_topic_consistency, CASE WHEN n > 5 THEN 0.8::DOUBLE ELSE 0.2 END AS session_diversity_needed, strlen('query ' || query_id)::DOUBLE AS query_length, round(least(1, strlen('query ' || query_id) // 5 / 10), 6) AS query_complexity
        FROM r JOIN own USING (user_id, document_id) JOIN n USING (user_id)""",
    "query_plans": f"""WITH {_COLL}, pa AS (SELECT p_name, count(*) % 15 AS f, avg((p_size > 25)::INT) AS h FROM part GROUP BY 1), r AS (SELECT p_partkey, p_size AS k, p_partkey % 3 = 0 AS fil, cl.*, f, h FROM part JOIN cl ON collection = p_brand JOIN pa USING (p_name))
        SELECT p_partkey AS request_id, (CASE WHEN vectors < 1000 THEN k WHEN updates > 10 THEN floor(k * 1.2::DOUBLE) WHEN index_type = 'hnsw' AND vectors > 100000 THEN floor(k * 1.1::DOUBLE) ELSE k END)::INT AS optimal_k, (index_type = 'flat' AND k <= 10 AND vectors < 10000) OR (index_type = 'hnsw' AND NOT fil) AS fast_path,
        CASE WHEN vectors < 10000 THEN 1 WHEN vectors < 100000 THEN 2 WHEN vectors < 1000000 THEN 4 ELSE 8 END::INT AS parallel, round(vectors * dimension * 0.001::DOUBLE * CASE WHEN index_type = 'hnsw' THEN 0.1::DOUBLE ELSE 1 END * CASE WHEN fil THEN 1.5::DOUBLE ELSE 1 END * k * 0.1::DOUBLE, 6) AS cost, f > 10 OR h > 0.5 AS cache FROM r""",
    "plan_means": f"""WITH RECURSIVE {_X}, g AS (SELECT query_id AS plan_id, floor(value)::BIGINT AS ms, position AS results, row_number() OVER (PARTITION BY query_id ORDER BY ts, floor(value), position) AS i FROM x),
        r AS (SELECT plan_id, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b FROM g GROUP BY 1 UNION ALL SELECT plan_id, n + 1, (a * n + ms) // (n + 1), (b * n + results) // (n + 1) FROM r JOIN g USING (plan_id) WHERE i = n + 1)
        SELECT plan_id, n, a AS mean_ms, b AS mean_results FROM r QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY n DESC) = 1""",
    "index_choice": f"""WITH {_COLL}, pf AS (SELECT * FROM (VALUES {", ".join(f"('{p[0]}', " + ", ".join(f"{x}::DOUBLE" for x in p[1:]) + ")" for p in PROFILES)}) t(kind, l, i, m2, a, lo, hi)),
        s AS (SELECT collection, kind, round(CASE WHEN vectors BETWEEN lo AND hi THEN l * CASE WHEN qps > 100 THEN 0.6::DOUBLE ELSE 0.4 END + i * CASE WHEN qps > 100 THEN 0.1::DOUBLE ELSE 0.2 END + m2 * 0.2::DOUBLE + a * 0.2::DOUBLE ELSE 0 END, 6) AS score FROM cl, pf)
        SELECT collection, kind AS index_type, score FROM s QUALIFY row_number() OVER (PARTITION BY collection ORDER BY score DESC, kind) = 1""",
    "progressive_confidence": f"WITH {_X} SELECT query_id, document_id, ts, round(least(1, 0.7::DOUBLE * (position / 20) + CASE WHEN value / 100 > 0.2 THEN 0.2::DOUBLE WHEN value / 100 > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN document_id > 25 THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence FROM x",
    "coarse_queries": f"""WITH {_CENTROIDS}, n AS (SELECT vec_id, label AS l, c, round(list_distance(embedding::DOUBLE[], c), 6) AS dist FROM (SELECT vec_id, embedding FROM embeddings), cen QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, l) <= 3)
        SELECT vec_id AS query_id, (d - 1)::INT AS d, round(sum(c[d] / (dist + 0.1)) / sum(1 / (dist + 0.1)), 6) + 0.0 AS x FROM n, range(1, 17) t(d) GROUP BY ALL""",
    "model_registry": """WITH m AS (SELECT s_name AS name, [['en', 'fr', 'de'][s_nationkey % 3 + 1], ['es', 'en'][s_suppkey % 2 + 1]] AS languages, 128 * (s_suppkey % 8 + 1) AS dimension, [['fast', 'small', 'large'][s_suppkey % 3 + 1], ['code', 'chat'][s_nationkey % 2 + 1]] AS tags, s_suppkey % 100 / 100 AS accuracy, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS throughput, s_nationkey * 10000000 AS bytes FROM supplier)
        SELECT name, round(accuracy * 0.4::DOUBLE + len(list_intersect(tags, ['fast', 'code'])) / 2 * 0.3::DOUBLE + coalesce(throughput / 1000 * 0.2::DOUBLE, 0) + CASE WHEN bytes > 0 THEN 100 / (bytes / 1048576) ELSE 0 END, 6) AS relevance FROM m WHERE list_has_any(languages, ['en', 'fr']) AND list_has_any(tags, ['fast', 'code']) AND dimension BETWEEN 256 AND 896""",
    "memory_estimate": f"WITH {_COLL} SELECT collection, vectors * 64 AS base, vectors * 16 AS codes, vectors * 256 AS originals, vectors * 336 AS total FROM cl",
    "rebalance_impact": f"WITH {_MOVES} SELECT count(*) AS moves, count(*) * 10 AS ms, (SELECT count(DISTINCT c) FROM (SELECT source AS c FROM mv UNION ALL SELECT target FROM mv))::INT AS clusters, CASE WHEN count(*) > 150 THEN 'moderate' ELSE 'minimal' END AS impact FROM mv",
    "cluster_moved": f"WITH {_MOVES} SELECT vec_id AS id, coalesce(target, label)::BIGINT AS cluster_id FROM embeddings LEFT JOIN mv ON id = vec_id",
    "search_stats": f"WITH {_X}, l AS (SELECT list_sort(list(value)) AS v FROM (SELECT value FROM x ORDER BY ts DESC LIMIT 1000)) SELECT count(*) AS queries, round(avg(value), 6) AS mean_ms, round(avg((document_id % 4 > 0)::INT), 6) AS success_rate, round(avg((position > 14)::INT), 6) AS hit_rate, (SELECT v[floor(len(v) * 0.95::DOUBLE)::INT + 1] FROM l) AS p95_ms FROM x",
    "cache_keys": f"SELECT vec_id, {_KEY.format(v='embedding')} AS key, {_KEY.format(v='embedding[1:8]')} AS short_key, round(least(300, greatest(30, vec_id / 2)), 6)::DOUBLE AS ttl FROM embeddings",
    "semantic_cache": f"""WITH {_CENTROIDS}, q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), i AS (SELECT vec_id, v, cen.label FROM q, cen WHERE round(1 - list_cosine_similarity(v, c), 6) <= 0.9)
        SELECT i.vec_id AS query_id, e.vec_id AS id, e.label::BIGINT AS cluster_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS confidence FROM i JOIN embeddings e USING (label) WHERE round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) >= 0.2""",
    "partition_temperature": f"WITH {_PART} SELECT * FROM pp",
    "partitions_hot": f"WITH {_PART} SELECT partition_id, row_number() OVER (ORDER BY temperature DESC, partition_id) AS rank, temperature FROM pp WHERE accesses >= 5 QUALIFY rank <= 10",
    "partitions_cold": f"WITH {_PART} SELECT partition_id FROM pp WHERE temperature < 0.1 AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(last)) > 36000",
    "partition_access": f"""WITH {_PART}, h AS (SELECT hour(ts) AS hr, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hr LIMIT 1)
        SELECT count(*) AS partitions, count(*) FILTER (temperature > 0.5) AS hot, count(*) FILTER (temperature <= 0.5) AS cold, sum(accesses)::BIGINT AS accesses, round(avg(temperature), 6) AS temperature, (SELECT hr FROM h)::INT AS peak_hour, (SELECT n FROM h) AS peak_accesses FROM pp""",
}
