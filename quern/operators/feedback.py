"""Click and session analytics over interactions.

interactions are (user_id, query_id, document_id, position, type, value, ts); types are impression, click, dwell, rating,
bookmark, share, negative.  Every roll-up is one aggregation.  Null keys make a group of their own, null values count as 0.
Order matters only where said; it is by ts and then by the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import distance as D

is_ = lambda t: F.col("type") == t
_count = lambda c: F.count(F.when(c, 1))
#: Copies of a row that are made at once.
MOST = 1024


def ctr(interactions: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    """name, impressions, clicks, ctr, avg_position (of impressions), avg_dwell (of clicks with a value), confidence 1 - 1 / (impressions + 1)."""
    key = F.col(key) if isinstance(key, str) else key
    seen, hit = is_("impression"), is_("click")
    rows = interactions.groupBy(key.alias(name)).agg(_count(seen).alias("impressions"), _count(hit).alias("clicks"), F.avg(F.when(seen, F.col("position"))).alias("p"), F.avg(F.when(hit & (F.col("value") > 0), F.col("value"))).alias("d"))
    return rows.select(name, "impressions", "clicks", D.round6(rate(F.col("clicks"), F.col("impressions"))).alias("ctr"), D.round6(F.coalesce("p", F.lit(0.0))).alias("avg_position"), D.round6(F.coalesce("d", F.lit(0.0))).alias("avg_dwell"), D.round6(1 - 1 / (F.col("impressions") + 1)).alias("confidence"))


def rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def hourly(interactions: DataFrame) -> DataFrame:
    """hour, impressions, clicks, ctr for hours of the day that have impressions."""
    return ctr(interactions, F.hour("ts"), "hour").where("impressions > 0").select("hour", "impressions", "clicks", "ctr")


def report(interactions: DataFrame, documents: int = 10, least_documents: int = 10, least_queries: int = 5) -> DataFrame:
    """section, key, impressions, clicks, ctr: the total, the best documents and queries with enough impressions, positions and hours."""
    part = lambda df, section: df.select(F.lit(section).alias("section"), F.col(df.columns[0]).cast("string").alias("key"), "impressions", "clicks", "ctr")
    best = lambda key, least: ctr(interactions, key).where(F.col("impressions") >= least).orderBy(F.col("ctr").desc(), "key").limit(documents)
    out = part(ctr(interactions, F.lit("all")), "total")
    for df, section in ((best("document_id", least_documents), "documents"), (best("query_id", least_queries), "queries"), (ctr(interactions.where("position > 0"), "position"), "positions"), (hourly(interactions), "hours")):
        out = out.unionByName(part(df, section))
    return out


def attributed(clicks: DataFrame, impressions: DataFrame) -> DataFrame:
    """Each click with the first impression of its query and document: the click's columns, first_position, first_ts, null where there is none."""
    first = impressions.groupBy("query_id", "document_id").agg(F.min_by("position", F.struct("ts", "position")).alias("first_position"), F.min("ts").alias("first_ts"))
    return clicks.join(first, ["query_id", "document_id"], "left")


def document_feedback(interactions: DataFrame) -> DataFrame:
    """document_id, views (all interactions), clicks, ctr, avg_rating, ratings, avg_dwell.

    The running dwell mean weighs by the interactions so far: the j-th dwell, after i others of its document, makes it (mean * i + value) / (i + 1).  So a dwell
    counts value / (i + 1) times i / (i + 1) of each later dwell, which windows sum without holding a document's history.
    """
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("ts", "query_id", "type", F.coalesce("value", F.lit(0.0)))) - 1
    dwells = interactions.select("document_id", "ts", "query_id", "type", "value").withColumn("i", nth).where(is_("dwell"))
    later = F.sum(F.when(F.col("i") > 0, F.log(F.col("i") / (F.col("i") + 1)))).over(Window.partitionBy("document_id").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1))
    mean = dwells.withColumn("x", F.coalesce("value", F.lit(0.0)) / (F.col("i") + 1) * F.exp(F.coalesce(later, F.lit(0.0)))).groupBy("document_id").agg(F.sum("x").alias("dwell"))
    rows = interactions.groupBy("document_id").agg(F.count(F.lit(1)).alias("views"), _count(is_("click")).alias("clicks"), F.avg(F.when(is_("rating"), F.col("value"))).alias("r"), _count(is_("rating")).alias("ratings"))
    rows = rows.join(mean.withColumnRenamed("document_id", "d"), F.col("document_id").eqNullSafe(F.col("d")), "left")
    return rows.select("document_id", "views", "clicks", D.round6(F.col("clicks") / F.col("views")).alias("ctr"), D.round6(F.coalesce("r", F.lit(0.0))).alias("avg_rating"), "ratings", D.round6(F.coalesce("dwell", F.lit(0.0))).alias("avg_dwell"))


def quality(feedback: DataFrame) -> DataFrame:
    """document_id, quality: 0.3 ctr + 0.4 rating / 5 + 0.3 min(dwell / 60, 1), each where there is any, kept in 0 to 1."""
    q = F.when(F.col("views") > 0, 0.3 * F.col("ctr")).otherwise(0.0) + F.when(F.col("ratings") > 0, 0.4 * F.col("avg_rating") / 5).otherwise(0.0) + F.when(F.col("avg_dwell") > 0, 0.3 * F.least(F.col("avg_dwell") / 60, F.lit(1.0))).otherwise(0.0)
    return feedback.select("document_id", D.round6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).alias("quality"))


def satisfaction(interactions: DataFrame) -> DataFrame:
    """query_id, score, satisfied (score over 0.3), confidence by rules on clicks, dwell and bad ratings."""
    last, n = F.max(F.when(is_("click"), F.col("position"))), _count(is_("click"))
    dwell = F.avg(F.when(is_("dwell"), F.col("value")))
    bad = F.coalesce(F.bool_or((is_("rating") & (F.col("value") < 3)) | is_("negative")), F.lit(False))
    g = interactions.groupBy("query_id").agg(n.alias("n"), last.alias("last"), dwell.alias("dwell"), bad.alias("bad"))
    near, far = (F.col("n") > 0) & (F.col("last") <= 3), (F.col("n") > 0) & (F.col("last") <= 5)
    score = F.when(near, 0.4).when(far, 0.2).otherwise(0.0) - F.when(F.col("n") >= 3, 0.1).otherwise(0.0) + F.when(F.col("dwell") > 30, 0.3).when(F.col("dwell") > 10, 0.1).otherwise(0.0)
    sure = F.when(near, 0.3).when(far, 0.2).otherwise(0.0) + F.when(F.col("dwell") > 30, 0.3).when(F.col("dwell") > 10, 0.2).otherwise(0.0)
    score, sure = F.when(F.col("bad"), 0.0).otherwise(score), F.when(F.col("bad"), 1.0).otherwise(F.least(F.lit(1.0), sure))
    return g.select("query_id", D.round6(score).alias("score"), (F.round(score, 6) > 0.3).alias("satisfied"), D.round6(sure).alias("confidence"))


def click_pattern(interactions: DataFrame) -> DataFrame:
    """query_id, clicks, avg_position, positions (ascending), pattern and position_bias; no_clicks where there are none."""
    g = interactions.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(is_("click"), F.col("position")))).alias("positions"), F.avg(F.when(is_("click"), F.col("position"))).alias("p"))
    pattern = F.when(F.col("p").isNull(), "no_clicks").when(F.col("p") <= 2, "top_heavy").when(F.col("p") <= 5, "moderate").otherwise("exploratory")
    bias = F.when(F.col("p") <= 2, "high").when(F.col("p") <= 5, "medium").when(F.col("p").isNotNull(), "low")
    return g.select("query_id", F.size("positions").cast("bigint").alias("clicks"), D.round6(F.col("p")).alias("avg_position"), "positions", pattern.alias("pattern"), bias.alias("position_bias"))


def anomalies(interactions: DataFrame, clicks: int = 10, per_second: float = 1.0, ratings: int = 5) -> DataFrame:
    """user_id, anomaly: rapid_clicking (more than `clicks`, over per_second of them a second) and excessive_negative_ratings (more than `ratings` under 2)."""
    hit = F.when(is_("click"), F.col("ts"))
    g = interactions.groupBy("user_id").agg(F.count(hit).alias("n"), (F.unix_micros(F.max(hit).cast("timestamp")) - F.unix_micros(F.min(hit).cast("timestamp"))).alias("us"), _count(is_("rating") & (F.col("value") < 2)).alias("bad"))
    rapid = (F.col("n") > clicks) & (F.col("n") * 1e6 > per_second * F.col("us"))
    found = F.filter(F.array(F.when(rapid, F.lit("rapid_clicking")), F.when(F.col("bad") > ratings, F.lit("excessive_negative_ratings"))), lambda x: x.isNotNull())
    return g.select("user_id", F.explode(found).alias("anomaly"))


def click_model(interactions: DataFrame, alpha: float = 1.0, beta: float = 0.5, positions: int = 20) -> DataFrame:
    """alpha, beta after an update with the clicks by position, 0.9 old and 0.1 new; as they were where nothing was clicked."""
    by = interactions.where(F.col("position").between(1, positions)).groupBy("position").agg(F.count(F.lit(1)).alias("n"), _count(is_("click")).alias("c")).where("c > 0")
    both = by.agg(F.count(F.lit(1)).alias("m"), F.sum(F.log(F.col("c") / F.col("n")) * F.col("c")).alias("a"), F.sum(F.log("position") * F.col("c")).alias("b"))
    new = lambda old, value: F.when(F.col("m") > 0, 0.9 * old + 0.1 * value).otherwise(old)
    return both.select(D.round6(new(alpha, F.exp(F.col("a") / F.col("m")))).alias("alpha"), D.round6(new(beta, -F.col("b") / F.col("m"))).alias("beta"))


def click_probability(position: Column, relevance: Column | float = 0.5, alpha: float = 1.0, beta: float = 0.5) -> Column:
    """alpha * position ** -beta * relevance, kept in 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha * F.pow(position, F.lit(-beta)) * relevance))


def position_bias(interactions: DataFrame, positions: int = 20) -> DataFrame:
    """position, bias: 0.9 of the first guess, position ** -0.5, and 0.1 of the share of clicks."""
    by = interactions.where(F.col("position").between(1, positions)).groupBy("position").agg((_count(is_("click")) / F.count(F.lit(1))).alias("r"))
    return by.select("position", D.round6(0.9 * F.pow("position", F.lit(-0.5)) + 0.1 * F.col("r")).alias("bias"))


def pairwise(interactions: DataFrame, block: int = 8192) -> DataFrame:
    """query_id, doc1, doc2, label, pos_diff, pos_ratio: pairs of a query's interactions, in order of position, with a clicked one.

    label is 1 if only the first's position was clicked, 0 if only the second's, else by value, 0.5 for equal values.  Where interactions have a
    score or views, score_diff and views_diff (of ln(1 + views)) are given too, null where one side has none.  Pairs that give equal rows are
    counted first and written out last, so that a row costs no comparison.
    """
    found = ["query_id", F.col("document_id1").alias("doc1"), F.col("document_id2").alias("doc2"), "label", (F.col("position2") - F.col("position1")).cast("double").alias("pos_diff"), D.round6(F.col("position1") / F.col("position2")).alias("pos_ratio")]
    if "score" in interactions.columns:
        found.append(D.round6(F.col("score1") - F.col("score2")).alias("score_diff"))
    if "views" in interactions.columns:
        found.append(D.round6(F.log1p(F.col("views1").cast("double")) - F.log1p(F.col("views2").cast("double"))).alias("views_diff"))
    return repeated(pair_counts(interactions, block).select(*found, "times"), "times")


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column `times` says, without that column.  Spark holds all copies of a row at once, so times must be small (MOST)."""
    return rows.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).drop(times)


def pair_counts(interactions: DataFrame, block: int = 8192) -> DataFrame:
    """query_id, the documents, positions (scores, views) of both sides, label, times: pairs of a query as in pairwise, counted; a row comes in parts of at most MOST.

    A query's rows are cut into blocks in their order, and each two blocks meet in a task of their own, which holds just these.
    """
    w = Window.partitionBy("query_id")
    hit = F.coalesce(F.max(is_("click").cast("int")).over(Window.partitionBy("query_id", "position")), F.lit(-1))
    nth = F.row_number().over(w.orderBy("position", "ts", "document_id")) - 1
    shown = ["document_id", "position", *(c for c in ("score", "views") if c in interactions.columns)]
    rows = interactions.where("query_id is not null").select("query_id", *shown, "value", hit.alias("hit"), nth.alias("nth"), F.count(F.lit(1)).over(w).alias("n"))
    own = F.floor(F.col("nth") / block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))))
    rows = rows.select("query_id", *shown, "value", "hit", "nth", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"))

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pa.Table.from_batches(list(batches))
        at = at.take(np.argsort(at["nth"].to_numpy())).combine_chunks()
        cells, first = _codes(at, shown)
        hits, values = at["hit"].to_numpy(), _ranks(at["value"].combine_chunks())
        i, j = key[1].as_py(), key[2].as_py()
        found = _pairs_within(cells, hits, values) if i == j else _pairs_across(*(x[part] for part in np.split(np.arange(at.num_rows), [int(np.searchsorted(at["nth"].to_numpy(), j * block))]) for x in (cells, hits, values)))
        for a, b, label, times in _gathered(map(_parts, found)):
            sides = [at[c].combine_chunks().take(pa.array(first[x])) for x in (a, b) for c in shown]
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(a)), *sides, pa.array(np.array([0.0, 0.5, 1.0])[label]), pa.array(times)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in interactions.schema}
    columns = {"query_id": kinds["query_id"]} | {f"{c}{side}": kinds[c] for side in (1, 2) for c in shown} | {"label": "double", "times": "bigint"}
    names = list(columns)
    # a number of its own: few bytes stand for many pairs, so Spark must not put the partitions together by their size
    rows = rows.repartition(int(interactions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "i", "j")
    return rows.groupBy("query_id", "i", "j").applyInArrow(work, ", ".join(f"{c} {kind}" for c, kind in columns.items()))


def _codes(rows: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, the same for rows that agree in the columns, nulls too; the first row of each number."""
    code = np.zeros(rows.num_rows, "int64")
    for c in columns:
        d = rows[c].combine_chunks().dictionary_encode("encode")
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(), return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def _ranks(values: pa.Array) -> np.ndarray:
    """Places among the different values, NaN last; -1 for null."""
    out = np.full(len(values), -1, "int64")
    out[values.is_valid().to_numpy(zero_copy_only=False)] = np.unique(values.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def _pairs_across(cells1: np.ndarray, hits1: np.ndarray, values1: np.ndarray, cells2: np.ndarray, hits2: np.ndarray, values2: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells, label (0, 1, 2 for 0, 0.5, 1) and number of the pairs of a first row and a second one.  A cell's rows have the same hit: 1, 0, or -1 for unknown."""
    by = np.argsort(cells1, kind="stable")
    starts = np.flatnonzero(np.diff(cells1[by], prepend=-1))
    cells, hits, values, sizes = cells1[by][starts], hits1[by][starts], values1[by], np.diff(starts, append=len(by))
    by2 = np.lexsort((values2, cells2))
    starts2 = np.flatnonzero(np.diff(cells2[by2], prepend=-1))
    for rows in np.split(by2, starts2[1:]):
        hit, v = hits2[rows[0]], values2[rows]
        pairs = sizes * len(rows) * ((hits == 1) | (hit == 1))
        if not pairs.any():
            continue
        v = v[v >= 0]
        more = np.add.reduceat(np.where(values >= 0, np.searchsorted(v, values, "left"), 0), starts)
        less = np.add.reduceat(np.where(values >= 0, len(v) - np.searchsorted(v, values, "right"), 0), starts)
        more = np.where((hits == 1) & (hit == 0), pairs, np.where((hits == 0) & (hit == 1), 0, np.minimum(more, pairs)))
        less = np.where((hits == 0) & (hit == 1), pairs, np.where((hits == 1) & (hit == 0), 0, np.minimum(less, pairs)))
        for label, times in enumerate((less, pairs - more - less, more)):
            k = np.flatnonzero(times)
            yield cells[k], np.full(len(k), cells2[rows[0]]), np.full(len(k), label), times[k]


def _pairs_within(cells: np.ndarray, hits: np.ndarray, values: np.ndarray, least: int = 256) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for pairs of rows of which the first comes before the second: by halves, and one by one where there are few."""
    if (n := len(cells)) > least:
        a, b = ([x[part] for x in (cells, hits, values)] for part in (slice(n // 2), slice(n // 2, n)))
        yield from _pairs_within(*a, least)
        yield from _pairs_within(*b, least)
        yield from _pairs_across(*a, *b)
        return
    own, cell = np.unique(cells, return_inverse=True)
    a, b = np.triu_indices(n, 1)
    keep = (hits[a] == 1) | (hits[b] == 1)
    a, b = a[keep], b[keep]
    label = np.where((values[a] < 0) | (values[b] < 0), 1, 1 + np.sign(values[a] - values[b]))
    label = np.where((hits[a] == 1) & (hits[b] == 0), 2, np.where((hits[a] == 0) & (hits[b] == 1), 0, label))
    times = np.bincount((cell[a] * len(own) + cell[b]) * 3 + label)
    k = np.flatnonzero(times)
    yield own[k // 3 // len(own)], own[k // 3 % len(own)], k % 3, times[k]


def _parts(found: tuple[np.ndarray, ...], most: int = MOST) -> tuple[np.ndarray, ...]:
    """The same with rows of more than `most` times cut into several."""
    *rows, times = found
    n = -(-times // most)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return *(np.repeat(x, n) for x in rows), np.minimum(np.repeat(times, n) - nth * most, most)


def _gathered(found: Iterator[tuple[np.ndarray, ...]], least: int = 10_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in fewer, larger arrays."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def relevance(features: Column, weights: dict[str, float]) -> Column:
    """Logistic function of 0.5 and the weighted sum of a map of features."""
    total = F.lit(0.5)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def optimal_ranking(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    """list_id, rank, document_id, score of candidates(list_id, position, document_id): half the document's ctr over the ctr of the place it is in."""
    docs = ctr(interactions, "document_id", "document_id").select("document_id", F.col("ctr").alias("own"))
    places = ctr(interactions, "position", "position").select("position", F.col("ctr").alias("place"))
    rows = candidates.join(docs, "document_id", "left").join(places, "position", "left")
    score = F.coalesce(F.col("own") * 0.5, F.lit(0.0))
    score = D.round6(F.when(F.col("place") > 0, score / F.col("place")).otherwise(score))
    rows = rows.withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy(F.col("score").desc(), "position"))).select("list_id", "rank", "document_id", "score")


def sessions(interactions: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """user_id, session, start, end, events by gaps: a new session begins timeout_s after the last event."""
    g = interactions.groupBy("user_id", F.session_window("ts", f"{timeout_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("end"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("w.start"))
    return g.select("user_id", nth.alias("session"), F.col("w.start").alias("start"), "end", "events")


def sessions_from_start(interactions: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """user_id, session, start, events: a session lasts timeout_s from its first event, whatever follows.

    A user's events come sorted and pass once; only the session at hand is held.  Null users have no sessions, events without a time belong to none.
    """
    step = timeout_s * 1_000_000

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, nth, start, events = None, 0, 0, 0
        for batch in batches:
            users, ts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out, i = [], 0
            while i < len(users):
                if user != users[i] or ts[i] - start > step:
                    if events:
                        out.append((user, nth, start, events))
                    user, nth, start, events = int(users[i]), (nth + 1 if user == users[i] else 1), int(ts[i]), 0
                end = i + int(np.searchsorted(users[i:], user, "right"))
                stop = i + int(np.searchsorted(ts[i:end], start + step, "right"))
                events, i = events + stop - i, stop
            yield _session_rows(out)
        yield _session_rows([(user, nth, start, events)] if events else [])

    rows = interactions.where("user_id is not null and ts is not null").select(F.col("user_id").cast("bigint").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "t").mapInArrow(work, "user_id bigint, session int, start bigint, events bigint")
    return rows.select("user_id", "session", F.timestamp_micros("start").cast("timestamp_ntz").alias("start"), "events")


def _session_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["user_id", "session", "start", "events"])


def top_interests(scores: DataFrame, n: int = 5) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "topic")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def latency(log: DataFrame, last: int = 1000) -> DataFrame:
    """key, n, mean, p50, p95, p99 of the last values by ts of log(key, ts, value); a percentile is the value at place n * p, from 0."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("ts").desc()))
    g = log.withColumn("nth", nth).where(F.col("nth") <= last).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda p: F.get("v", F.least(F.col("n") - 1, F.floor(F.col("n") * p)).cast("int"))
    return g.select("key", "n", D.round6(F.col("mean")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


AUTHORITY = {"wikipedia": 0.9, "arxiv": 0.85, "github": 0.8, "stackoverflow": 0.75, "medium": 0.6, "blog": 0.5}
FEATURES = {"vector_score": 0.5, "text_score": 0.5, "score_variance": -0.1, "document_popularity": 0.2, "document_rating": 0.3, "document_freshness": 0.15, "source_authority": 0.25}


def rerank(results: DataFrame, as_of: str, interest: Column | None = None, weights: dict[str, float] = FEATURES) -> DataFrame:
    """list_id, rank, id, score of results(list_id, position, id, score, vector_score, text_score, views, rating, created, source, topics).

    The score and its weighted features, twice the score itself; times 1 + 0.2 of the interest (a map by topic) in each topic, 0.8 + 0.2 exp(-days / 30) and
    1 - 0.3 of the greatest Jaccard share of topics with a result that stood before it.  Null features count as 0.  A result is compared with each
    list of topics that stood before it once, however many results have that list.
    """
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("created").cast("timestamp"))) / 86400
    source = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair)), F.col("source")), F.lit(0.5))
    value = {"vector_score": F.col("vector_score"), "text_score": F.col("text_score"), "score_variance": F.abs(F.col("vector_score") - F.col("text_score")), "document_popularity": F.log1p("views"), "document_rating": F.col("rating"), "document_freshness": 1 / (1 + days), "source_authority": source}
    score = 2 * F.col("score")
    for name, w in weights.items():
        score = score + w * F.coalesce(value[name], F.lit(0.0))
    if interest is not None:
        score = score * F.aggregate("topics", F.lit(1.0), lambda a, t: a * (1 + 0.2 * F.coalesce(F.try_element_at(interest, t), F.lit(0.0))))
    score = score * F.coalesce(0.8 + 0.2 * F.exp(-days / 30), F.lit(1.0))
    before = F.collect_set("topics").over(Window.partitionBy("list_id").orderBy("position", "id").rowsBetween(Window.unboundedPreceding, -1))
    share = lambda t: F.size(F.array_intersect(t, "topics")) / F.greatest(F.lit(1), F.size(F.array_distinct("topics")) + F.size(t) - F.size(F.array_intersect(t, "topics")))
    like = F.coalesce(F.array_max(F.transform("before", share)), F.lit(0.0))
    rows = results.withColumn("before", before).withColumn("score", D.round6(score * (1 - 0.3 * like)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy(F.col("score").desc(), "position", "id"))).select("list_id", "rank", "id", "score")


def temperature(last: Column, first: Column, n: Column, as_of: Column) -> Column:
    """0.7 / (1 + hours since the last access) + 0.3 * accesses an hour."""
    hours = lambda a, b: (F.unix_timestamp(a) - F.unix_timestamp(b)) / 3600
    span = hours(last, first)
    return 0.7 / (1 + hours(as_of, last)) + 0.3 * F.when((n > 1) & (span > 0), n / span).otherwise(0.0)
