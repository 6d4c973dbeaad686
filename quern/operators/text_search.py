"""BM25 search and what goes with it: fields, phrases, fuzzy terms, synonyms.

Tables are documents (id, text) and queries (query_id, text); every query is answered in one job.  Postings are
made only of terms that some query has: the queries' terms meet the documents' terms in an equi-join, which Spark
broadcasts where they are few.  Statistics are of all documents, and one row that is cross-joined.
Null texts have no terms.  A document id that is repeated is one document for scores; ties go to the lower id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions import text as T

K1, B = 1.2, 0.75
BOOSTS = {"title": 2.0, "description": 1.5, "content": 1.0, "tags": 1.8, "category": 1.3}


def indexed(docs: DataFrame) -> DataFrame:
    """id, terms, dl of docs(id, text)."""
    return docs.toDF("id", "text").select("id", F.coalesce(T.terms(F.col("text")), F.array().cast("array<string>")).alias("terms")).withColumn("dl", F.size("terms"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(index: DataFrame) -> DataFrame:
    """term, id, tf, dl."""
    return index.select("id", "dl", F.explode("terms").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def text_stats(index: DataFrame) -> DataFrame:
    """One row: documents, terms, bytes (a term's and 12 for each posting), avgdl."""
    by = postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = by.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum(F.octet_length("term") + 12 * F.col("df")), F.lit(0)).alias("bytes"))
    return corpus_stats(index).crossJoin(terms).select(F.col("n").alias("documents"), "terms", "bytes", F.round("avgdl", 6).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame, terms: Column | None = None) -> DataFrame:
    """query_id, term, times: a term that a query repeats counts as often."""
    found = T.terms(F.col("text")) if terms is None else terms
    return queries.toDF("query_id", "text").select("query_id", F.explode(found).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def scored(index: DataFrame, wanted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, matched (distinct terms of the query in the document) of wanted(query_id, term, times)."""
    vocabulary = wanted.select("term").distinct()
    each = index.select("id", "dl", F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi")
    post = each.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = post.join(wanted.join(df, "term"), "term").crossJoin(F.broadcast(corpus_stats(index)))
    part = F.col("times") * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def top(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k highest scores of hits(query_id, id, score)."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    return top(scored(indexed(docs), query_terms(queries), k1, b), k)


def matched_terms(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, terms: the distinct terms of the query in the document, in the query's order."""
    q = queries.toDF("query_id", "text").select("query_id", F.posexplode(F.array_distinct(T.terms(F.col("text")))).alias("pos", "term"))
    d = indexed(docs).select("id", F.explode(F.array_distinct("terms")).alias("term"))
    both = q.join(d, "term").groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("s"))
    return both.select("query_id", "id", F.transform("s", lambda s: s["term"]).alias("terms"))


def field_search(docs: DataFrame, queries: DataFrame, boosts: dict[str, float] | None = None, k: int = 10) -> DataFrame:
    """query_id, rank, id, score over docs(id, fields map<string, string>): each field is an index of its own, and its scores count by its boost, 1 if none is given."""
    boosts = BOOSTS if boosts is None else boosts
    each = docs.toDF("id", "fields").select("id", F.explode("fields").alias("field", "text"))
    index = each.select("id", "field", F.coalesce(T.terms(F.col("text")), F.array().cast("array<string>")).alias("terms")).withColumn("dl", F.size("terms"))
    stats = index.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    wanted = query_terms(queries)
    post = index.select("field", "id", "dl", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("field", "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = post.join(df, ["field", "term"]).join(F.broadcast(stats), "field").join(wanted, "term")
    boost = F.coalesce(F.try_element_at(T.weights(boosts), F.col("field")), F.lit(1.0)) if boosts else F.lit(1.0)
    part = boost * F.col("times") * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return top(rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")), k)


def concatenated(fields: Column) -> Column:
    """The values of a map joined by blanks, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: e["value"]), " ")


def phrases(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """phrase_id, id, occurrences, score (10 for each) of wanted(phrase_id, text) in docs(id, text).

    Stop words are dropped on both sides; phrases of two or three terms are matched as such n-grams, longer ones by places among all
    tokens, so that an inner stop word breaks them.  Documents' terms are stemmed, and so are phrases' here.  A phrase of one term is that term.
    """
    d = docs.toDF("id", "text").select("id", T.stemmed_terms(F.col("text")).alias("s"))
    p = wanted.toDF("phrase_id", "text").select("phrase_id", F.transform(T.stemmed_terms(F.col("text")), lambda s: s["term"]).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    words = lambda s: F.transform(s, lambda x: x["term"])
    grams = F.concat(*(T.ngrams(words(F.col("s")), n) for n in (1, 2, 3)))
    short = d.select("id", F.explode(grams).alias("gram")).join(p.where("n <= 3").select("phrase_id", F.array_join("t", " ").alias("gram")), "gram").groupBy("phrase_id", "id").agg(F.count(F.lit(1)).alias("occurrences"))
    # a longer phrase is found by its first four terms at successive places; the rest is looked up in the few documents left
    four = T.ngrams(words(F.col("s")), 4)
    at = F.transform(F.col("s"), lambda x: x["pos"])
    last = F.greatest(F.lit(0), F.size("s") - 3)
    cut = F.arrays_zip(F.slice(at, F.lit(1), last).alias("pos"), F.slice(at, F.lit(4), last).alias("end"), four.alias("gram"))
    first = d.select("id", F.explode(cut).alias("c")).select("id", "c.pos", "c.end", "c.gram").where("end - pos = 3")
    long = first.join(p.where("n > 3").select("phrase_id", "t", "n", F.array_join(F.slice("t", 1, 4), " ").alias("gram")), "gram").select("phrase_id", "id", "pos", "t", "n").join(d, "id")
    here = F.filter("s", lambda x: (x["pos"] >= F.col("pos")) & (x["pos"] < F.col("pos") + F.col("n")))
    long = long.where(words(here) == F.col("t")).groupBy("phrase_id", "id").agg(F.count(F.lit(1)).alias("occurrences"))
    return short.unionByName(long).withColumn("score", 10.0 * F.col("occurrences"))


def fuzzy_terms(vocabulary: DataFrame, wanted: DataFrame, most: int = 2) -> DataFrame:
    """wanted, term, distance, score (1 / (distance + 1)) of terms of vocabulary(term) within `most` edits, but not equal, of wanted(term).

    Candidates share one of most + 1 parts of the wanted term at nearly its place (an edit can't touch them all) and are nearly as long.
    Terms shorter than most + 1 letters are compared with all.
    """
    parts = most + 1
    w = wanted.toDF("wanted").where("wanted is not null").distinct().withColumn("n", F.length("wanted"))
    piece = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((F.floor(F.col("n") * i / parts)).cast("int").alias("at"), F.substring(F.col("wanted"), (F.floor(F.col("n") * i / parts) + 1).cast("int"), (F.floor(F.col("n") * (i + 1) / parts) - F.floor(F.col("n") * i / parts)).cast("int")).alias("piece")))
    seeds = w.where(F.col("n") >= parts).select("wanted", "n", F.explode(piece).alias("p")).select("wanted", "n", "p.at", "p.piece")
    spots = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - most), F.col("at") + most))
    seeds = seeds.select("wanted", "n", "piece", spots.alias("spot"))
    v = vocabulary.toDF("term").where("term is not null").distinct().withColumn("m", F.length("term"))
    sizes = seeds.select(F.length("piece").alias("size")).distinct()
    cut = v.join(F.broadcast(sizes), F.col("m") >= F.col("size")).select("term", "m", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - F.col("size")), lambda i: F.struct(i.alias("spot"), F.substring(F.col("term"), i + 1, F.col("size")).alias("piece")))).alias("c")).select("term", "m", "c.spot", "c.piece")
    # candidates are compared where they meet, so that only pairs that are near are shuffled again
    close = F.levenshtein("wanted", "term", most)
    near = cut.join(seeds, ["piece", "spot"]).where((F.abs(F.col("m") - F.col("n")) <= most) & close.between(1, most)).select("wanted", "term").distinct()
    short = w.where(F.col("n") < parts).join(v.where(F.col("m") < parts + most), F.abs(F.col("m") - F.col("n")) <= most).select("wanted", "term")
    out = near.unionByName(short).withColumn("distance", F.levenshtein("wanted", "term")).where(F.col("distance").between(1, most))
    return out.withColumn("score", F.round(1 / (F.col("distance") + 1), 6))


def expanded(words: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Words with their synonyms after them, each once."""
    table = L.SEARCH_SYNONYMS if synonyms is None else synonyms
    lists = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), T.literals(v))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(lists, w), F.array().cast("array<string>"))))))


def parsed(query: str) -> dict[str, list[str]]:
    """Quoted phrases, +must and -must_not words, and the other terms of a query given as a string."""
    found = {"phrases": re.findall(r'"([^"]+)"', query)}
    rest = re.sub(r'"[^"]+"', " ", query)
    found["must"], found["must_not"] = re.findall(r"\+(\w+)", rest), re.findall(r"-(\w+)", rest)
    return found | {"terms": re.sub(r"[+-]\w+", " ", rest).split()}


def required(hits: DataFrame, index: DataFrame, must: list[str], must_not: list[str]) -> DataFrame:
    """The hits whose documents have all words of must and none of must_not."""
    has = lambda word: F.array_contains("terms", word.lower())
    good = F.lit(True)
    for word in must:
        good &= has(word)
    for word in must_not:
        good &= ~has(word)
    return hits.join(index.where(good).select("id").distinct(), "id", "left_semi")


def merged(main: DataFrame, second: DataFrame, main_weight: float = 1.0, second_weight: float = 0.8) -> DataFrame:
    """query_id, id, score: both lists' scores by weight, summed where a document is in both."""
    both = main.select("query_id", "id", (F.col("score") * main_weight).alias("score")).unionByName(second.select("query_id", "id", (F.col("score") * second_weight).alias("score")))
    return both.groupBy("query_id", "id").agg(F.round(F.sum("score"), 6).alias("score"))


def search(docs: DataFrame, query: str, k: int = 10, synonyms: bool = False, fuzzy: int = 0, min_score: float = 0.0, enforce: bool = False) -> DataFrame:
    """rank, id, score of one query given as a string with phrases and + and - words.

    Phrases alone are searched where there are any; else BM25, to which fuzzy terms within `fuzzy` edits are merged by 0.8.
    + and - words bind only with enforce.
    """
    spark = docs.sparkSession
    parts = parsed(query)
    index = indexed(docs)
    if parts["phrases"]:
        hits = phrases(docs, spark.createDataFrame(list(enumerate(parts["phrases"])), "phrase_id long, text string")).groupBy("id").agg(F.sum("score").alias("score")).withColumn("query_id", F.lit(0))
    else:
        q = spark.createDataFrame([(0, " ".join(parts["must"] + parts["terms"]))], "query_id long, text string")
        wanted = query_terms(q, expanded(T.terms(F.col("text"))) if synonyms else None)
        hits = scored(index, wanted).drop("matched")
        if fuzzy:
            near = fuzzy_terms(index.select(F.explode("terms")).distinct(), wanted.select("term"), fuzzy).groupBy("term").agg(F.max("score").alias("score"))
            more = index.select("id", F.explode(F.array_distinct("terms")).alias("term")).join(near, "term").groupBy("id").agg(F.sum("score").alias("score")).withColumn("query_id", F.lit(0).cast("bigint"))
            hits = merged(hits, more)
    if enforce:
        hits = required(hits, index, parts["must"], parts["must_not"])
    if min_score > 0:
        hits = hits.where(F.col("score") >= min_score)
    return top(hits, k).drop("query_id")
