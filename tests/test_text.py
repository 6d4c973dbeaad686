"""Text functions, search, fusion and feedback on small cases."""

from __future__ import annotations

import regex
from pyspark.sql import functions as F

from quern.functions import lexicons as L
from quern.functions import text as T
from quern.functions.embedding import hashed
from quern.operators import content as C
from quern.operators import feedback as B
from quern.operators import fusion
from quern.operators import text_search as S
from quern.plans import registry

DOCS = [(1, "The quick brown fox jumps over the lazy dog"), (2, "A brown fox is quick and clever"), (3, "Machine learning is a kind of artificial intelligence"), (4, "Deep learning needs data"), (5, None), (6, "")]


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]


def test_search(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    found = lambda q, **k: [r["id"] for r in sorted(S.search(docs, q, **k).collect(), key=lambda r: r["rank"])]
    assert sorted(found("brown fox")) == [1, 2] and found("machine learning")[0] == 3 and sorted(found("learning")) == [3, 4]
    assert found('"quick brown fox"') == [1] and found('"machine learning"') == [3]
    assert found("+learning -deep", enforce=True) == [3] and sorted(found("lerning", fuzzy=1)) == [3, 4] and found("lerning") == []
    assert found("fast", synonyms=True) and set(found("fast", synonyms=True)) == {1, 2}
    assert found("nothing here", min_score=99) == [] and S.bm25(docs.limit(0), docs.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "brown fox jumps lazy")], "phrase_id long, text string")
    got = {(r["phrase_id"], r["id"]) for r in S.phrases(docs, long).collect()}
    assert got == set()  # inner stop words break phrases of over three terms
    assert S.phrases(docs, spark.createDataFrame([(1, "quick brown fox jumps")], "phrase_id long, text string")).first()["score"] == 10


def test_functions(spark):
    assert one(spark, lambda t: T.ngrams(F.split(t, " "), 2), "a b c", "a") == [["a b", "b c"], []]
    assert one(spark, lambda t: F.transform(T.stemmed_terms(t), lambda s: s["term"]), "running foxes quickly be", None) == [["runn", "fox", "quick"], None]
    assert one(spark, T.content_type, "<html>x", "# head", ' {"a": 1} ', "plain", None) == ["html", "markdown", "json", "text", "text"]
    assert one(spark, T.strip_html, "<p>a &lt;b&gt; &amp;lt;</p>") == ["a <b> &lt;"]
    assert one(spark, T.strip_markdown, "# T\n[x](y) **b** _i_ `c`") == ["T x b i"]
    label = lambda t: T.sentiment_label(T.polarity(T.sentiment_words(t)))
    assert one(spark, label, "This is excellent", "This is terrible", "A table", "This is not good at all.", "This is not bad actually.", "") == ["positive", "negative", "neutral", "negative", "positive", "neutral"]
    lang = lambda t: T.language(T.letters_only(t))["code"]
    assert one(spark, lang, "the cat and the dog that they have with this", "быть или не быть вот это они", "", "1 2") == ["en", "ru", "unknown", "unknown"]
    long = "One two three. " * 200
    chunks = one(spark, lambda t: T.chunks_of_sentences(t, 100, 20), long)[0]
    assert all(len(c) <= 120 for c in chunks) and len(chunks) > 30
    pieces = one(spark, lambda t: T.chunks_of_characters(t, 100, 20), "x" * 250, "short", "")
    assert [len(p) for p in pieces[0]] == [100, 100, 90] and pieces[1:] == [["short"], [""]]


def test_content(spark):
    docs = spark.createDataFrame([(1, "John Smith works at Google Inc. in New York. Mail a.b@c.org or 555-123-4567 on 12/31/2020 for $5."), (2, None), (3, "")], "id long, text string")
    got = {(r["label"], r["entity"]) for r in C.entities(docs).collect()}
    assert {("PERSON", "John Smith"), ("LOC", "New York"), ("EMAIL", "a.b@c.org"), ("PHONE", "555-123-4567"), ("DATE", "12/31/2020"), ("MONEY", "$5")} <= got
    talk = spark.createDataFrame([(1, "computer software algorithm for machine learning and data"), (2, None)], "id long, text string")
    rows = {r["id"]: r["topics"] for r in C.topics(talk).collect()}
    assert rows[1][0]["label"] == "Technology" and rows[2] == []
    p = [r["phrase"] for r in C.key_phrases(spark.createDataFrame([(1, "Quantum entanglement puzzles physicists. Quantum entanglement again.")], "id long, text string")).collect()]
    assert p and "quantum entanglement" in p[0]
    q = {r["query_id"]: r for r in C.understood(spark.createDataFrame([(1, "What is a vector database?"), (2, "delete record 5 now"), (3, "xyz")], "query_id long, text string")).collect()}
    assert (q[1]["intent"], q[1]["domain"]) == ("question", "tech") and q[2]["intent"] == "transactional" and (q[3]["intent"], q[3]["confidence"]) == ("lookup", 0.5)


def test_words_of_queries_end_where_ascii_letters_do(spark):
    texts = ["das ist bestö und üapi", "delete\x0brecord of mine", "see this ?\n", "the best api, compare"]
    got = [tuple(r) for r in C.understood(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")).orderBy("query_id").select("intent", "modifiers", "specificity").collect()]
    assert got == [("lookup", "best", 0.55), ("lookup", "", 0.15), ("lookup", "", 0.15), ("lookup", "best,compare", 0.5)]


def test_fusion(spark):
    lists = {"vector": [(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6)], "text": [(2, 12.5), (3, 10.0), (5, 8.5), (1, 5.0)]}
    hits = spark.createDataFrame([(0, name, i + 1, d, s) for name, l in lists.items() for i, (d, s) in enumerate(l)], "query_id long, list string, rank int, id long, score double")
    w = {"vector": 0.6, "text": 0.4}
    got = {r["id"]: r["score"] for r in fusion.rrf(hits, w).collect()}
    assert len(got) == 5 and got[1] == round(0.6 / 61 + 0.4 / 64, 6) and got[2] == round(0.6 / 62 + 0.4 / 61, 6)
    for f in fusion.METHODS.values():
        assert f(hits, w).count() == 5 and f(hits.limit(0), w).count() == 0


def test_ctr(spark):
    rows = [("u", i, 1, 1, "impression", 0.0) for i in range(10)] + [("u", i, 1, 1, "click", v) for i, v in enumerate([30.0, 40.0, 50.0])]
    x = spark.createDataFrame(rows, "user_id string, query_id long, document_id long, position long, type string, value double").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    r = B.ctr(x, "document_id").first()
    assert (r["ctr"], r["avg_position"], r["avg_dwell"], r["confidence"]) == (0.3, 1.0, 40.0, round(1 - 1 / 11, 6))
    assert B.ctr(x.limit(0), "document_id").collect() == [] and B.satisfaction(x).count() == 10
    assert B.anomalies(x.unionByName(x).unionByName(x).unionByName(x)).first()["anomaly"] == "rapid_clicking"


def test_fuzzy_terms_over_all_terms_equal_brute_force(spark, tmp_path):
    docs = ["Élève café cafés naïve naive ñandú", "straße strasse größe grosse Grüße müller", "the élevé cafe niño nino año ano ab3 ab4", "übermäßig uebermassig é ü xy xz", None]
    items = ["eleve café niños strase", "grüsse größen ab5 übermässig naives", "xyz ñandu", ""]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def terms(texts):
        found = {w for t in texts if t for w in regex.findall(r"[\p{L}\p{Nd}]+", t.lower())}
        return {w for w in found if w not in L.SEARCH_STOP and len(w.encode()) > 1}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b, d, round(1 / (d + 1), 6)) for a in terms(items) for b in terms(docs) if 1 <= (d := distance(a, b)) <= 2}
    rows = [tuple(r) for r in registry.QUERIES["fuzzy_terms"](spark, str(tmp_path)).select("wanted", "term", "distance", "score").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert any(not a.isascii() and d == 2 for a, _, d, _ in want) and any(d == 1 and not b.isascii() for _, b, d, _ in want)


def test_organisations_equal_the_plain_expression_in_linear_time():
    import random
    import time

    random.seed(3)
    parts = ["Acme", "Big", "of", "Inc", "Inc.", "Company", "Co.", "Corporation", "Corp", "&", "the", "Institute", "Society", "Incorporated", "x1", "9", "Ltd", ",", ".", "\n", "A", "University", "Foundation"]
    for _ in range(3000):
        text = "".join(random.choice(parts) + random.choice([" ", " ", "", "\n"]) for _ in range(random.randrange(1, 14)))
        for p in C._COMPILED["ORG"]:
            assert [m.span() for m in C._found(p, text)] == [m.span() for m in p.finditer(text)], (text, p.pattern)
    began = time.time()
    for text in ("Aa Bb " * 50_000, "Incorporated " * 30_000, "A " * 100_000 + "Inc"):
        list(C._found(C._COMPILED["ORG"][0], text))
    assert time.time() - began < 5


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "computer software algorithm for machine learning and data"), (2, None)], "id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        assert plan(C.topics(docs)).count("regexp_replace(") == 1
        v = docs.select("id", hashed(F.col("text"), 16).alias("vector"))
        assert plan(v.where("vector is not null and not exists(vector, x -> x is null)")).count("counted(") == 1
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert [r["vector"] is None for r in v.orderBy("id").collect()] == [False, True]
