"""Content queries over all rows of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.functions import lexicons as L
from quern.functions import text as T
from quern.operators import content as C
from quern.plans.search import documents
from quern.plans.tables import table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("of"), F.col("html").alias("text"))
    both = pages.unionByName(documents(spark, sf_dir).withColumn("of", F.lit("document")))
    return both.select("of", "id", T.content_type(F.col("text")).alias("type"), T.processing_ms(F.col("text")).alias("ms"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("id", T.strip_markdown(F.concat(F.lit("# "), "text", F.lit(" **bold** [link](to) `code`"))).alias("text"))


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.chunks_of_sentences(F.col("text"))
    return documents(spark, sf_dir).select("id", F.posexplode(chunks).alias("chunk", "text")).select("id", "chunk", F.octet_length("text").alias("bytes"), F.size(T.fields(F.col("text"))).alias("words"), F.md5("text").alias("digest"))


def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.posexplode(T.chunks_of_characters(F.col("text"))).alias("chunk", "text")).select("id", "chunk", F.md5("text").alias("digest"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.size(T.sentences(F.col("text"))).alias("sentences"), F.size(T.fields(F.col("text"))).alias("words"), D.round6(T.complexity(F.col("text"))).alias("complexity"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", D.round6(T.readability(F.col("text"))).alias("readability"))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("w", T.sentiment_words(F.col("text"))).withColumn("s", T.polarity(F.col("w")))
    return rows.select("id", D.round6(F.col("s")).alias("polarity"), T.sentiment_label(F.col("s")).alias("label"), D.round6(T.sentiment_confidence(F.col("s"), F.size("w"))).alias("confidence"))


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("id", T.letters_only(F.col("text")).alias("t"))
    return rows.select("id", *(D.round6(T.language_score(F.col("t"), c)).alias(c) for c in sorted(L.LANGUAGES)))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("id", T.letters_only(F.col("text")).alias("t"))
    return rows.select("id", T.language(F.col("t")).alias("l")).select("id", "l.code", "l.name", D.round6(F.col("l.confidence")).alias("confidence"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.topics(documents(spark, sf_dir), 0.0).select("id", F.posexplode("topics").alias("place", "t")).select("id", "place", "t.label", "t.score", F.array_join("t.keywords", ",").alias("keywords"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.entities(documents(spark, sf_dir))


def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.key_phrases(documents(spark, sf_dir))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summaries(documents(spark, sf_dir))


def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.understood(conversations(spark, sf_dir))


QUERIES = {f.__name__: f for f in (content_type, html_strip, markdown_strip, chunk_sentences, chunk_characters, sentence_stats, readability, sentiment, language_scores, language, topics, entities, key_phrases, summaries, query_understanding)}

_WS = "[ \\t\\n\\f\\r]"
_FIELDS = f"list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')"
_SENT = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+{_WS}+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda s: s <> '')"
_strip = "text"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _strip = f"replace({_strip}, '{_a}', '{_b}')"
_LETTERS = f"trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}} \\t\\n\\f\\r]', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def _score(code: str) -> str:
    _, common, letters, script = L.LANGUAGES[code]
    here = " + ".join(f"contains(t, '{w.lower()}')::INT" for w in common)
    size = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
    return f"CASE WHEN t = '' THEN 0 ELSE round(0.6::DOUBLE * (({here}) / {len(common)}) + 0.2::DOUBLE * ({size(letters)} / strlen(t)) + 0.2::DOUBLE * CASE WHEN {size(chr(92) + 'p{L}')} > 0 THEN {size(script)} / {size(chr(92) + 'p{L}')} ELSE 0 END, 6) + 0.0 END"


ORACLE_SQL = {
    "content_type": """WITH a AS (SELECT 'page' AS of, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
        SELECT of, id, CASE WHEN contains(text, '<html') OR contains(text, '<!DOCTYPE') THEN 'html' WHEN contains(text, '# ') OR contains(text, '```') OR contains(text, '[](') THEN 'markdown'
        WHEN regexp_matches(text, '(?s)^\\s*(\\{.*\\}|\\[.*\\])\\s*$') THEN 'json' ELSE 'text' END AS type, strlen(text) // 1000 AS ms FROM a""",
    "html_strip": f"WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages) SELECT page_id, trim(regexp_replace({_strip}, '{_WS}+', ' ', 'g')) AS text FROM p",
    "sentence_stats": f"""WITH d AS (SELECT doc_id AS id, {_FIELDS} AS w, greatest(1, len({_SENT})) AS s FROM documents)
        SELECT id, s::INT AS sentences, len(w)::INT AS words, round(CASE WHEN len(w) = 0 THEN 0 ELSE least(1, (list_sum(list_transform(w, lambda x: strlen(x))) / len(w) / 10 + len(w) / s / 25) / 2) END, 6) AS complexity FROM d""",
    "readability": f"""WITH d AS (SELECT doc_id AS id, {_FIELDS} AS w, greatest(1, len({_SENT})) AS s FROM documents), b AS (SELECT id, w, s, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS bare FROM d),
        y AS (SELECT id, len(w) AS n, s, list_sum(list_transform(bare, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM b)
        SELECT id, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, (206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (y / n)) / 100)) END, 6) AS readability FROM y""",
    "language_scores": f"WITH d AS (SELECT doc_id AS id, {_LETTERS} AS t FROM documents) SELECT id, " + ", ".join(f'{_score(c)} AS "{c}"' for c in sorted(L.LANGUAGES)) + " FROM d",
}

_ONE_SPACE = lambda x: f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \\t\\n\\f\\r]+', '', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '', 'g'), '[^0-9A-Za-z_ \\t\\n\\f\\r]', ' ', 'g'), '" + _WS + "+'), lambda w: w <> '')"
_CONVERSATIONS = "q AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)"
_rows = lambda words: ", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', {x}::DOUBLE)" for w, x in words.items())
_in = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_has = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_count = lambda words: "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


def _markdown(x: str) -> str:
    for pattern, by in ((f"(?m)^#+{_WS}*", "''"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "'\\1'"), ("\\*\\*([^*]*)\\*\\*|__([^_]*)__|[*_]([^*_]*)[*_]", "'\\1\\2\\3'"), ("(?s)```.*?```", "' '"), ("`[^`]*`", "' '")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return _ONE_SPACE(x)


def _understood() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    scores = {n: f"round({w}::DOUBLE * (regexp_matches(low, {quote(a)})::INT + regexp_matches(low, {quote(b)})::INT), 6)" for n, (w, a, b) in C.INTENTS.items()}
    best = "greatest(" + ", ".join(scores) + ")"
    normal = _ONE_SPACE("lower(text)")
    for short, long in C._CONTRACTIONS.items():
        normal = f"replace({normal}, {quote(short)}, {quote(long)})"
    marks = ", ".join(f"CASE WHEN regexp_matches(low, {quote(chr(92) + 'b(' + p + ')' + chr(92) + 'b')}) THEN '{m}' END" for m, p in sorted(C.MODIFIERS.items()))
    return f"""WITH {_CONVERSATIONS}, l AS (SELECT *, lower(text) AS low, len({_FIELDS}) AS n FROM q), s AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in scores.items())} FROM l)
        SELECT id AS query_id, {normal} AS normalized, CASE WHEN {best} <= 0 THEN 'lookup' {" ".join(f"WHEN {n} = {best} THEN '{n}'" for n in scores)} END AS intent, round(least(1, CASE WHEN {best} > 0 THEN {best} ELSE 0.5 END), 6) AS confidence,
        CASE {" ".join(f"WHEN {_has(L.QUERY_DOMAINS[d])} THEN '{d}'" for d in sorted(L.QUERY_DOMAINS))} ELSE 'general' END AS domain, array_to_string(list_filter([{marks}], lambda x: x IS NOT NULL), ',') AS modifiers,
        round(least(1, 0.2::DOUBLE * {_count(["urgent", "asap", "immediately", "now", "quickly", "fast"])}), 6) AS urgency, round(least(1, 0.05::DOUBLE * n + CASE WHEN regexp_matches(low, '\\b(algorithm|api|class|function|interface|method)\\b') THEN 0.3::DOUBLE ELSE 0 END), 6) AS specificity,
        round(least(1, CASE WHEN contains(text, ' AND ') OR contains(text, ' OR ') OR contains(text, ' NOT ') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains(text, ',') OR contains(text, ';') THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * {_count(["why", "how", "what if", "explain"])}), 6) AS complexity FROM s"""


def _topics() -> str:
    words = ", ".join(f"('{label}', '{w}', {C._WEIGHT(w)}::DOUBLE, {len(ws)})" for label, ws in sorted(L.TOPICS.items()) for w in dict.fromkeys(ws))
    return f"""WITH k AS (SELECT * FROM (VALUES {words}) t(label, word, weight, size)), d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}} \\t\\n\\f\\r]', ' ', 'g'), '{_WS}+'), lambda w: strlen(w) >= 3 AND w NOT IN {_in(L.TOPIC_STOP)}) AS w FROM documents),
        c AS (SELECT id, n, word, count(*) AS c FROM (SELECT id, len(w) AS n, unnest(w) AS word FROM d) GROUP BY ALL), h AS (SELECT id, n, label, word, size, c * weight AS x FROM c JOIN k USING (word)),
        t AS (SELECT id, label, round(sum(x) / n * (1 + count(*) / size), 6) AS score, array_to_string((list(word ORDER BY x DESC, word))[1:5], ',') AS keywords FROM h GROUP BY id, n, label, size)
        SELECT id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, label) - 1)::INT AS place, label, score, keywords FROM t WHERE score > 0 QUALIFY place < 5"""


_SPACES = "[ \\t\\n\\x0b\\f\\r\\x{85}\\x{a0}]"
ORACLE_SQL |= {
    "markdown_strip": f"WITH {_CONVERSATIONS} SELECT id, {_markdown(chr(39) + '# ' + chr(39) + ' || text || ' + chr(39) + ' **bold** [link](to) `code`' + chr(39))} AS text FROM q",
    "sentiment": f"""WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), t AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d), lx AS (SELECT * FROM (VALUES {_rows(T._SCORES)}) t(word, x)), st AS (SELECT * FROM (VALUES {_rows(L.INTENSIFIERS)}) t(word, x)),
        b AS (SELECT *, lag(word) OVER o AS a1, lag(word, 2) OVER o AS a2, lag(word, 3) OVER o AS a3 FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
        h AS (SELECT id, lx.x * CASE WHEN a1 IN {_in(L.NEGATORS)} OR a2 IN {_in(L.NEGATORS)} OR a3 IN {_in(L.NEGATORS)} THEN -0.8::DOUBLE ELSE 1 END * coalesce(s2.x, 1) * coalesce(s1.x, 1) AS x FROM b JOIN lx USING (word) LEFT JOIN st s1 ON s1.word = a1 LEFT JOIN st s2 ON s2.word = a2),
        m AS (SELECT id, sum(x) / count(*) AS s FROM h GROUP BY id), p AS (SELECT d.id, len(w) AS n, CASE WHEN s IS NULL THEN 0 ELSE greatest(-1, least(1, s)) END AS s FROM d LEFT JOIN m USING (id))
        SELECT id, round(s, 6) + 0.0 AS polarity, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS label, round(least(1, abs(s) * CASE WHEN n > 10 THEN 1.2::DOUBLE WHEN n < 5 THEN 0.8 ELSE 1 END), 6) + 0.0 AS confidence FROM p""",
    "language": f"""WITH d AS (SELECT doc_id AS id, {_LETTERS} AS t FROM documents), s AS ({" UNION ALL ".join(f"SELECT id, t, '{c}' AS code, '{L.LANGUAGES[c][0]}' AS name, {_score(c).replace(', 6) + 0.0 END', ', 9) END')} AS s FROM d" for c in sorted(L.LANGUAGES))}),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, code) = 1)
        SELECT id, CASE WHEN t = '' THEN 'unknown' WHEN s = 0 THEN 'en' ELSE code END AS code, CASE WHEN t = '' THEN 'Unknown' WHEN s = 0 THEN 'English' ELSE name END AS name, round(least(1, s), 6) + 0.0 AS confidence FROM b""",
    "query_understanding": _understood(),
    "topics": _topics(),
    "chunk_characters": f"""WITH RECURSIVE r AS (SELECT doc_id AS id, text, length(text) AS n, 0 AS chunk, 0 AS pos, NULL::INT AS stop FROM documents
        UNION ALL SELECT id, text, n, chunk + 1, CASE WHEN stop IS NULL THEN 0 ELSE stop - 100 END AS pos, CASE WHEN p + 1000 >= n THEN n WHEN regexp_matches(w, '{_SPACES}') THEN p + 899 + length(regexp_extract(w, '(?s)^(.*){_SPACES}', 1)) ELSE p + 1000 END AS stop
        FROM (SELECT *, CASE WHEN stop IS NULL THEN 0 ELSE stop - 100 END AS p, substr(text, (CASE WHEN stop IS NULL THEN 0 ELSE stop - 100 END) + 900, 101) AS w FROM r WHERE stop IS NULL OR stop < n))
        SELECT id, (chunk - 1)::INT AS chunk, md5(trim(substr(text, pos + 1, stop - pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))) AS digest FROM r WHERE chunk > 0""",
}
ORACLE_SQL["chunk_sentences"] = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_SENT} AS s FROM documents), r AS (SELECT id, s, 0 AS i, '' AS now, NULL::VARCHAR AS done FROM d
    UNION ALL SELECT id, s, i + 1, CASE WHEN big AND length(c) <= 100 THEN c || '  ' WHEN big AND contains(e, ' ') THEN e[strpos(e, ' ') + 1 :] || '  ' WHEN big THEN e || '  ' WHEN now <> '' THEN now || ' ' ELSE '' END || s[i + 1], CASE WHEN big THEN c END
    FROM (SELECT *, trim(now) AS c, right(trim(now), 100) AS e, now <> '' AND strlen(now) + strlen(s[i + 1]) > 1000 AS big FROM r WHERE i < len(s))),
    o AS (SELECT id, i, done AS t FROM r WHERE done IS NOT NULL UNION ALL SELECT id, i + 1, trim(now) FROM r WHERE i = len(s) AND now <> '')
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS chunk, strlen(t)::INT AS bytes, len({_FIELDS.replace('text', 't')})::INT AS words, md5(t) AS digest FROM o"""
