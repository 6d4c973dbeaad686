"""Analytics of content: topics, entities, key phrases, summaries, understanding of queries.

Tables are (id, text); null and empty texts have no topics, entities or phrases.  Everything is by row, so nothing is
shuffled; what greedy choice or spans need runs in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import distance as D
from quern.functions import lexicons as L
from quern.functions import text as T

# --- topics

_WEIGHT = lambda w: 2.0 if len(w) > 8 else 1.5 if len(w) > 5 else 1.0


def topic_words(text: Column) -> Column:
    words = T.fields(F.regexp_replace(F.lower(text), "[^\\p{L} \\t\\n\\f\\r]+", " "))
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(L.TOPIC_STOP))


def _once(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f has it; Spark writes a column's expression out wherever it is used."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _topic(label: str, hits: Column, n: Column) -> Column:
    """Struct of s (the negative score), label and keywords, from the keywords among a text's n words."""
    return _once(F.filter(hits, lambda x: x.isin(L.TOPICS[label])), lambda own: _scored(label, own, n))


def _scored(label: str, own: Column, n: Column) -> Column:
    words = L.TOPICS[label]
    weights = T.weights({w: _WEIGHT(w) for w in words})
    total = F.aggregate(F.transform(own, lambda x: F.try_element_at(weights, x)), F.lit(0.0), lambda a, x: a + x)
    distinct = F.array_distinct(own)
    score = F.when(F.size(own) > 0, total / n * (1 + F.size(distinct) / len(words))).otherwise(0.0)
    by = F.array_sort(F.transform(distinct, lambda x: F.struct((-F.size(F.filter(own, lambda y: y == x)) * F.try_element_at(weights, x)).alias("s"), x.alias("word"))))
    return F.struct((-D.round6(score)).alias("s"), F.lit(label).alias("label"), F.transform(F.slice(by, 1, 5), lambda s: s["word"]).alias("keywords"))


def topics(docs: DataFrame, least: float = 0.1, most: int = 5) -> DataFrame:
    """id, topics: array of topic_id, label, score, keywords, the highest scores first, ties by label.

    Score: the keywords' frequencies by weight (2 over eight letters, 1.5 over five) over all words, times 1 + the share of keywords that occur.
    """
    known = sorted({w for ws in L.TOPICS.values() for w in ws})
    words = F.coalesce(topic_words(F.col("text")), F.array().cast("array<string>"))
    hits = _once(words, lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(known)).alias("hits")))
    every = _once(hits, lambda h: F.array(*(_topic(label, h["hits"], h["n"]) for label in sorted(L.TOPICS))))
    best = F.slice(F.array_sort(F.filter(every, lambda s: -s["s"] > least)), 1, most)
    return docs.toDF("id", "text").select("id", F.transform(best, lambda s: F.struct(F.lower(s["label"]).alias("topic_id"), s["label"].alias("label"), (-s["s"]).alias("score"), s["keywords"].alias("keywords"))).alias("topics"))


# --- entities

_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_NAME = "[A-Z][a-z]+"
# label: expressions, priority, least and most bytes, and what a find must satisfy besides
ENTITIES: dict[str, tuple[list[str], int, int, int, object]] = {
    "DATE": ([r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", rf"\b{_MONTH}\s+\d{{4}}\b", rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b", r"\b(?:19|20)\d{2}\b"], 1, 4, 30, lambda t: any(c in t for c in "/- ")),
    "EMAIL": ([r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"], 3, 5, 100, lambda t: True),
    "LOC": ([rf"\b{_NAME}(?:\s{_NAME})*,\s*[A-Z]{{2}}\b", r"\b(?:Beijing|Chicago|London|Los Angeles|Mumbai|New York|Paris|São Paulo|Tokyo|United Kingdom|United States)\b", rf"\b(?:Bay|Desert|Lake|Mount|Mountain|Mt\.?|Ocean|River|Sea)\s+{_NAME}\b"], 2, 2, 50, lambda t: t[0].isupper()),
    "MONEY": ([r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", r"\b\d+(?:\.\d{2})?\s*(?:dollars?|euros?|pounds?|yen|EUR|GBP|JPY|USD)\b"], 2, 2, 20, lambda t: True),
    "ORG": ([r"\b[A-Z][A-Za-z\s&]+(?:Company|Corporation|Corp\.?|Co\.?|Inc\.?|LLC|Ltd\.?)\b", rf"\b(?:University of {_NAME}|{_NAME} University)\b", r"\b[A-Z][A-Za-z\s]+ (?:Association|Foundation|Institute|Organization|Society)\b"], 2, 3, 100, lambda t: True),
    "PERSON": ([rf"\b{_NAME} {_NAME}(?:\s{_NAME})?\b", rf"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s+{_NAME}(?: {_NAME})?\b"], 3, 2, 50, lambda t: all(w[0].isupper() for w in t.split())),
    "PHONE": ([r"\b\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b", r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b"], 2, 10, 20, lambda t: sum(c.isdigit() for c in t) >= 10),
    "URL": ([r"https?://[^\s<>\"{}|\\^`\[\]]+", r"www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?"], 3, 7, 200, lambda t: "." in t),
}
_COMPILED = {k: [re.compile(p, re.ASCII) for p in v[0]] for k, v in ENTITIES.items()}


_RUN = re.compile(r"[A-Za-z\s&]+", re.ASCII)
_ENDS = {p: re.compile(re.search(r"\(\?:[^()]*\)\\b$", p.pattern).group(), re.ASCII) for p in _COMPILED["ORG"] if "\\s" in p.pattern}


def _found(p: re.Pattern, text: str) -> Iterator[re.Match]:
    """p.finditer(text); names that end with a certain word are looked for only in runs of letters that have such an end, up to the last one, as each capital of a run would be tried against all of it otherwise."""
    if p not in _ENDS:
        yield from p.finditer(text)
        return
    for run in _RUN.finditer(text):
        at = run.start()
        last = max((m.start() for m in _ENDS[p].finditer(text, at, run.end() + 2)), default=-1)
        while at < last and (m := p.search(text, at, run.end() + 2)):
            yield m
            at = m.end()


def entities_of(text: str) -> list[tuple[str, str, float, int, int]]:
    """text, label, confidence, start, end (in UTF-8 bytes) of each entity, one for equal texts and labels, in order of place and label.

    A find that is too long is none, and the search goes on after it.
    """
    found, seen = [], set()
    for label, (_, priority, least, most, good) in ENTITIES.items():
        for p in _COMPILED[label]:
            for m in _found(p, text):
                t = m.group().strip()
                size = len(t.encode())
                if not least <= size <= most or not good(t) or (key := (t.lower(), label)) in seen:
                    continue
                seen.add(key)
                sure = 0.6 + 0.1 * priority + 0.1 * t[0].isupper() + 0.1 * (size > 10) - 0.2 * (size < 3)
                found.append((t, label, round(min(1.0, max(0.0, sure)), 6), m.start(), m.end()))
    found.sort(key=lambda e: (e[3], e[1]))
    ascii_ = text.isascii()
    at = (lambda i: i) if ascii_ else (lambda i: len(text[:i].encode()))
    return [(t, label, sure, at(a), at(b)) for t, label, sure, a, b in found]


def _per_text(docs: DataFrame, f, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for r in f(t)]
            columns = list(zip(*rows)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds])], ["id", *names])

    return docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(work, f"id bigint, {schema}")


def entities(docs: DataFrame) -> DataFrame:
    """id, entity, label, confidence, start, end."""
    return _per_text(docs, entities_of, "entity string, label string, confidence double, start bigint, end bigint")


# --- key phrases and summaries

_PHRASE_STOP = set(L.PHRASE_STOP)
_STOPS = re.compile(r"[.!?]+\s+", re.ASCII)


def phrases_of(text: str, most: int = 10) -> list[tuple[str, float, int]]:
    """phrase, score, occurrences: n-grams of two to four words without stop words, short words and signs.

    Score: occurrences * mean ln(words / occurrences of a word) * ln(n + 1) * (1 + 1 / (1 + first place / 1000)); of
    phrases that share over half of the shorter one's words only the best stays, ties by phrase.
    """
    text = re.sub(r"https?://[^\s]+", "", text)
    text = re.sub(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "", text)
    text = re.sub(r"\s+", " ", re.sub(r"[^\w\s.,;:!?-]", " ", text, flags=re.ASCII)).strip()
    every = text.lower().split()
    if not every:
        return []
    count = Counter(every)
    freq: Counter = Counter()
    first: dict[tuple, int] = {}
    offset = 0
    good = lambda w: w not in _PHRASE_STOP and len(w.encode()) >= 3 and all(c.isalpha() or c in "-'" for c in w)
    for sentence in [s.strip() for s in _STOPS.split(text) if s.strip()] or [text]:
        words = sentence.lower().split()
        ok = [good(w) for w in words]
        step = len(sentence) // max(1, len(words))
        for i in range(len(words)):
            if not ok[i]:
                continue
            for n in range(2, 5):
                if i + n > len(words) or not ok[i + n - 1]:
                    break
                phrase = tuple(words[i : i + n])
                freq[phrase] += 1
                first.setdefault(phrase, offset + i * step)
        offset += len(sentence) + 1
    scored = []
    for phrase, tf in freq.items():
        idf = sum(math.log(len(every) / count[w]) for w in phrase if w in count) / len(phrase)
        scored.append((round(tf * idf * math.log(len(phrase) + 1) * (1 + 1 / (1 + first[phrase] / 1000)), 6), phrase, tf))
    scored.sort(key=lambda s: (-s[0], s[1]))
    kept: list[tuple] = []
    for score, phrase, tf in scored:
        if len(kept) == most:
            break
        own = set(phrase)
        if all(sum(w in own for w in other) / min(len(phrase), len(other)) <= 0.5 for _, other, _ in kept):
            kept.append((score, phrase, tf))
    return [(" ".join(p), s, tf) for s, p, tf in kept]


def key_phrases(docs: DataFrame, most: int = 10) -> DataFrame:
    """id, phrase, score, occurrences."""
    return _per_text(docs, lambda t: phrases_of(t, most), "phrase string, score double, occurrences bigint")


def summary_of(text: str, phrases: list[str]) -> str:
    sentences = [s.strip() for s in _STOPS.split(text) if s.strip()]
    if len(sentences) <= 2:
        return text
    last = len(sentences) - 1
    score = [sum(p.lower() in s.lower() for p in phrases) + 0.5 * (i in (0, last)) for i, s in enumerate(sentences)]
    order = sorted(range(len(sentences)), key=lambda i: (-score[i], i))
    return " ".join(sentences[i] for i in order[: max(2, len(sentences) // 3)])


def summaries(docs: DataFrame) -> DataFrame:
    """id, summary: the sentences with most key phrases, the first and last favoured, in order of score; texts of two sentences are their own."""
    return _per_text(docs, lambda t: [(summary_of(t, [p for p, _, _ in phrases_of(t)]),)], "summary string")


def insights(docs: DataFrame) -> DataFrame:
    """id and one struct: language, sentiment, complexity, readability, words."""
    rows = docs.toDF("id", "text").withColumn("w", T.sentiment_words(F.col("text"))).withColumn("s", T.polarity(F.col("w")))
    mood = F.struct(D.round6(F.col("s")).alias("polarity"), T.sentiment_label(F.col("s")).alias("label"), D.round6(T.sentiment_confidence(F.col("s"), F.size("w"))).alias("confidence"))
    return rows.select("id", F.struct(T.language(T.letters_only(F.col("text"))).alias("language"), mood.alias("sentiment"), D.round6(T.complexity(F.col("text"))).alias("complexity"), D.round6(T.readability(F.col("text"))).alias("readability"), F.size(T.fields(F.col("text"))).alias("words")).alias("insights"))


# --- queries

_CONTRACTIONS = {"can't": "cannot", "doesn't": "does not", "don't": "do not", "i'm": "i am", "it's": "it is", "they're": "they are", "what's": "what is", "where's": "where is", "won't": "will not", "you're": "you are"}
INTENTS = {
    "transactional": (0.8, r"\b(add|create|delete|insert|modify|remove|send|update)\s+\w+", "(buy|download|order|purchase|subscribe)"),
    "question": (0.7, "^(are|can|does|how|is|what|when|where|which|who|why)", r"\?$"),
    "navigation": (0.6, "(go to|navigate|open|show me|take me to)", "(link|page|site|url)"),
    "lookup": (0.4, "(find|get|look for|lookup|retrieve|search)", "(data|details|information|record)"),
}
MODIFIERS = {"best": "best|optimal|recommended|top", "compare": "compare|difference|versus|vs", "example": "demo|example|illustration|sample", "latest": "current|latest|newest|recent", "tutorial": "guide|how to|learn|tutorial"}


def _re2(pattern: str) -> str:
    """A pattern as RE2 reads it: the edges of a word are those of ASCII letters, \\s has no vertical tab, and $ is the very end."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace(r"\s", r"[\t\n\f\r ]").replace("$", r"\z")


def normalized_query(q: Column) -> Column:
    out = T.squeeze(F.lower(q))
    for short, long in _CONTRACTIONS.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    return out


def understood(queries: DataFrame) -> DataFrame:
    """query_id, normalized, intent, confidence, domain, modifiers, urgency, specificity, complexity of queries(query_id, text).

    Intents score by their expressions; of equal scores the first of INTENTS counts, of several domains the first by name.
    """
    q, low = F.col("text"), F.lower("text")
    scores = [(name, F.round(w * (low.rlike(_re2(a)).cast("int") + low.rlike(_re2(b)).cast("int")), 6)) for name, (w, a, b) in INTENTS.items()]
    best = F.greatest(*(s for _, s in scores))
    intent = F.lit("lookup")
    for name, s in reversed(scores):
        intent = F.when((s == best) & (best > 0), name).otherwise(intent)
    domain = F.lit("general")
    for name in sorted(L.QUERY_DOMAINS, reverse=True):
        domain = F.when(_any(low, L.QUERY_DOMAINS[name]), name).otherwise(domain)
    modifiers = F.filter(F.array(*(F.when(low.rlike(_re2(rf"\b({p})\b")), F.lit(m)) for m, p in sorted(MODIFIERS.items()))), lambda x: x.isNotNull())
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    one = lambda x: F.round(F.least(F.lit(1.0), x), 6)
    specific = 0.05 * F.size(T.fields(q)) + F.when(low.rlike(_re2(r"\b(algorithm|api|class|function|interface|method)\b")), 0.3).otherwise(0.0)
    logic = F.when(q.contains(" AND ") | q.contains(" OR ") | q.contains(" NOT "), 0.3).otherwise(0.0) + F.when(q.contains(",") | q.contains(";"), 0.2).otherwise(0.0) + 0.2 * count(["why", "how", "what if", "explain"])
    return queries.toDF("query_id", "text").select("query_id", normalized_query(q).alias("normalized"), intent.alias("intent"), one(F.when(best > 0, best).otherwise(0.5)).alias("confidence"), domain.alias("domain"), F.array_join(modifiers, ",").alias("modifiers"), one(0.2 * count(["urgent", "asap", "immediately", "now", "quickly", "fast"])).alias("urgency"), one(specific).alias("specificity"), one(logic).alias("complexity"))


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def concepts(query: Column) -> Column:
    """Related terms of all keys that occur in a query."""
    low = F.lower(query)
    return F.flatten(F.filter(F.array(*(F.when(low.contains(k), T.literals(v)) for k, v in sorted(L.QUERY_CONCEPTS.items()))), lambda x: x.isNotNull()))
