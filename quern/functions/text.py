"""Text functions as Column expressions: tokens, stems, n-grams, sentences, measures, types of content, stripping and chunks.

Null texts give null unless said otherwise.  Lengths are in UTF-8 bytes where the name says so.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicons as L

SPACE = "[ \\t\\n\\f\\r]"


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and decimal digits, as they are."""
    return F.filter(F.split(text, "[^\\p{L}\\p{Nd}]+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Lower-cased tokens of more than one byte without stop words: what search indexes."""
    # isin is a look-up in a hash set; array_contains would compare with every stop word
    return F.filter(tokens(F.lower(text)), lambda x: ~x.isin(L.SEARCH_STOP) & (F.octet_length(x) > 1))


def stem(word: Column) -> Column:
    """The first of ing, ed, ly, es, s taken off, where the word has more than two bytes besides."""
    out = word
    for suffix in reversed(("ing", "ed", "ly", "es", "s")):
        out = F.when(word.endswith(suffix) & (F.octet_length(word) > len(suffix) + 2), word.substr(F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def stemmed_terms(text: Column) -> Column:
    """Structs of pos (among all tokens) and stem, without stop words; words of up to two bytes stay as they are."""
    all_ = F.transform(tokens(F.lower(text)), lambda x, i: F.struct(i.alias("pos"), x.alias("word")))
    kept = F.filter(all_, lambda s: ~s["word"].isin(L.SEARCH_STOP))
    return F.transform(kept, lambda s: F.struct(s["pos"].alias("pos"), F.when(F.octet_length(s["word"]) > 2, stem(s["word"])).otherwise(s["word"]).alias("term")))


def ngrams(words: Column, n: int) -> Column:
    """Each n successive words joined by blanks; the array is zipped with itself, so the work is linear."""
    if n == 1:
        return words
    last = F.greatest(F.lit(0), F.size(words) - n + 1)
    zipped = F.slice(words, F.lit(1), last)
    for k in range(1, n):
        zipped = F.zip_with(zipped, F.slice(words, F.lit(k + 1), last), lambda a, b: F.concat(a, F.lit(" "), b))
    return zipped


def fields(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def sentences(text: Column) -> Column:
    """Parts between stops followed by white space, trimmed, empty ones dropped; the text itself if none is left."""
    parts = F.filter(F.transform(F.split(text, f"[.!?]+{SPACE}+"), lambda s: F.trim(s, F.lit(" \t\n\f\r"))), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def complexity(text: Column) -> Column:
    """(mean bytes a word / 10 + mean words a sentence / 25) / 2, at most 1; 0 without words."""
    words = fields(text)
    n = F.size(words)
    value = (_sum(F.transform(words, F.octet_length)) / n / 10 + n / F.size(sentences(text)) / 25) / 2
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), value))


def syllables(word: Column) -> Column:
    """Groups of vowels among the letters a to z, less one for a final e, at least 1."""
    bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.regexp_count(bare, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), n - (bare.endswith("e") & (n > 1)).cast("int"))


def readability(text: Column) -> Column:
    """Flesch's reading ease over 100, kept in 0 to 1; 0 without words."""
    words = fields(text)
    n = F.size(words)
    ease = 206.835 - 1.015 * (n / F.size(sentences(text))) - 84.6 * (_sum(F.transform(words, syllables)) / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ease / 100)))


# --- sentiment


def sentiment_words(text: Column) -> Column:
    """Lower-cased words without URLs, addresses and signs, which split words."""
    text = F.regexp_replace(F.lower(text), "https?://[^ \\t\\n\\f\\r]+", "")
    text = F.regexp_replace(text, "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", "")
    return fields(F.regexp_replace(text, "[^0-9A-Za-z_ \\t\\n\\f\\r]+", " "))


def weights(words: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


_SCORES = L.POSITIVE | {w: -x for w, x in L.NEGATIVE.items()}


def polarity(words: Column) -> Column:
    """Mean score of the words of the lexicon; one of the three words before that negates turns it (times -0.8), intensifiers among the two before multiply it."""
    score, strength = weights(_SCORES), weights(L.INTENSIFIERS)

    def one(word: Column, i: Column) -> Column:
        before3 = F.slice(words, F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3)))
        before2 = F.slice(words, F.greatest(F.lit(1), i - 1), F.least(i, F.lit(2)))
        negated = F.when((i > 0) & F.exists(before3, lambda w: w.isin(L.NEGATORS)), -0.8).otherwise(1.0)
        stronger = F.when(i > 0, F.aggregate(before2, F.lit(1.0), lambda a, w: a * F.when(w.isin(list(L.INTENSIFIERS)), F.try_element_at(strength, w)).otherwise(1.0))).otherwise(1.0)
        return F.try_element_at(score, word) * negated * stronger

    # only words of the lexicon have their neighbours looked at
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(_SCORES)), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
    found = F.transform(at, lambda s: one(s["w"], s["i"]))
    mean = F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")


def sentiment_confidence(score: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(score) * F.when(n > 10, 1.2).when(n < 5, 0.8).otherwise(1.0))


# --- language by rules


def letters_only(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), "[^\\p{L} \\t\\n\\f\\r]+", " "))


def language_score(text: Column, code: str) -> Column:
    """0.6 of the common words that occur anywhere in the text, 0.2 of the letters of its class by bytes, 0.2 of its script among letters.

    text is of letters_only.  Common words are looked for as strings, within words too.
    """
    _, common, letters, script = L.LANGUAGES[code]
    here = F.lit(0)
    for word in common:
        here = here + text.contains(word.lower()).cast("int")
    in_class = F.length(F.regexp_replace(text, f"[^{letters}]+", ""))
    in_script = F.length(F.regexp_replace(text, f"[^{script}]+", ""))
    all_ = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    return F.when(text == "", 0.0).otherwise(0.6 * (here / len(common)) + 0.2 * (in_class / F.octet_length(text)) + 0.2 * F.when(all_ > 0, in_script / all_).otherwise(0.0))


def language(text: Column) -> Column:
    """Struct of code, name, confidence: the language of the highest score, the first by code of equal ones; unknown without words."""
    rows = F.array(*(F.struct(F.round(language_score(text, c), 9).alias("s"), F.lit(c).alias("code"), F.lit(L.LANGUAGES[c][0]).alias("name")) for c in sorted(L.LANGUAGES)))
    best = F.aggregate(rows, F.struct(F.lit(0.0).alias("s"), F.lit("en").alias("code"), F.lit("English").alias("name")), lambda a, r: F.when(r["s"] > a["s"], r).otherwise(a))
    none = F.struct(F.lit("unknown").alias("code"), F.lit("Unknown").alias("name"), F.lit(0.0).alias("confidence"))
    # by way of an array the best row is evaluated once, not for each of its fields
    found = F.get(F.transform(F.array(best), lambda b: F.struct(b["code"].alias("code"), b["name"].alias("name"), F.least(F.lit(1.0), b["s"]).alias("confidence"))), F.lit(0))
    return F.when(text == "", none).otherwise(found)


# --- content


def content_type(text: Column) -> Column:
    t = F.trim(text, F.lit(" \t\n\f\r"))
    marked = t.contains("# ") | t.contains("```") | t.contains("[](")
    wrapped = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.when(t.contains("<html") | t.contains("<!DOCTYPE"), "html").when(marked, "markdown").when(wrapped, "json").otherwise("text")


def strip_html(text: Column) -> Column:
    """Tags become blanks, six entities their signs (&amp; last), white space is squeezed; what scripts hold stays."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return squeeze(out)


def strip_markdown(text: Column) -> Column:
    """Heads, links, emphasis and code are taken off in this order; the text of heads, links and emphasis stays."""
    out = F.regexp_replace(text, f"(?m)^#+{SPACE}*", "")
    out = F.regexp_replace(out, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    out = F.regexp_replace(out, "\\*\\*([^*]*)\\*\\*|__([^_]*)__|[*_]([^*_]*)[*_]", "$1$2$3")
    out = F.regexp_replace(out, "(?s)```.*?```", " ")
    return squeeze(F.regexp_replace(out, "`[^`]*`", " "))


def prepared(text: Column) -> Column:
    """The text of content of any type."""
    kind = content_type(text)
    return F.when(kind == "html", strip_html(text)).when(kind == "markdown", strip_markdown(text)).otherwise(squeeze(text))


def processing_ms(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 1000)


def chunks_of_sentences(text: Column, most: int = 1000, overlap: int = 100) -> Column:
    """Sentences joined by blanks while a chunk has at most `most` bytes; each next one begins with the last words of the one before, about `overlap` bytes.

    The stops between sentences are lost.  A sentence longer than `most` is a chunk of its own.
    """

    def tail(chunk: Column) -> Column:
        """From the first blank within the last `overlap` bytes on; counted in characters."""
        end = F.substring(chunk, -overlap, overlap)
        blank = F.instr(end, " ")
        return F.when(F.length(chunk) <= overlap, chunk).when(blank > 0, F.substring(end, blank + 1, overlap)).otherwise(end)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def add(a: Column, s: Column) -> Column:
        full = (a["size"] > 0) & (a["size"] + F.octet_length(s) > most)
        carried = F.trim(a["now"])
        t = tail(carried)
        done = F.when(full, F.array_append(a["done"], carried)).otherwise(a["done"])
        # what was carried over is followed by two blanks, as its size counts them
        before = F.when(full & F.lit(overlap > 0), F.concat(t, F.lit("  "))).when(full, "").when(a["size"] > 0, F.concat(a["now"], F.lit(" "))).otherwise("")
        now = F.concat(before, s)
        return F.struct(done.alias("done"), now.alias("now"), F.octet_length(now).alias("size"))

    parts = F.filter(F.transform(F.split(text, f"[.!?]+{SPACE}+"), lambda s: F.trim(s, F.lit(" \t\n\f\r"))), lambda s: s != "")
    return F.aggregate(parts, start, add, lambda a: F.when(a["size"] > 0, F.array_append(a["done"], F.trim(a["now"]))).otherwise(a["done"]))


_WHITE = " \t\n\x0b\f\r\x85\xa0"


def cut_by_characters(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Windows of at most `size` characters, each ending at the last white space of its last tenth if there is one; the next begins `overlap` before."""
    if len(text) <= size:
        return [text.strip(_WHITE)] if len(text) else [text]
    if size - size // 10 - 1 <= overlap:
        raise ValueError("the overlap must be shorter than what is left of a window whose last tenth is cut off")
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            low = max(end - size // 10 - 1, 0)
            blank = max(text.rfind(c, low, end) for c in _WHITE)
            end = blank if blank > at else end
        out.append(text[at:end].strip(_WHITE))
        if end == len(text):
            return out
        at = end - overlap


def chunks_of_characters(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """`cut_by_characters` of each text; null gives null.  Chunks are cut in Python, as an expression would count a text's characters anew for each."""
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_by_characters(t, size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut(text)
