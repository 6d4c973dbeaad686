"""WARC derivatives: linked metadata and plain-text conversion records of responses.

`responses` makes response records of pages(page_id, url, html): an HTTP header, the page as payload, SHA-1
digests (base 32) of block and payload, and an identifier that follows from what the record holds.
`derivatives` gives for each response two records.  Both name the response in WARC-Refers-To, with its
target URI and date, and carry its HTTP header and digests on.
  metadata    application/warc-fields: title, language, the source's header lines and digests, and each outlink
              (links from the root are put after the page's scheme and host)
  conversion  text/plain: the page without comments, scripts, styles and tags, which separate nothing; tags of blocks end lines,
              references to characters are resolved, and white space is squeezed
`serialized` gives the records' bytes as text and `write` WARC files of them; the source's header lines and digests stand in the
records' own headers there.  `read` gives the records of WARC files, plain or gzipped, and `responses_in` the responses among them.

Pages are read as browsers do: a comment, script, style, title or tag that nothing ends goes on to the end of the page, and a tag ends with its first >.
Every expression meets each character a bounded number of times, whatever the page holds.

A null page has no response and no records.  A null URL is kept null, and is left out of the header; an empty page gives
records with empty text.  Rows repeated give equal records with equal identifiers, and other columns don't count.  Everything but `read` is built-in
expressions, so pages are read once and nothing is shuffled.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
MADE = "2024-02-01T00:00:00Z"
_BLOCKS = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|title|head|body|html|blockquote|pre|hr|main|aside|form"
_END = "[ \\t\\r\\n]*(?:>|\\z)"
REMOVED = f"(?is)<(?:!--.*?(?:-->|\\z)|script[^>]*(?:>.*?(?:</script{_END}|\\z)|\\z)|style[^>]*(?:>.*?(?:</style{_END}|\\z)|\\z))"
_BLOCK_TAG = f"(?i)</?(?:{_BLOCKS})(?:[ \\t\\r\\n/][^>]*)?(?:>|\\z)"
_TAG = "</?[a-zA-Z!][^>]*(?:>|\\z)"
_TITLE = "(?is)<title[^>]*(?:>(.*?)(?:</title|\\z)|\\z)"
_LINK, _HREF = "(?i)<a[ \\t\\r\\n][^>]*", '(?is)\\A.*href="([^"]*)"'
_HTML, _LANG = "(?i)<html[^>]*", '(?i)[ \\t\\r\\n]lang="([^"]*)"'
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»", "euro": "€", "amp": "&"}
_REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|" + "|".join(ENTITIES) + ");"


def base32(sha1: Column) -> Column:
    """The 32 letters of a SHA-1 given in 40 hexadecimal digits."""
    fives = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _digest(sha1: Column) -> Column:
    return F.concat(F.lit("sha1:"), base32(sha1))


def _uuid(sha1: Column) -> Column:
    s = lambda a, n: F.substring(sha1, a, n)
    return F.concat(F.lit("<urn:uuid:"), s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-a"), s(18, 3), F.lit("-"), s(21, 12), F.lit(">"))


def with_digest(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """A column with the digest of text, which is hashed once: what several expressions read is a column of its own."""
    return rows.withColumn("_sha", F.sha1(text)).withColumn(name, _digest(F.col("_sha"))).drop("_sha")


def with_record_id(rows: DataFrame, name: str, *parts: Column) -> DataFrame:
    """A column with an identifier that follows from parts."""
    return rows.withColumn("_sha", F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)))).withColumn(name, _uuid(F.col("_sha"))).drop("_sha")


def _character(reference: Column) -> Column:
    """The character of &#n; or &#xn;."""
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);", 1)
    code = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def _named(reference: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)))
    return F.coalesce(F.try_element_at(known, reference), _character(reference))


def resolved(text: Column) -> Column:
    """Text with its references to characters resolved; those to & come last, so that what they make isn't resolved again."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), 0))
    ordered = F.concat(F.filter(found, lambda x: _named(x) != "&"), F.filter(found, lambda x: _named(x) == "&"))
    return F.when(F.instr(text, "&") > 0, F.aggregate(ordered, text, lambda t, x: F.replace(t, x, _named(x)))).otherwise(text)


def squeezed(text: Column) -> Column:
    """One line end for white space that has any, one blank for other white space; none at either end."""
    other = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f") | text.contains("\u00a0")
    text = F.when(other, F.regexp_replace(text, "[ \\t\\r\\f\u00a0]{2,}|[\\t\\r\\f\u00a0]", " ")).otherwise(text)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_tags(html: Column) -> Column:
    html = F.regexp_replace(html, REMOVED, "")
    return F.regexp_replace(F.regexp_replace(html, _BLOCK_TAG, "\n"), _TAG, "")


def outlinks(html: Column, url: Column) -> Column:
    origin = F.regexp_extract(F.coalesce(url, F.lit("")), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    found = F.transform(F.regexp_extract_all(html, F.lit(_LINK), 0), lambda x: F.regexp_extract(x, _HREF, 1))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.when(x.startswith("/") & ~x.startswith("//"), F.concat(origin, x)).otherwise(x))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_header, payload, block_digest, payload_digest of pages that aren't null."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("target_uri"), html.alias("payload")).where("payload is not null")
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    return _identified(rows.withColumn("http_header", header).withColumn("date", F.lit(date)))


def _identified(rows: DataFrame) -> DataFrame:
    rows = with_digest(with_digest(rows, "payload_digest", F.col("payload")), "block_digest", F.concat("http_header", "payload"))
    rows = with_record_id(rows, "record_id", F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri"), F.col("block_digest"))
    return rows.select("page_id", "record_id", "target_uri", "date", "http_header", "payload", "block_digest", "payload_digest")


RECORD = ["page_id", "warc_type", "record_id", "refers_to", "refers_to_uri", "refers_to_date", "warc_date", "content_type", "content_length", "block_digest", "source_header", "source_block_digest", "source_payload_digest", "block"]


def derivatives(rows: DataFrame, made: str = MADE) -> DataFrame:
    """The metadata and the conversion record of each of responses."""
    url, html = F.col("target_uri"), F.col("payload")
    # one row for either record, each of which computes its own columns only; what several expressions read is a column of its own
    rows = rows.withColumn("warc_type", F.explode(F.array(F.lit("metadata"), F.lit("conversion"))))
    meta = F.col("warc_type") == "metadata"
    rows = rows.withColumn("_raw", F.when(meta, F.regexp_extract(html, _TITLE, 1)).otherwise(without_tags(html)))
    rows = rows.withColumn("_text", resolved(F.col("_raw")))
    rows = rows.withColumn("_text", F.when(meta, F.replace("_text", F.lit("\n"), F.lit(" "))).otherwise(F.col("_text")))
    rows = rows.withColumn("_text", squeezed(F.col("_text")))
    rows = rows.withColumn("_language", F.when(meta, F.regexp_extract(F.regexp_extract(html, _HTML, 0), _LANG, 1)))
    line = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    source = F.replace(F.regexp_replace("http_header", "(?:\\r\\n)+$", ""), F.lit("\r\n"), F.lit("\r\nsource-header: "))
    links = F.array_join(F.transform(outlinks(html, url), lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), "")
    metadata = F.concat(line("title", F.col("_text")), line("language", F.col("_language")), F.lit("source-header: "), source, F.lit("\r\nsource-block-digest: "), F.col("block_digest"), F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\n"), links)
    kind = F.when(meta, "application/warc-fields").otherwise("text/plain; charset=utf-8")
    out = rows.select("page_id", "warc_type", F.col("record_id").alias("refers_to"), url.alias("refers_to_uri"), F.col("date").alias("refers_to_date"), F.lit(made).alias("warc_date"), kind.alias("content_type"), F.col("http_header").alias("source_header"), F.col("block_digest").alias("source_block_digest"), F.col("payload_digest").alias("source_payload_digest"), F.when(meta, metadata).otherwise(F.col("_text")).alias("block"))
    out = with_record_id(with_digest(out, "block_digest", F.col("block")), "record_id", F.col("warc_type"), F.col("refers_to"), F.col("block_digest"))
    return out.withColumn("content_length", F.octet_length("block").cast("bigint")).select(*RECORD)


def serialized(records: DataFrame) -> DataFrame:
    """value: a record as it stands in a WARC file, but for the two line ends after it."""
    names = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "refers_to_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Target-URI": "refers_to_uri", "WARC-Date": "warc_date", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "block_digest", "WARC-Source-Block-Digest": "source_block_digest", "WARC-Source-Payload-Digest": "source_payload_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), F.col(v).cast("string"), F.lit("\r\n")), F.lit("")) for k, v in names.items()]
    header = F.regexp_replace("source_header", "(?:\\r\\n)+$", "")
    lines.append(F.coalesce(F.concat(F.lit("WARC-Source-Header: "), F.replace(header, F.lit("\r\n"), F.lit("\r\nWARC-Source-Header: ")), F.lit("\r\n")), F.lit("")))
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), "block").alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files of records, one for each partition."""
    serialized(records).write.option("lineSep", "\r\n\r\n").text(path)


def _records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a file; what follows a record that is cut off is left out."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while (start := raw.find(b"WARC/1.", at)) >= 0:
        end = raw.find(b"\r\n\r\n", start)
        if end < 0:
            return
        pairs = [line.partition(":") for line in raw[start:end].decode("utf-8", "replace").split("\r\n")[1:]]
        headers = [(k.strip(), v.strip()) for k, _, v in pairs]
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), -1)
        if size < 0 or end + 4 + size > len(raw):
            return
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, headers (array of name and value, in their order), block of each record of the WARC files at path; a file is read by one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, (headers, block) in enumerate(_records(raw.as_py())):
                    pairs = pa.array([[{"name": k, "value": v} for k, v in headers]], pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pairs, pa.array([block], pa.binary())], ["file", "nth", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "file string, nth bigint, headers array<struct<name:string,value:string>>, block binary")


def header(name: str) -> Column:
    """The first header of this name, in any case, of records that were read; null without one."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def responses_in(records: DataFrame) -> DataFrame:
    """As `responses`, of the response records among those that were read; page_id is null, and the record's own identifier and digests stay where it has them.

    The block's HTTP header ends with its first empty line; bytes that aren't UTF-8 become replacement characters.
    """
    block = F.decode("block", "UTF-8")
    rows = records.where(header("WARC-Type") == "response").select(F.lit(None).cast("bigint").alias("page_id"), header("WARC-Target-URI").alias("target_uri"), header("WARC-Date").alias("date"), header("WARC-Record-ID").alias("_id"), header("WARC-Block-Digest").alias("_bd"), header("WARC-Payload-Digest").alias("_pd"), block.alias("_block"))
    rows = rows.withColumn("_cut", F.instr("_block", "\r\n\r\n"))
    rows = rows.withColumn("http_header", F.when(F.col("_cut") > 0, F.substring("_block", F.lit(1), F.col("_cut") + 3)).otherwise("")).withColumn("payload", F.when(F.col("_cut") > 0, F.expr("substring(_block, _cut + 4)")).otherwise(F.col("_block")))
    known = rows.select("_id", "_bd", "_pd", "page_id", "target_uri", "date", "http_header", "payload")
    known = with_digest(with_digest(known, "payload_digest", F.col("payload")), "block_digest", F.concat("http_header", "payload"))
    known = with_record_id(known, "record_id", F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri"), F.col("block_digest"))
    pick = lambda own, made: F.coalesce(own, made).alias(made)
    return known.select("page_id", pick("_id", "record_id"), "target_uri", "date", "http_header", "payload", pick("_bd", "block_digest"), pick("_pd", "payload_digest"))


def sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    b32 = lambda h: "'sha1:' || translate(" + " || ".join(f"to_base(('0x' || substr({h}, {1 + 10 * k}, 10))::BIGINT, 32, 8)" for k in range(4)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    sha = lambda x: b32(f"sha1({x})")
    uuid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    put = lambda x, p, r: f"regexp_replace({x}, {quote(p)}, {r}, 'g')"

    code = "(CASE WHEN lower(e[3]) = 'x' THEN ('0x' || regexp_extract(e, '([0-9a-fA-F]+);', 1))::INT ELSE regexp_extract(e, '([0-9a-fA-F]+);', 1)::INT END)"
    named = "CASE e " + " ".join(f"WHEN '&{k};' THEN {quote(v)}" for k, v in ENTITIES.items()) + f" ELSE chr(CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {code} ELSE 65533 END) END"

    def entities(x: str) -> str:
        found = f"list_distinct(regexp_extract_all({x}, {quote(_REFERENCE)}))"
        ordered = f"list_concat(list_filter({found}, lambda e: {named} <> '&'), list_filter({found}, lambda e: {named} = '&'))"
        return f"list_reduce(list_prepend({x}, {ordered}), lambda t, e: replace(t, e, {named}))"

    squeeze = lambda x: "trim(" + put(put(x, "[ \\t\\r\\f ]+", "' '"), " ?\\n[ \\n]*", "chr(10)") + ", ' ' || chr(10))"
    text = put(put(put("html", REMOVED, "''"), _BLOCK_TAG, "chr(10)"), _TAG, "''")
    crlf = "chr(13) || chr(10)"
    line = lambda n, x: f"CASE WHEN {x} <> '' THEN '{n}: ' || {x} || {crlf} ELSE '' END"
    return f"""
    WITH a AS (SELECT page_id, url, html, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} || {crlf} AS header FROM pages WHERE html IS NOT NULL),
    b AS (SELECT *, {sha('html')} AS pd, {sha('header || html')} AS bd FROM a),
    r AS (SELECT *, sha1(concat_ws('|', 'response', coalesce(page_id::VARCHAR, ''), coalesce(url, ''), bd)) AS rh,
        {squeeze(f"replace({entities(f'regexp_extract(html, {quote(_TITLE)}, 1)')}, chr(10), ' ')")} AS title,
        regexp_extract(regexp_extract(html, {quote(_HTML)}), {quote(_LANG)}, 1) AS language,
        regexp_extract(coalesce(url, ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
        list_filter(list_transform(regexp_extract_all(html, {quote(_LINK)}), lambda x: regexp_extract(x, {quote(_HREF)}, 1)), lambda x: x <> '') AS links, {text} AS bare FROM b),
    d AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {line('title', 'title')} || {line('language', 'language')} || 'source-header: '
        || replace(regexp_replace(header, '(?:\\r\\n)+$', ''), {crlf}, {crlf} || 'source-header: ') || {crlf} || 'source-block-digest: ' || bd || {crlf} || 'source-payload-digest: ' || pd || {crlf}
        || array_to_string(list_transform(links, lambda x: 'outlink: ' || CASE WHEN starts_with(x, '/') AND NOT starts_with(x, '//') THEN origin || x ELSE x END || {crlf}), '') AS block FROM r
        UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {squeeze(entities('bare'))} FROM r),
    e AS (SELECT *, {sha('block')} AS block_digest, {uuid('rh')} AS refers_to FROM d)
    SELECT page_id, warc_type, {uuid("sha1(concat_ws('|', warc_type, refers_to, block_digest))")} AS record_id, refers_to, url AS refers_to_uri, '{DATE}' AS refers_to_date, '{MADE}' AS warc_date,
        content_type, strlen(block) AS content_length, block_digest, header AS source_header, bd AS source_block_digest, pd AS source_payload_digest, block FROM e"""
