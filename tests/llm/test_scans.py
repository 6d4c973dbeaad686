"""Licence and secret scans, decontamination, languages, sharding and WARC against brute force, SQL and edges."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quern.llm import decontam, langid, license_scan, secrets, sharding, warc
from quern.llm.shared import table

D = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, rule string, start string, row string, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], EXTRA)


def test_notices_with_edits(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"Code. {mit} End."), (2, "x Relesed undr the MIT License. y"), (3, "Released beneath our MIT-like terms"), (4, None), (5, ""), (6, mit * 3), (6, mit * 3), (None, mit), (7, "a" * 200_000 + mit)]
    got = sorted(map(tuple, license_scan.find_notices(docs_of(spark, rows), {"mit": mit}).collect()), key=str)
    assert (1, "mit", 6, 6 + len(mit), 0) in got and (7, "mit", 200_000, 200_000 + len(mit), 0) in got
    assert any(r[0] == 2 and r[4] == 2 for r in got) and not any(r[0] in (3, 4, 5) for r in got)
    assert sum(r[0] == 6 for r in got) == 6 and sum(r[0] is None for r in got) == 1
    assert license_scan.find_notices(docs_of(spark, []), {"mit": mit}).collect() == []


def test_notices_equal_a_scan_without_seeds(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, D, "documents").collect()]
    finder = license_scan.Finder(license_scan.NOTICES)
    want = set()
    for i, t in texts:
        low = license_scan.fold(t)
        for k, name in enumerate(finder.names):
            want |= {(i, name, a, b, n) for a, b, n in finder.best(k, low, 0, len(low))}  # the search over the whole text
    got = {tuple(r) for r in license_scan.find_notices(table(spark, D, "documents")).collect()}
    assert got == want and len(want) > 5


def test_thousands_of_adjacent_notices_equal_a_scan_without_seeds(spark):
    names = ["all-rights-reserved", "mit"]
    texts = {1: license_scan.NOTICES[names[0]] * 4000, 2: f"{license_scan.NOTICES[names[1]]}\n" * 3000, 3: "All rigts reserved.\n" * 500}
    notices = {n: license_scan.NOTICES[n] for n in names}
    finder = license_scan.Finder(notices)
    want = []
    for doc_id, text in texts.items():
        low = license_scan.fold(text)
        for k, name in enumerate(names):
            at = 0
            while m := finder.patterns[k].search(low, at):
                want.append((doc_id, name, m.start(), m.end(), sum(m.fuzzy_counts)))
                at = m.end()
    got = [tuple(r) for r in license_scan.find_notices(docs_of(spark, list(texts.items())), notices).collect()]
    assert len(want) == 7500 and sorted(got) == sorted(want)


def test_trigram_queries():
    assert secrets.trigram_query("[a-z]+") is True and secrets.trigram_query("ab") is True
    assert secrets.trigram_query("abcd") == ("and", [b"abc", b"bcd"])
    assert secrets.trigram_query("(?:abc|xyz)") == ("or", [b"abc", b"xyz"]) and secrets.trigram_query("(?:abc|.)") is True
    assert secrets.trigram_query("abc?d*") is True and secrets.trigram_query("(?i)ABC") == b"abc"


def test_secrets_equal_a_scan_of_all(spark):
    key = "AKIA" + "A1" * 8
    rows = [(r["doc_id"], r["text"]) for r in table(spark, D, "documents").collect()] + [(900, None), (901, ""), (902, f"k {key} {key}"), (None, key), (903, "é" * 100_000 + " " + key), (904, "api_key = 'abcdefgh1'"), (905, "0" * 64)]
    rows += list(enumerate(['access_token = "abcdefgh1"', 'client_secret: "abcdefgh1"', "DB_PASSWORD='abcdefgh1'", 'secret_key = "abcdefgh1"', 'AWS_SECRET_ACCESS_KEY="abcdefgh1"', 'tokenizer = "abcdefgh1"'], 910))
    want = sorted(((i, n, m.start(), m.end()) for i, t in rows if t for n, p in secrets.RULES.items() for m in re.finditer(p, t, re.ASCII)), key=str)
    got = sorted(((r["doc_id"], r["rule"], r["start"], r["end"]) for r in secrets.find_secrets(docs_of(spark, rows)).collect()), key=str)
    assert {r[0] for r in got if r[1] == "assigned_secret"} >= {904, *range(910, 915)} and not any(r[0] == 915 for r in got)
    assert got == want and (903, "aws_access_key", 100_001, 100_021) in got
    assert secrets.find_secrets(docs_of(spark, [])).collect() == []


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", t.lower())


def test_phrases_in_planted_texts(spark):
    item = " ".join(f"term{i}" for i in range(20))
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x"), (10, "too short", "x"), (11, item, "x")], "item_id long, text string, doc_id string")
    rows = [(1, f"before {item} after"), (2, "clean words only here"), (3, None), (4, ""), (None, item), (5, "y " * 100_000 + item), (6, " ".join(item.split()[:13])), (12, " ".join(item.split()[:5]))]
    got = {(r["doc_id"], r["item_id"]): (r["phrases"], r["first_pos"]) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    assert got[1, 7] == got[1, 11] == (8, 1) and got[5, 7] == (8, 100_000) and got[6, 7] == (1, 0) and got[None, 7] == (8, 0)
    assert {k[0] for k in got} == {1, None, 5, 6}
    kept = decontam.drop_contaminated(docs_of(spark, rows), bench, broadcast_rows=0)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 3, 4, 12], key=str) and len(kept.columns) == 6
    rare = " ".join(["theta", "iota", "kappa", "lambda", "omega", "sigma", "upsilon", "unseen1", "unseen2", "unseen3"])
    edited = docs_of(spark, [(1, "theta x iota y kappa z lambda w omega v sigma u upsilon"), (2, "theta iota"), (3, "y " * 400_000 + "theta iota kappa"), (4, "lambda omega sigma upsilon")])
    near = decontam.contaminated(edited, spark.createDataFrame([(1, rare)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["phrases"], r["best"]) for r in near] == [(1, 0, 7)]  # words that no document has don't count against an edited copy
    blocks = {tuple(r) for r in decontam.contaminated(docs_of(spark, rows), bench, block_bytes=100).collect()}
    assert blocks == {tuple(r) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    assert decontam.contaminated(docs_of(spark, []), bench).collect() == [] and decontam.contaminated(docs_of(spark, rows), bench.limit(0)).collect() == []


def test_segments_of_any_size_give_the_same(spark):
    docs, bench = table(spark, D, "documents"), table(spark, D, "benchmark")
    want = {}
    grams = {}
    for b in bench.collect():
        w = words(b["text"])
        n = min(len(w), decontam.PHRASE)
        if len(w) >= decontam.LEAST:
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i : i + n]), []).append(b["item_id"])
    for r in docs.collect():
        w = words(r["text"])
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                for item in grams.get(tuple(w[i : i + n]), ()):
                    want[r["doc_id"], item] = want.get((r["doc_id"], item), 0) + 1
    got = {(r["doc_id"], r["item_id"]): r["phrases"] for r in decontam.contaminated(docs, bench).collect() if r["phrases"]}
    assert got == want


def test_languages_on_held_out_documents(spark):
    docs = table(spark, D, "documents")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.fit(train)
    want = {r["doc_id"]: (r["lang"], len(r["text"])) for r in test.collect()}
    got = {r["doc_id"]: (r["language"], r["accepted"]) for r in langid.identify(test, model).collect()}
    long = [i for i, (_, n) in want.items() if n > 200]
    assert np.mean([got[i][0] == want[i][0] for i in long]) > 0.95 and np.mean([got[i][1] for i in want]) > 0.95


def test_long_texts_and_texts_of_several_languages_are_claimed(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("text is not null and doc_id % 2 = 1")
    model = langid.fit(table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 2 = 0"))
    by = {r["lang"]: " ".join(r["t"]) for r in docs.groupBy("lang").agg(F.sort_array(F.collect_list("text")).alias("t")).collect() if r["lang"]}
    mixed = " ".join(r["text"] for r in docs.orderBy(F.xxhash64("doc_id")).limit(800).collect())
    few = " ".join(t[i : i + 20_000] for i in range(0, 200_000, 20_000) for t in by.values())
    signs = np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz     "), 1_000_000)
    texts = [("en", (by["en"] * 2)[:5_000_000]), *((n, t[:1_500_000]) for n, t in by.items()), ("mixed", mixed), ("few", few), ("none", "".join(signs)), ("none", "".join(signs[:3000]))]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(rows, model).collect()}
    for i, (name, _) in enumerate(texts):
        assert got[i]["accepted"] == (name != "none"), (i, name, got[i])
        if name in by:
            assert got[i]["language"] == name and got[i]["score"] > 0.5, (i, name, got[i])


def test_pieces_cover_texts(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 10)
    cut, first = langid.pieces(np.array([0, 10, 10, 35, 36]))
    assert cut.tolist() == [0, 10, 10, 18, 26, 35, 36] and first.tolist() == [0, 1, 2, 5]


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 !!", "en", "x"), (4, "the cat and the dog", "en", "x"), (5, "le chat et le chien", "fr", "x"), (None, "the cat and the dog", None, "x")], "doc_id long, text string, lang string, row string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[1]["language"] is None and not got[2]["accepted"] and not got[3]["accepted"] and got[4]["language"] == "en" and got[None]["language"] == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, None}
    twice = langid.identify(docs.unionByName(docs)).collect()  # repeated rows are scored each
    assert sorted(map(str, twice)) == sorted(2 * [str(r) for r in langid.identify(docs, langid.fit(docs.unionByName(docs))).collect()])
    tie = langid.fit(spark.createDataFrame([(1, "same words", "b", "x"), (2, "same words", "a", "x")], docs.schema))
    assert langid.identify(spark.createDataFrame([(9, "same words", None, "x")], docs.schema), tie).first()["language"] == "a"
    assert langid.keep_identified(docs.where("lang is null")).collect() == [] and langid.identify(docs.limit(0)).collect() == []


def test_presence_counts_each_ngram_once():
    x, has = langid.presence(Slice_of(["abab", "abab abab", "", "12"]))
    assert has.tolist() == [True, True, False, False] and set(np.unique(x)) <= {0, 1} and (x[0] <= x[1]).all()


def Slice_of(texts):
    from quern.llm.textvec import Slice

    return Slice(pa.array(texts))


@pytest.mark.parametrize("bundles", [4096, 6])
def test_shards_equal_a_loop_of_the_rule(spark, bundles):
    """The whole query against a plain loop over groups and bundles; with few bundles most groups share one."""
    docs, shards, heavy = table(spark, D, "documents"), 4, 0.02
    keyed = docs.select("doc_id", "text", F.xxhash64("text", F.md5("text")).alias("key")).withColumn("bundle", F.pmod(F.xxhash64(F.lit("bundle"), "key"), F.lit(shards * bundles))).collect()
    amounts = {r["doc_id"]: np.array([len(r["text"].encode()), len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"])), 1]) for r in keyed}
    totals = sum(amounts.values()).astype(float)
    groups: dict = {}
    for r in keyed:
        groups[r["key"], r["bundle"]] = groups.get((r["key"], r["bundle"]), 0) + amounts[r["doc_id"]]
    items: dict = {}
    item_of = {}
    for (key, bundle), x in groups.items():
        item_of[key] = item = ("alone", key) if (x / totals).max() > heavy / shards else ("bundle", bundle)
        items[item] = items.get(item, 0) + x
    residual, place = np.full((shards, 3), 1 / shards), {}
    order = sorted(items, key=lambda i: (-(items[i] / totals).max(), -(items[i] / totals).sum(), i[1] if i[0] == "alone" else 0, i[1] if i[0] == "bundle" else -1))
    for item in order:
        x = items[item] / totals
        place[item] = int((residual[:, 0] * x[0] + residual[:, 1] * x[1] + residual[:, 2] * x[2]).argmax())
        residual[place[item]] -= x
    got = {r["doc_id"]: (r["bytes"], r["tokens"], r["shard"]) for r in sharding.shard_documents(docs, shards, bundles=bundles).collect()}
    assert got == {r["doc_id"]: (int(amounts[r["doc_id"]][0]), int(amounts[r["doc_id"]][1]), place[item_of[r["key"]]]) for r in keyed}
    largest = max((x / totals).max() for x in items.values())
    assert (1 / shards - residual).max() < 1 / shards + 2 * largest


def test_packing_follows_the_dot_product():
    shares = np.array([[0.4, 0.1], [0.1, 0.4], [0.2, 0.2]])
    residual = np.full((2, 2), 0.5)
    want, r = [], residual.copy()
    for s in shares:
        k = int(np.argmax(r @ s))
        want.append(k)
        r[k] -= s
    assert sharding.pack(shares, residual).tolist() == want and np.allclose(residual, r)


def test_shard_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "a b"), (5, "a b"), (None, "a b")]
    got = [tuple(r) for r in sharding.shard_documents(docs_of(spark, rows), 3).collect()]
    assert len(got) == 7 and len({r[3] for r in got if r[1] == 3}) == 1 and len({r[3] for r in got if r[0] in (3, 4)}) == 1
    assert sharding.shard_documents(docs_of(spark, []), 3).collect() == []
    third = [(i, "one text of a third of all rows" if i % 3 == 0 else f"text {i} of {i % 7}") for i in range(3000)] + [(9999, "w " * 500_000)]
    got = sharding.shard_documents(docs_of(spark, third), 8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0 and r["doc_id"] < 3000}) == 1 and len(got) == 3001
    rows = [sum(r["shard"] == k for r in got) for k in range(8)]
    assert sorted(rows)[-1] >= 1000 and sorted(rows)[0] > 0


def test_warc_records(spark):
    import base64
    import hashlib

    html = '<html lang="en"><head><title>A &amp; B</title><script>x</script></head><body><p>One</p><!-- c --><p>Two &#233;</p><a href="/l">L</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a.b/c", html, "x"), (2, None, "", "x"), (3, "http://n.u", None, "x"), (1, "http://a.b/c", html, "x")], "page_id long, url string, html string, block string")
    answers = warc.responses(pages)
    got = warc.derivatives(answers).collect()
    assert len(got) == 6
    r = answers.where("page_id = 1").first()
    sha = lambda s: "sha1:" + base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert r["payload_digest"] == sha(html) and r["block_digest"] == sha(r["http_header"] + html)
    meta, text = (next(x for x in got if x["page_id"] == 1 and x["warc_type"] == t) for t in ("metadata", "conversion"))
    assert text["refers_to"] == meta["refers_to"] == r["record_id"] and text["block"] == "A & B\nOne\nTwo é\nL" and text["block_digest"] == sha(text["block"])
    assert "title: A & B" in meta["block"] and "outlink: http://a.b/l" in meta["block"] and r["payload_digest"] in meta["block"] and "source-header: HTTP/1.1 200 OK" in meta["block"]
    assert len({x["record_id"] for x in got}) == 4 and all(x["content_length"] == len(x["block"].encode()) for x in got)
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []
    assert warc.serialized(warc.derivatives(answers)).where("value like 'WARC/1.1%'").count() == 6


def test_warc_files_keep_source_headers_and_digests(spark, tmp_path):
    html = '<html lang="en"><title>T</title><p>One\r\n\r\nWARC/1.0 in a text é</p></html>'
    answers = warc.responses(spark.createDataFrame([(1, "http://a.b/c", html), (2, None, "")], "page_id long, url string, html string"))
    made = warc.derivatives(answers)
    warc.write(made, f"{tmp_path}/out")
    got = {h["WARC-Record-ID"]: (h, r["headers"], r["block"].decode()) for r in warc.read(spark, f"{tmp_path}/out").collect() for h in [{x["name"]: x["value"] for x in r["headers"]}]}
    for r in made.collect():
        h, every, block = got[r["record_id"]]
        assert block == r["block"] and h["WARC-Refers-To"] == r["refers_to"] and h["WARC-Block-Digest"] == r["block_digest"] and h.get("WARC-Target-URI") == r["refers_to_uri"]
        assert h["WARC-Source-Block-Digest"] == r["source_block_digest"] and h["WARC-Source-Payload-Digest"] == r["source_payload_digest"]
        assert "".join(x["value"] + "\r\n" for x in every if x["name"] == "WARC-Source-Header") + "\r\n" == r["source_header"]


def test_responses_of_warc_files(spark, tmp_path):
    import gzip

    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>Ünï</p>".encode()
    record = lambda kind, block, extra="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nwarc-target-uri: http://x.y/\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("warcinfo", b"x")) + gzip.compress(record("response", body, "WARC-Block-Digest: sha1:OWN\r\n")))
    (tmp_path / "b.warc").write_bytes(record("response", b"")[:-40] + b"")
    (r,) = warc.responses_in(warc.read(spark, str(tmp_path))).collect()
    assert (r["record_id"], r["target_uri"], r["payload"], r["block_digest"]) == ("<urn:uuid:response>", "http://x.y/", "<p>Ünï</p>", "sha1:OWN") and r["http_header"].endswith("text/html\r\n\r\n") and len(r["payload_digest"]) == 37
    text = warc.derivatives(warc.responses_in(warc.read(spark, str(tmp_path)))).where("warc_type = 'conversion'").first()
    assert text["block"] == "Ünï" and text["refers_to"] == "<urn:uuid:response>"


def test_hostile_pages_take_linear_time(spark):
    import time

    parts = ["<!-- ", "<script", "<script>", "<style >", "<p ", "<b ", "</", "<title>", "<html", '<html lang="', "<a ", '<a href="', "&#", "&amp", " \n", "</script ", "<script></script "]
    pages = spark.createDataFrame([(i, "u", p * (1_000_000 // len(p))) for i, p in enumerate(parts)], "page_id long, url string, html string").repartition(4).cache()
    pages.count()
    began = time.time()
    assert warc.derivatives(warc.responses(pages)).count() == 2 * len(parts)
    rows = warc.derivatives(warc.responses(pages)).selectExpr("sum(content_length)").first()[0]
    assert rows > 0 and time.time() - began < 60
    got = {r["page_id"]: r["block"] for r in warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", "a<!-- b"), (2, "u", "a<script>x"), (3, "u", "a<p b"), (4, "u", "<title>t")], pages.schema))).where("warc_type = 'conversion'").collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: "t"}


def test_junk_and_other_scripts_are_rejected_whatever_their_length(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = langid.fit(docs)
    signs = "".join(np.random.default_rng(7).choice(list("abcdefghijklmnopqrstuvwxyz     "), 400_000))
    junk = [signs, signs[:300], signs[:40], "xqzw vvkj " * 40, "zzzzzz", "съешь же ещё этих мягких булок", "漢字かな交じり文", "import numpy as np def f(x): return x", "12 34"]
    clean = [r["text"] for r in docs.where("n_chars between 60 and 300").orderBy("doc_id").limit(200).collect()]
    rows = spark.createDataFrame(list(enumerate(junk + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r["accepted"] for r in langid.identify(rows, model).collect()}
    assert [junk[i][:20] for i in range(len(junk)) if got[i]] == [] and np.mean([got[i] for i in range(len(junk), len(got))]) > 0.97


def test_languages_equal_dense_kernels(spark):
    """The whole query on a small table, with the kernels and the regression written out one text at a time."""
    docs = table(spark, D, "documents")
    rows = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}

    def grams(t):
        t = re.sub(r"[^\w]|[\d_]", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in t))
        t = re.sub(" +", " ", t)
        n = max(1, -(-len(t) // langid.PIECE))
        cut = [len(t) * i // n for i in range(n + 1)]
        return [langid.features(np.frombuffer(t[a:b].encode("utf-32-le"), np.uint32), np.array([0, b - a]))[0].astype(np.float64) for a, b in zip(cut[:-1], cut[1:])]

    model = langid.fit(docs)
    land = np.unpackbits(model.bits, axis=1).astype(np.float64)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, (t, _) in rows.items():
        scores = []
        for x in grams(t):
            z = np.array([(x * m).sum() / np.sqrt(x.sum() * m.sum()) for m in land]) @ model.half
            scores.append(z / max(np.linalg.norm(z), langid.SPAN) @ model.weights + model.bias)
        mean = np.mean(scores, axis=0)
        assert model.languages[int(mean.argmax())] == got[i]["language"] and abs(mean.max() - got[i]["score"]) < 1e-3
        assert got[i]["accepted"] == (np.mean([s.max() for s in scores]) >= 0)


def test_long_and_hostile_texts_take_bounded_time(spark):
    import time

    from quern.llm import bpe, token_rollup

    n = 300_000
    texts = ["a" * n, "All rights reserved " * (n // 20), "all rights reserve" * (n // 18), "http://" * (n // 7), "a." * (n // 2), "token=" * (n // 6), "0" * n, "\n" * n, "é" * n, "eyJ" * (n // 3), "'s " * (n // 3), " ".join(f"w{i}" for i in range(n // 8))]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").repartition(4).cache()
    docs.count()
    model = langid.fit(table(spark, D, "documents"))
    for name, made in (("op1", token_rollup.count_tokens(docs, "v", f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")), ("op4", license_scan.find_notices(docs)), ("op7", sharding.shard_documents(docs, 4)), ("op8", langid.identify(docs, model)), ("op9", secrets.find_secrets(docs)), ("op10", bpe.encode_decode(docs))):
        began = time.time()
        rows = made.count()
        assert time.time() - began < 45, name
        assert rows == len(texts) or name in ("op4", "op9")
