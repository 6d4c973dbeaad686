"""The stages on planted rows, their kept rows against plain loops over all pairs and places, and edges."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken

import corpus_pipeline
from quern.llm import bpe, decontam, langid, simhash
from quern.llm.shared import table
from quern.llm.textvec import Slice


def test_stages_on_planted_rows(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    item = max((r["text"] for r in table(spark, sf_dir, "benchmark").collect()), key=len)
    clean = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").first()
    plant = [(10_001, clean["text"], "en", "s"), (10_002, clean["text"] + " again", "en", "s"), (10_003, "xqzw vvkj " * 40, "en", "s"), (10_004, f"Unlike text {item}", "en", "s"), (10_005, None, "en", "s"), (10_006, "", None, None)]
    rows = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in plant], docs.schema)
    out = docs.unionByName(rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out.write.parquet(path := f"file://{tmp_path}/{name}")
        out = stage(spark, spark.read.parquet(path), sf_dir)
        if name != "bpe":
            assert out.columns == docs.columns
        seen[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert not {10_005, 10_006} & seen["language_id"] and 10_001 in seen["language_id"]
    assert 10_001 not in seen["exact_dedup"] and {clean["doc_id"], 10_002} <= seen["exact_dedup"]
    assert 10_002 not in seen["near_dedup"] and 10_004 in seen["near_dedup"]
    assert 10_004 not in seen["decontamination"] and seen["bpe"] == seen["decontamination"]
    assert all(r["round_trip"] for r in out.collect())


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", t.lower())


def first_of(rows, same):
    """The rows by doc_id of which none before them is of the same group."""
    kept, seen = [], set()
    for i, t in sorted(rows):
        if same(i) not in seen:
            seen.add(same(i))
            kept.append((i, t))
    return kept


def hits(docs, items):
    """doc_ids with a phrase of the benchmark, or with enough of an item's rarest words within its span."""
    n_docs: dict = {}
    for _, t in docs:
        for w in set(words(t)):
            n_docs[w] = n_docs.get(w, 0) + 1
    out = set()
    for item in items:
        w = words(item)
        size = min(len(w), decontam.PHRASE) if len(w) >= decontam.LEAST else 0
        grams = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if size else set()
        rare = set(sorted((x for x in set(w) if x in n_docs), key=lambda x: (n_docs[x], x))[: decontam.RARE])
        for i, t in docs:
            d = words(t)
            if grams and any(tuple(d[a : a + size]) in grams for a in range(len(d) - size + 1)):
                out.add(i)
            at = [a for a, x in enumerate(d) if x in rare]
            if len(rare) >= decontam.NEED and any(len({d[b] for b in at if a <= b < a + len(w) + decontam.SLACK}) >= decontam.NEED for a in at):
                out.add(i)
    return out


def test_stages_equal_plain_loops(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = max((t for _, t in texts), key=len)[:3000]
    plant = [(10_001, clean), (10_002, clean), (10_003, clean + " again"), (10_004, "xqzw vvkj " * 40), (10_005, f"Unlike text {max(items, key=len)}"), (10_006, "")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None if i == 10_004 else "en", "s", len(t)) for i, t in plant], docs.schema))
    rows, out = texts + plant, docs
    for name, stage in corpus_pipeline.STAGES:
        out.write.parquet(path := f"file://{tmp_path}/loops-{name}")
        before = spark.read.parquet(path)
        out = stage(spark, before, sf_dir)
        if name == "language_id":
            accepted = {r["doc_id"] for r in langid.identify(before).where("accepted").collect()}  # `test_languages_equal_dense_kernels` has its loop
            rows = [(i, t) for i, t in rows if i in accepted]
        elif name == "exact_dedup":
            of = dict(rows)
            rows = first_of(rows, lambda i: of[i])  # noqa: B023
        elif name == "near_dedup":
            fp, _ = simhash.simhashes(Slice(pa.array([t for _, t in rows])))
            bits = np.unpackbits(fp.view(np.uint8), axis=1).astype(np.int32)
            near = (bits[:, None] != bits[None]).sum(axis=2) <= simhash.RADIUS
            root = np.arange(len(rows))
            for _ in rows:
                root = np.array([root[near[i]].min() for i in range(len(rows))])
            group = dict(zip([i for i, _ in rows], root.tolist()))
            rows = first_of(rows, lambda i: group[i])  # noqa: B023
        elif name == "decontamination":
            bad = hits(rows, items)
            rows = [(i, t) for i, t in rows if i not in bad]
        got = out.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows), name
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}", "rb"))}
    enc = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in got} == {i: enc.encode_ordinary(t) for i, t in rows}
    assert 10_004 not in dict(rows) and 10_005 not in dict(rows) and len({10_001, 10_002, 10_003} & set(dict(rows))) <= 1


def test_stages_on_empty_and_odd_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' as `row`", "1 as p0", "2 as keep_id", "3 as `first`")
    odd = odd.unionByName(odd.where("doc_id < 3")).unionByName(odd.where("doc_id = 5").selectExpr("cast(null as bigint) doc_id", "text || ' Unlike others, this one has a number of further words in it' text", "cast(null as string) lang", "source", "n_chars", "`row`", "p0", "keep_id", "`first`"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
        out = stage(spark, odd, sf_dir)
        if name != "bpe":
            assert out.columns == odd.columns, name
        assert out.count() > 0, name
