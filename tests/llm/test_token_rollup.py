"""The rollup against counts from scratch, commits sent twice, compaction and edges."""

from __future__ import annotations

import base64
from collections import Counter

import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, token_rollup
from quern.llm.shared import new_folder

FILE = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(file: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def totals(df) -> dict:
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in df.collect()}


def test_query_equals_counts_from_scratch(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    low = {r["doc_id"] for r in labels if r["quality"] == 0}
    want: Counter = Counter()
    for version, file in token_rollup.VERSIONS.items():
        enc = encoder(f"{bpe.TOKENIZERS}/{file}")
        for r in docs:
            if r["doc_id"] in toxic:
                continue
            text = "\n".join(dict.fromkeys(r["text"].split("\n"))) if r["doc_id"] in low else r["text"]
            want[r["source"], r["lang"], version, "d"] += 1
            want[r["source"], r["lang"], version, "t"] += len(enc.encode_ordinary(text))
    got = totals(token_rollup.maintained(spark, d))
    assert got == {k[:3]: (n, want[*k[:3], "t"]) for k, n in want.items() if k[3] == "d"}


def rows(spark, *x):
    return spark.createDataFrame(list(x), "doc_id long, text string, source string, lang string, tokenizer string")


def test_batches_count_once_and_compaction_keeps_totals(spark):
    store = token_rollup.Store(spark, new_folder(spark, "rollup"))
    assert totals(store.totals()) == {}
    counts = token_rollup.count_tokens(rows(spark, (1, "hello world", "a", None, "clash"), (1, "hello world", "a", None, "clash"), (2, None, None, "en", None), (None, "", "b", "en", None)), "v", FILE)
    assert store.commit("one", token_rollup.inserts(counts)) and not store.commit("one", token_rollup.inserts(counts))
    want = {("a", None, "v"): (2, 4), (None, "en", "v"): (1, 0), ("b", "en", "v"): (1, 0)}
    assert totals(store.totals()) == want
    store.compact()
    assert totals(store.totals()) == want
    assert not store.commit("one", token_rollup.inserts(counts))
    assert store.commit("two", token_rollup.deletes(counts.where("doc_id = 1")))
    assert store.commit("none", token_rollup.inserts(counts.limit(0)))
    assert totals(store.totals()) == {(None, "en", "v"): (1, 0), ("b", "en", "v"): (1, 0)}
    store.compact()
    assert not store.commit("two", token_rollup.deletes(counts))
    assert store.commit("three", token_rollup.inserts(counts)) and len(store._names("batches")) == 3  # "one" was folded twice
    store.compact()
    assert not store.commit("one", token_rollup.inserts(counts)) and len(store._names("batches")) == 1
    assert store.commit("four", token_rollup.deletes(counts))
    assert len(totals(store.totals())) == 2


def test_anew_counts_another_text_of_the_row(spark):
    docs = rows(spark, (1, "a b\na b", "s", "l", "x"), (2, "a", "s", "l", "x"), (3, None, "s", "l", "x"))
    got = token_rollup.count_tokens(docs, "v", FILE, token_rollup.without_repeated_lines(F.col("text")))
    assert {r["doc_id"]: (r["n_tokens"], r["n_anew"]) for r in got.collect()} == {1: (5, 2), 2: (1, 1), 3: (0, 0)}
