"""Encoding against a loop of merges, against a public encoder, and the exact round trip."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from quern.llm import bpe
from quern.llm.textvec import Slice

PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HARD = ["", " ", "\n\n  x", "don't can't 'tis we'll've", "a  b   c \n\n\t d", "naïve café 東京 🙂🙂 ½ x²", "ab" * 4000, "'s's 's", "  trailing  ", "  wide", "x" * 700, "!!!???... --", "'", "12345 6 7.8e9"]


def loop_of_merges(word: bytes, rank: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best, i = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


@pytest.mark.parametrize("seed", range(40))
def test_small_vocabularies_against_merges_and_the_literal_automaton(seed):
    rng = np.random.default_rng(seed)
    labels = [b"a", b"b", b"c"]
    while len(labels) < 12:
        x, y = rng.integers(len(labels), size=2)
        if labels[x] + labels[y] not in labels and len(labels[x] + labels[y]) < 7:
            trial = [*labels, labels[x] + labels[y]]
            try:
                bpe.merges_of(trial)
            except ValueError:
                continue
            labels = trial
    merges = bpe.merges_of(labels)
    rank = {x: i for i, x in enumerate(labels)}
    machine = bpe.Automaton(labels, merges)
    arcs, start = bpe.explicit(labels, merges)
    words = [bytes(rng.choice([97, 98, 99], size=n).tolist()) for n in rng.integers(1, 15, size=60)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    ids, n = machine.run(raw, np.cumsum(size) - size, size)
    at = np.cumsum(n) - n
    for w, a, k in zip(words, at, n):
        found = ids[a : a + k].tolist()
        assert found == loop_of_merges(w, rank)
        state = start
        for t in found:
            state = arcs[state][t]  # the literal automaton accepts the path


def test_against_a_public_encoder_with_exact_round_trip(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = HARD + docs
    _, machine = bpe.compiled(PATH)
    ids, at = machine.encode(Slice(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == other.encode_ordinary(t), t[:50]
        assert machine.decode(ids[at[i] : at[i + 1]]).tobytes().decode() == t


def test_caches_that_overflow_change_nothing(monkeypatch):
    import pickle

    _, machine = bpe.compiled(PATH)
    part = Slice(pa.array(HARD * 2))
    want = machine.encode(part)
    small = pickle.loads(pickle.dumps(machine))
    small.reset_arcs(2)
    small.reset_words(2)
    monkeypatch.setattr(bpe, "_CACHE_IDS", 50)
    for _ in range(3):
        got = small.encode(part)
        assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
        assert np.array_equal(small.count(part, bpe.Split(part)), np.diff(want[1]))


def test_long_words_equal_a_public_encoder_in_bounded_time(monkeypatch):
    import time

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, machine = bpe.compiled(PATH)
    rng = np.random.default_rng(4)
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    texts = [letters(20_000, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"), letters(600, "e"), letters(513, "ththe "), letters(9000, "thean"), letters(5000, "éàü東京"), "!" * 3000, " " * 5000 + "x"]
    monkeypatch.setattr(bpe, "_BLOCK", 700)
    for t in texts:
        assert machine.encode(Slice(pa.array([t])))[0].tolist() == other.encode_ordinary(t)
    monkeypatch.undo()
    for t in texts[:2]:
        assert machine.encode(Slice(pa.array([t + "q"])))[0].tolist() == other.encode_ordinary(t + "q")
    began = time.time()
    blob = letters(1_000_000, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    ids, _ = machine.encode(Slice(pa.array([blob])))
    assert machine.decode(ids).tobytes().decode() == blob and time.time() - began < 60


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "hello world", "y"), (4, "hello world", "y"), (4, "hello world", "y")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.encode_decode(docs).collect()), key=str)
    hello = next(r[1] for r in got if r[0] == 4)
    assert (1, None, 0, True) in got and (2, [], 0, True) in got and (None, hello, 2, True) in got and got.count((4, hello, 2, True)) == 2
    assert bpe.encode_decode(docs.limit(0)).collect() == []
