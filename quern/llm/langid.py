"""Language identification by string kernels.

Kernel.  A text has as features the character n-grams of n = 1..4 that occur in it, each by
presence, with blanks and other signs made one blank and letters lower-cased; n-grams of every length count alike
(a blended spectrum).  N-grams are hashed to `DIMENSION` buckets.  k(x, y) is the number of
features in common over the root of the product of their numbers.

Model.  `landmarks` texts span the feature space by Nyström's method: z(x) = K_mm^(-1/2) k(x, landmarks), brought
to length 1 unless it is shorter than `SPAN`.  Its length falls as a text has few features that the landmarks share, to about 0.3 for a single
word and 0.15 for another script; its direction tells the language for a text of any length.
One-versus-rest kernel ridge regression on z has targets 1 and -1.  It is fitted on at most
`per_language` labelled texts of each language, those of the lowest hash of doc_id; all
other texts are only scored.

Scoring.  Texts are fitted and scored in successive pieces of like length, of at most `PIECE` letters and blanks, as a longer
one would fill the buckets.  A batch of pieces is a 0/1 matrix; its product with the landmarks' matrix gives all
kernels, and two more products all scores.  A text's scores are the means over its pieces.  It is rejected where no
language claims it: the mean of its pieces' highest scores, each under a language of its own, is
below `threshold`, halfway between the targets, or it has no letters.  What is of none of the languages scores about the
regression's constant, -0.2 to -0.5 with four languages.

Null and empty texts, and those without letters, have no language and are rejected, with null scores.
Null labels aren't learned from.  Where two languages score alike the first by name is chosen.  Where
no labelled text is there, nothing is claimed.  Texts are taken whole, rows repeated are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.textvec import LETTER, Slice, classes, hold, lower_table, slices

DIMENSION = 1 << 14
ORDERS = (1, 2, 3, 4)
PIECE = 1024
SPAN = 0.25
RESULT = "doc_id bigint, language string, score double, margin double, accepted boolean"


@lru_cache(None)
def _folded() -> np.ndarray:
    """Each code point's letter, or a blank."""
    return np.where(classes() == LETTER, lower_table(), np.uint32(32))


def folded(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a slice in letters and single blanks, their offsets, and whether each has letters."""
    low = _folded()[part.cp]
    doc = np.repeat(np.arange(part.n, dtype=np.int64), np.diff(part.at))
    letters = low != 32
    has = np.bincount(doc[letters], minlength=part.n) > 0
    # one blank for several
    keep = np.ones(len(low), bool)
    keep[1:] = letters[1:] | letters[:-1] | (doc[1:] != doc[:-1])
    at = np.zeros(part.n + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=part.n), out=at[1:])
    return low[keep], at, has


def features(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features of folded texts low[at[i]:at[i + 1]] as a 0/1 matrix."""
    n_texts = len(at) - 1
    out = np.zeros((n_texts, DIMENSION), np.float32)
    flat = out.reshape(-1)
    low = low[at[0] : at[-1]]
    doc = np.repeat(np.arange(n_texts, dtype=np.int64), np.diff(at))
    base = doc * DIMENSION
    code = np.zeros(len(low), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(low) - n + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(0x01000193) + (low[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            if n in ORDERS:
                h = ((code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)).astype(np.int64)
                at = base[:m] + h
                inside = doc[:m] == doc[n - 1 :]
                flat[at[inside]] = 1
    return out


def presence(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts of a slice as a 0/1 matrix, and whether each has letters."""
    low, at, has = folded(part)
    return features(low, at), has


def pieces(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the pieces of texts with offsets at, and each text's first piece."""
    size = np.diff(at)
    count = np.maximum(1, -(-size // PIECE))
    first = np.cumsum(count) - count
    nth = np.arange(count.sum()) - np.repeat(first, count)
    return np.append(np.repeat(at[:-1], count) + np.repeat(size, count) * nth // np.repeat(count, count), at[-1]), first


def _batches(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded text and matrix."""
    for a, b in slices(texts, size):
        for c in range(a, b, 256):
            yield c, min(b, c + 256)


class Model:
    """Landmarks and weights: scores are z @ weights + bias."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int, ridge: float):
        self.languages = sorted(set(labels))
        y = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0).astype(np.float64)
        array = pa.array(texts, pa.string())
        # every language gives landmarks in turn
        turn = np.zeros(len(labels), int)
        for c in self.languages:
            own = np.flatnonzero(np.array(labels) == c)
            turn[own] = np.arange(len(own))
        chosen = np.sort(np.argsort(turn, kind="stable")[:landmarks])
        x = np.concatenate([presence(Slice(array.take(pa.array([i]))))[0] for i in chosen])
        self.bits = np.packbits(x.astype(bool), axis=1)
        self.root = np.sqrt(x.sum(axis=1))
        self._matrix = None
        kmm = (x @ x.T) / np.outer(self.root, self.root)
        value, vector = np.linalg.eigh(kmm.astype(np.float64))
        good = value > 1e-6 * value.max()
        half = vector[:, good] / np.sqrt(value[good])
        self.half = half.astype(np.float32)
        parts = [self._pieces(Slice(array.slice(a, b - a))) for a, b in _batches(array)]
        z = np.concatenate([z for z, _, _ in parts])
        z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
        count = np.concatenate([np.diff(np.append(first, len(z))) for z, first, _ in parts])
        wz = z / np.repeat(count, count)[:, None]  # a text counts once, however many pieces it has
        w = np.linalg.solve(wz.T @ z + ridge * np.eye(z.shape[1]), wz.T @ np.repeat(y, count, axis=0))
        self.weights, self.bias = w[:-1], w[-1]

    def matrix(self) -> np.ndarray:
        if self._matrix is None:
            self._matrix = np.ascontiguousarray(np.unpackbits(self.bits, axis=1).astype(np.float32).T)
        return self._matrix

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrix": None}

    def kernel(self, x: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return (x @ self.matrix()) / sizes[:, None] / self.root[None, :]

    def directions(self, x: np.ndarray) -> np.ndarray:
        """z of features, of length 1, or shorter where what they share with the landmarks is shorter than `SPAN`."""
        z = self.kernel(x) @ self.half
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), SPAN)

    def _pieces(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """z of the pieces of the texts of a slice, each text's first piece, and whether each has letters."""
        low, at, has = folded(part)
        cut, first = pieces(at)
        return np.concatenate([self.directions(features(low, cut[a : a + 257])) for a in range(0, len(cut) - 1, 256)]), first, has

    def claims(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts of a slice, the means of their pieces' highest scores, and whether each has letters."""
        z, first, has = self._pieces(part)
        s = z @ self.weights + self.bias
        n = np.diff(np.append(first, len(s)))
        return np.add.reduceat(s, first) / n[:, None], np.add.reduceat(s.max(axis=1), first) / n, has


def fit(docs: DataFrame, per_language: int = 400, landmarks: int = 256, ridge: float = 1.0) -> Model | None:
    """A model of docs(doc_id, text, lang); None without any labelled text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and length(text) > 0")
    # hashes alone are sorted first, so that no more texts are moved than the sample has
    hashed = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = rows.select("lang", F.xxhash64("doc_id").alias("h")).withColumn("nth", hashed).where(F.col("nth") <= per_language).groupBy("lang").agg(F.max("h").alias("last"))
    near = rows.join(F.broadcast(last), "lang").where(F.xxhash64("doc_id") <= F.col("last"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    sample = sorted(near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "nth", "text").collect())
    return Model([r["text"] for r in sample], [r["lang"] for r in sample], landmarks, ridge) if sample else None


def identify(docs: DataFrame, model: Model | None = None, threshold: float = 0.0, carry: str | None = None, **fitting) -> DataFrame:
    """doc_id, language, score, margin to the next language, accepted for each row of docs(doc_id, text, lang).

    A model that isn't given is fitted on docs.  carry names a column of docs to pass on.
    """
    model = model or fit(docs, **fitting)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "text", *([carry] if carry else [])]
    extra = f", {carry} {docs.schema[carry].dataType.simpleString()}" if carry else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("langid")
        model = sent.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                if model is None:
                    has = np.zeros(b - a, bool)
                    best, claim, language, margin = np.zeros(b - a), np.zeros(b - a), np.zeros(b - a, int), np.zeros(b - a)
                else:
                    s, claim, has = model.claims(Slice(batch.column(1).slice(a, b - a)))
                    language = s.argmax(axis=1)
                    best = s.max(axis=1)
                    s[np.arange(len(s)), language] = -np.inf
                    margin = best - s.max(axis=1) if s.shape[1] > 1 else np.full(len(s), np.nan)
                names = np.array(model.languages if model else [""], object)[language]
                none = ~has
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string(), mask=none), pa.array(best, mask=none), pa.array(margin, mask=none | np.isnan(margin)), pa.array(has & (claim >= threshold)), *(c.slice(a, b - a) for c in batch.columns[2:])], ["doc_id", "language", "score", "margin", "accepted", *columns[2:]])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns[2:])
    return rows.mapInArrow(work, RESULT + extra)


def keep_identified(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose text some language claims, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row.doc_id", "row.text", "row.lang", "row")
    return identify(rows, carry="row", **parameters).where("accepted").select("row.*")
