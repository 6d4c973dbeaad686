"""Embeddings: a deterministic one for tests and small uses, and the place for a model of one's own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Types

from quern.functions import text as T


def hashed(text: Column, dimension: int = 256) -> Column:
    """Counts of terms by two bytes of their MD5, signed by a third: no model, but texts that share terms are near.

    Null text gives a null vector.  Each different term of a batch is hashed once; counting is one pass over arrays.
    """
    if not 1 <= dimension <= 65536:
        raise ValueError("1 to 65536 dimensions")

    def place(term: str) -> int:
        digest = hashlib.md5(term.encode(), usedforsecurity=False).digest()
        return (digest[0] * 256 + digest[1]) % dimension * 2 + (digest[2] >= 128)

    @F.arrow_udf("array<double>")
    def counted(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = len(lists)
        words = lists.flatten().dictionary_encode()
        places = np.fromiter(map(place, words.dictionary.to_pylist()), np.int64, len(words.dictionary))[words.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = np.bincount(row * 2 * dimension + places, minlength=2 * dimension * n).reshape(n, dimension, 2)
        values = pa.array((at[:, :, 1] - at[:, :, 0]).astype(np.float64).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), values, mask=lists.is_null()) if n else pa.array([], pa.list_(pa.float64()))

    return counted.asNondeterministic()(T.terms(text))  # else it runs once more for each condition on its result


def with_model(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> Callable[[Column], Column]:
    """An embedding expression of a model: load runs once in each Python worker and gives a function of texts."""
    import pandas as pd

    @F.pandas_udf(Types.ArrayType(Types.FloatType()))
    def embed(batches: "pd.Series") -> "pd.Series":
        model = load()
        texts = batches.fillna("").tolist()
        return pd.Series([v for a in range(0, len(texts), batch) for v in model(texts[a : a + batch])])

    return embed


def pooled(vectors: Column, how: str = "mean") -> Column:
    """One vector of an array of vectors of equal length: the first (cls), the mean, or the greatest value of each place."""
    first = F.get(vectors, F.lit(0))
    if how == "cls":
        return first
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling {how!r}; known: cls, mean, max")
    column = lambda i: F.transform(vectors, lambda v: F.get(v, i).cast("double"))
    one = (lambda i: F.array_max(column(i))) if how == "max" else (lambda i: F.aggregate(column(i), F.lit(0.0), lambda a, x: a + x) / F.size(vectors))
    return F.transform(first, lambda _, i: one(i))
