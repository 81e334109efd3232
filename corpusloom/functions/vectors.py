"""Column functions on vectors, in doubles, and a hashing embedder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(norm(a), scaled)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x * x))


def hashing_embedder(text: Column | str, dim: int = 64) -> Column:
    """array<float> of a text without a model: signed hashes of its words, added up and
    brought to length one.  Any function of a text column fits in its place."""

    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> np.ndarray:
            v = np.zeros(dim)
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            n = np.sqrt((v * v).sum())
            return (v / n if n else v).astype(np.float32)

        for some in texts:
            yield some.map(one)

    return F.pandas_udf(embed, "array<float>")(text)
