"""Embedding providers. The default needs no model: it hashes tokens into a vector (its ranking is lexical)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

Provider = Callable[[list[str]], np.ndarray]


def hash_embedder(dimensions: int = 64) -> Provider:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), "float32")
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                row[h % dimensions] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out

    return embed


def embed_column(text: Column, provider: Provider) -> Column:
    """array<float> of a text column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(provider(s.fillna("").tolist())))

    return run(text)
