"""Vector ranking: exact cosine KNN behind a vector-space guard, and embedder seams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus cosine in doubles; one where a norm is zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    n = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - dot(x, y) / n)


def knn(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "symbol_id", vec_col: str = "embedding") -> DataFrame:
    """``id, distance, score`` of the nearest vectors of the query's dimension, ties by id.

    The query is a literal, so the scan is one pass without a join and ends in a per-partition top-k. Rows of another
    dimension or with non-finite values are skipped.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vec_col).cast("array<double>")
    sound = (F.size(vec_col) == len(query)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.where(sound).select(F.col(id_col).alias("id"), cosine_distance(v, q).alias("distance"))
    top = d.orderBy("distance", "id").limit(max(0, k))
    return top.select("id", "distance", F.greatest(F.lit(0.0), 1.0 - F.col("distance")).alias("score"))


def guard(persisted: str | None, asked: str | None) -> bool:
    """Score only if a non-empty persisted fingerprint equals the query's."""
    return bool(persisted) and persisted == asked


def fingerprint(backend: str, dim: int, model: str, batch: int, pooling: str, normalize: bool, assets: dict[str, str] | None = None) -> str:
    material = [backend, str(dim), model, str(batch), pooling, str(normalize).lower(), *(f"{k}={v}" for k, v in sorted((assets or {}).items()))]
    return hashlib.sha256("\n".join(material).encode()).hexdigest()


def embedding_text(qualified: Column, signature: Column, docstring: Column, body: Column) -> Column:
    return F.concat_ws("\n", *[F.when(F.length(c) > 0, c) for c in (qualified, signature, docstring, body)])


class Embedder(Protocol):
    dim: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class StubEmbedder:
    """Zero vectors."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), self.dim), np.float32)


class HashingEmbedder:
    """Signed feature hashing of words, L2-normalised: an offline stand-in for a local model."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def build_embedder(backend: str, dim: int = 384) -> Embedder:
    if backend == "stub":
        return StubEmbedder(dim)
    if backend in ("local", "hashing"):
        return HashingEmbedder(dim)
    raise ValueError(f"EMBEDDER_UNAVAILABLE: {backend}")


def embed(df: DataFrame, text_col: str, backend: str = "hashing", dim: int = 384, out_col: str = "embedding") -> DataFrame:
    """Add vectors in Arrow batches; the model is built once per worker batch stream."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build_embedder(backend, dim)
        for texts in batches:
            yield pd.Series(list(model.embed_batch(texts.fillna("").tolist())))

    return df.withColumn(out_col, run(F.col(text_col)))
