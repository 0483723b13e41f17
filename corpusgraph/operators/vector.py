"""Embeddings: validation, a hashing embedder, cache split and exact cosine search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """Not null, not empty, all components finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a literal query; rows of zero norm get 0."""
    length = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, e: s + e)
    return F.when(norm(v) == 0, F.lit(0.0)).otherwise(dot / (norm(v) * F.lit(length)))


def nearest(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = 20) -> DataFrame:
    """The k most similar rows of the query's dimension: filter first, then top-k."""
    if not query or not all(math.isfinite(x) for x in query) or not any(query):
        raise ValueError("the query vector must be finite and not zero")
    rows = df.filter(valid(F.col(vector_col)) & (F.size(vector_col) == len(query)))
    return rows.select(F.col(id_col), cosine(F.col(vector_col), query).alias("similarity")).orderBy(F.desc("similarity"), F.desc(id_col)).limit(k)


def hash_embedder(dim: int = 16):
    """A deterministic bag-of-words embedder as an iterator pandas UDF, for tests and defaults."""
    import hashlib

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            v = [0.0] * dim
            for w in (text or "").lower().split():
                d = hashlib.sha256(w.encode()).digest()
                v[d[0] % dim] += 1.0 if d[1] & 1 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            return [x / size for x in v]

        for batch in batches:
            yield batch.map(one)

    return embed


def cache_split(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses): only misses reach the embedder."""
    return wanted.join(cache, keys, "inner"), wanted.join(cache.select(*keys), keys, "left_anti")


def update_cache(wanted: DataFrame, cache: DataFrame, keys: list[str], text_col: str, embed) -> DataFrame:
    hit, miss = cache_split(wanted, cache, keys)
    fresh = miss.dropDuplicates(keys).withColumn("vector", embed(F.col(text_col)))
    return cache.unionByName(fresh.select(*cache.columns))
