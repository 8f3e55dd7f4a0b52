"""Embeddings: encoders, exact search by inner product, and keeping stored vectors up to date by content hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Turns texts into vectors of length 1. ``name`` goes into the metadata; a change means a full rebuild."""

    name: str
    dimensions: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic encoder without a model: character trigrams hashed into signed buckets, of length 1."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.name = f"hashing-trigram-{dimensions}"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            low = text.lower()
            for i in range(max(len(low) - 2, 0)):
                h = int.from_bytes(hashlib.blake2b(low[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return mean_pool(out[:, None, :], np.ones((len(texts), 1)))


class PrecomputedEncoder:
    """Looks vectors up by text: for vectors made elsewhere. Unknown texts raise KeyError."""

    def __init__(self, vectors: dict[str, Sequence[float]], name: str = "precomputed"):
        self.vectors, self.name = vectors, name
        self.dimensions = len(next(iter(vectors.values()), []))

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([self.vectors[t] for t in texts], np.float32)


def mean_pool(tokens: np.ndarray, attention: np.ndarray) -> np.ndarray:
    """Mean over attended tokens, then length 1: (n, tokens, d) and (n, tokens) to (n, d)."""
    weight = attention[..., None].astype(np.float32)
    mean = (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def encode_column(df: DataFrame, text: str, encoder: Encoder, into: str = "embedding", batch: int = 8) -> DataFrame:
    """``df`` with the vector of ``text``: batches of similar length, longest first, original order kept."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            order = s.str.len().sort_values(ascending=False, kind="stable").index
            out = pd.Series(index=s.index, dtype=object)
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                for j, v in zip(at, encoder.encode(s[at].tolist()), strict=True):
                    out[j] = v
            yield out

    return df.withColumn(into, run(F.col(text)))


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Inner product, every product widened to double before it is summed in order."""
    constant = F.array(*[F.lit(float(np.float32(x))) for x in query])
    return F.aggregate(F.zip_with(vector, constant, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: Sequence[float], top: int, vector: str = "embedding", ident: str = "path") -> DataFrame:
    """``ident, score`` of the ``top`` rows of greatest inner product with the query, equals by ``ident``.

    Rows without a vector, or of another length, take no part. One pass; each task keeps ``top`` rows.
    """
    usable = vectors.where(F.size(vector) == len(query))
    return usable.select(ident, dot(F.col(vector), query).alias("score")).orderBy(F.desc("score"), F.asc(ident)).limit(top)


def semantic(vectors: DataFrame, notes: DataFrame, query: Sequence[float], top: int) -> DataFrame:
    """``path, score``: the nearest ``top`` notes; those that are not indexed are dropped afterwards, not replaced."""
    return nearest(vectors, query, top).join(notes.select("path"), "path", "left_semi").orderBy(F.desc("score"), F.asc("path"))


def plan_embedding(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, action``: ``keep`` where the stored vector is of the same content, else ``encode``; ``drop`` what is gone."""
    once = lambda df, name: df.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("hash").alias(name))
    old, now = once(stored, "old").withColumn("had", F.lit(True)), once(current, "hash").withColumn("has", F.lit(True))
    both = now.join(old, "path", "full_outer")
    action = F.when(F.col("has").isNull(), "drop").when(F.col("had").isNotNull() & (F.col("hash") == F.col("old")), "keep").otherwise("encode")
    return both.select("path", action.alias("action"))


def update_embeddings(current: DataFrame, stored: DataFrame | None, encoder: Encoder, passage_prefix: str = "", rebuild: bool = False) -> DataFrame:
    """``path, title, hash, embedding`` of every note of ``current`` (``path, title, hash, text``).

    Vectors are reused where path and hash agree with ``stored``; only the rest is encoded, and what is gone is
    left out. With ``rebuild`` (another model or prefix, broken metadata) everything is encoded.
    """
    need = current
    kept = None
    if stored is not None and not rebuild:
        good = stored.where(F.col("embedding").isNotNull()).select("path", "hash", "embedding").dropDuplicates(["path", "hash"])
        kept = current.join(good, ["path", "hash"]).select("path", "title", "hash", "embedding")
        need = current.join(good, ["path", "hash"], "left_anti")
    fresh = encode_column(need.withColumn("text", F.concat(F.lit(passage_prefix), "text")), "text", encoder).select("path", "title", "hash", "embedding")
    return fresh if kept is None else kept.unionByName(fresh)
