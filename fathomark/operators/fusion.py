"""Fusing a lexical and a vector ranking by weighted reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame, order: list[Column], depth: int) -> DataFrame:
    """``path, rank``: the first ``depth`` rows numbered from 1. The window is over at most ``depth`` rows."""
    return hits.orderBy(*order).limit(depth).select("path", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def weights(bm25: float, vector: float, has_vector: bool) -> tuple[float, float]:
    """The two weights made to sum to 1; without vectors theirs is 0. Both 0 stay 0."""
    vector = vector if has_vector else 0.0
    total = bm25 + vector
    return (bm25 / total, vector / total) if total > 0 else (bm25, vector)


def reciprocal_rank_fusion(lexical: DataFrame, vectors: DataFrame | None, top: int, k: int = 60, bm25_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """``path, score, via, bm25_rank, vec_rank`` of the ``top`` notes of two rankings (``path, rank`` each).

    Equal scores keep lexical order, then vector order. Without a vector ranking the lexical one has all the weight.
    """
    w_bm25, w_vec = weights(bm25_weight, vector_weight, vectors is not None)
    a = lexical.select("path", F.col("rank").alias("bm25_rank"))
    if vectors is None:
        both = a.withColumn("vec_rank", F.lit(None).cast("long"))
    else:
        both = a.join(vectors.select("path", F.col("rank").alias("vec_rank")), "path", "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) * (F.lit(1.0) / (F.lit(k) + F.col(r)).cast("double")), F.lit(0.0))
    via = F.concat_ws("+", F.when(F.col("bm25_rank").isNotNull(), "bm25"), F.when(F.col("vec_rank").isNotNull(), "vec"))
    fused = both.select("path", (part(w_bm25, "bm25_rank") + part(w_vec, "vec_rank")).alias("score"), via.alias("via"), "bm25_rank", "vec_rank")
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vec_rank")).limit(top)
