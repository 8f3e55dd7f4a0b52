"""One ranking from scores on different scales: Borda count over averaged competition ranks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.operators.ordering import running_before, salted_join

#: The streams that ``hits.via`` names, and their say.
WEIGHTS: Mapping[str, float] = {"bm25": 1.0, "vec": 1.0, "bm25+vec": 1.0}


def stream_scores(hits: DataFrame) -> DataFrame:
    """``query_id, path, stream, score``: one row for each, with its best score; ``via`` in lower case without blanks.

    Null and not-a-number scores are none. Rows without query or path are no hits.
    """
    return (
        hits.where(F.col("query_id").isNotNull() & F.col("path").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
        .select("query_id", "path", F.lower(F.regexp_replace("via", r"(?U)\s+", "")).alias("stream"), "score")
        .where(F.col("stream").isNotNull())
        .groupBy("query_id", "path", "stream")
        .agg(F.max("score").alias("score"))
    )


def stream_ranks(scores: DataFrame) -> DataFrame:
    """``query_id, path, stream, above, rank``: how many notes score higher, and the rank with ties averaged."""
    distinct = scores.groupBy("query_id", "stream", "score").agg(F.count("*").alias("same"))
    placed = running_before(distinct, ["query_id", "stream"], [F.col("score").desc()], F.col("same"), "above")
    placed = placed.select("query_id", "stream", "score", "above", (F.col("above") + (F.col("same") + 1) / F.lit(2.0)).alias("rank"))
    return scores.join(placed, ["query_id", "stream", "score"]).select("query_id", "path", "stream", "above", "rank")


def borda(hits: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``query_id, path, points, top``: weighted Borda points of every note hit by a query.

    In each stream a note of rank r among the query's n notes earns n - r; without a score there it is taken to
    stand in the middle, (n + 1) / 2. Points depend on ranks alone, so no stream prevails through large numbers.
    ``top`` counts the streams in which fewer than three notes score higher. A note with no valid score at all
    stands in the middle everywhere. Streams without a weight do not count. Empty hits give an empty result.
    """
    say = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    ranks = stream_ranks(stream_scores(hits)).withColumn("w", say[F.col("stream")]).where(F.col("w").isNotNull())
    per_note = ranks.groupBy("query_id", "path").agg(
        F.sum(F.col("w") * F.col("rank")).alias("wr"), F.sum("w").alias("ws"), F.sum((F.col("above") < 3).cast("int")).alias("top")
    )
    notes = hits.where(F.col("query_id").isNotNull() & F.col("path").isNotNull()).select("query_id", "path").distinct()
    sizes = notes.groupBy("query_id").agg(F.count("*").alias("n"))
    both = salted_join(notes.join(per_note, ["query_id", "path"], "left"), sizes, ["query_id"], ["path"])
    whole = float(sum(weights.values()))
    ws, wr = F.coalesce("ws", F.lit(0.0)), F.coalesce("wr", F.lit(0.0))
    points = ws * F.col("n") - wr + (F.lit(whole) - ws) * (F.col("n") - 1) / F.lit(2.0)
    return both.select("query_id", "path", F.round(points, 9).alias("points"), F.coalesce("top", F.lit(0)).alias("top"))


def ranking(hits: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``query_id, path, points, position``: all notes of each query, most points first, equals by path."""
    placed = running_before(borda(hits, weights), ["query_id"], [F.col("points").desc(), F.col("path")], 1, "before")
    return placed.select("query_id", "path", "points", (F.col("before") + 1).alias("position"))


def clear_winners(hits: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``query_id, path``: the first note of the ranking for each query in which exactly one note is among the
    best three scores of every stream."""
    return (
        borda(hits, weights)
        .groupBy("query_id")
        .agg(F.min(F.struct((-F.col("points")).alias("p"), "path")).alias("m"), F.sum((F.col("top") == len(weights)).cast("int")).alias("clear"))
        .where("clear = 1")
        .select("query_id", F.col("m.path").alias("path"))
    )
