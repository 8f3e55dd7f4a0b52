"""Browsing by tag, title and date, tag counts, and the details of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.functions.text import like_any



def _by_date(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("date"), F.asc("path"))


def _dated(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.coalesce("date", F.lit("")).alias("date"))


def by_tag(notes: DataFrame, tags: DataFrame, keyword: str, mode: str = "compat") -> DataFrame:
    """``path, date`` of notes with a tag that contains ``keyword``, latest first; each note once (semi-join)."""
    return _by_date(_dated(notes).join(tags.where(like_any(F.col("tag"), keyword, mode)).select("path"), "path", "left_semi"))


def by_title(notes: DataFrame, keyword: str, mode: str = "compat") -> DataFrame:
    """``path, date`` of notes whose title contains ``keyword``, latest first."""
    return _by_date(_dated(notes.where(like_any(F.col("title"), keyword, mode))))


def recent(notes: DataFrame, count: int = 10) -> DataFrame:
    """``path, date`` of the ``count`` latest notes that have a date; a negative count means all."""
    ordered = _by_date(_dated(notes).where(F.col("date") != ""))
    return ordered if count < 0 else ordered.limit(count)


def tag_counts(tags: DataFrame) -> DataFrame:
    """``tag, count``: how many rows have each tag, most first, equals by tag. Null tags are none."""
    return tags.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("tag"))


def tags_of(tags: DataFrame) -> DataFrame:
    """``path, tags``: a note's distinct tags in order."""
    return tags.where(F.col("tag").isNotNull()).groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def enrich(hits: DataFrame, notes: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows of ``hits`` with ``title, date, tags, summary``; notes that are gone are dropped.

    ``hits`` has at most as many rows as a search's limit; the tags are reduced to the hits' notes before they are
    collected, so nothing else is grouped.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    details = notes.select("path", F.coalesce("title", F.lit("")).alias("title"), text("date"), text("summary"))
    wanted = hits.select("path").distinct()
    own = tags_of(tags.join(wanted, "path", "left_semi"))
    rest = [c for c in hits.columns if c not in ("title", "date", "summary", "tags")]
    return (
        hits.select(*rest).join(details, "path").join(own, "path", "left")
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    )
