"""Quality checks over the index as one union of plans, and the sections of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names by which checks are disabled.
CHECKS = ("frontmatter", "tags", "summary", "low_words", "updated")


def outside(prefixes: Sequence[str]) -> Column:
    """Whether ``path`` starts with none of the prefixes (plain text, no component boundary)."""
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~F.col("path").startswith(p)
    return keep


def empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def without_tags(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """Notes that no tag row belongs to."""
    return notes.join(tags.select("path"), "path", "left_anti")


def findings(notes: DataFrame, tags: DataFrame, min_words: int = 50, skip: Sequence[str] = (), disable: Sequence[str] = ()) -> DataFrame:
    """``ord, check, path, title, word_count``: a row for each note and check it fails.

    Checks in their fixed order: no tags, no summary, fewer than ``min_words`` words, no update date. Two scans of
    the notes at most; a note failing several checks counts for each.
    """
    kept = notes.where(outside(skip)).select("path", "title", "summary", "updated", "word_count")
    flags = [
        (4, "summary", empty("summary")),
        (5, "low_words", F.col("word_count") < F.lit(min_words)),
        (6, "updated", empty("updated")),
    ]
    rows = F.filter(F.array(*[F.when(cond, F.struct(F.lit(o).alias("ord"), F.lit(n).alias("check"))) for o, n, cond in flags if n not in disable] or [F.lit(None).cast("struct<ord:int,check:string>")]), lambda x: x.isNotNull())
    out = kept.select("path", "title", "word_count", F.explode(rows).alias("c")).select("c.ord", "c.check", "path", "title", "word_count")
    if "tags" not in disable:
        out = out.unionByName(without_tags(kept, tags).select(F.lit(3).alias("ord"), F.lit("tags").alias("check"), "path", "title", "word_count"))
    return out


def ordered(found: DataFrame) -> DataFrame:
    """Findings in report order: by check, few words by their number, the rest by path."""
    return found.orderBy("ord", F.when(F.col("check") == "low_words", F.col("word_count")).otherwise(F.lit(0)), "path")


def totals(notes: DataFrame, found: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One row ``notes, issues``; issues count a note once a check."""
    ones = notes.where(outside(skip)).select(F.lit(1).alias("n"), F.lit(0).alias("i"))
    return ones.unionAll(found.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("notes"), F.coalesce(F.sum("i"), F.lit(0)).alias("issues"))
