"""The reference model's tables over the test vault: one row a note, distinct tags and links, contents by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.session import table

_FIELDS = ("title", "date", "updated", "summary")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Of each path the row ingested last (of equals, the greatest), unless the note is deleted; missing texts are empty."""
    fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in _FIELDS]
    rows = table(spark, d, "notes").where(F.col("path").isNotNull())
    last = rows.groupBy("path").agg(F.max(F.struct("ingested_at", *fields, F.coalesce("word_count", F.lit(0)).alias("word_count"))).alias("m"), F.max("deleted_at").alias("gone"))
    return last.where(F.col("gone").isNull()).select("path", *[F.col(f"m.{c}").alias(c) for c in (*_FIELDS, "word_count")])


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tags").where(F.col("path").isNotNull() & (F.coalesce("tag", F.lit("")) != "")).select("path", "tag").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").where(F.col("path").isNotNull() & F.col("target").isNotNull()).select("path", "target").distinct()


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """``path, title, content`` as they come, a path perhaps several times; null texts are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return table(spark, d, "corpus").where(F.col("path").isNotNull()).select("path", text("title"), text("content"))


def once(rows: DataFrame, what: dict[str, Column]) -> DataFrame:
    """``path`` and what is asked of its content, once a path: only that is shuffled, not the contents.

    Of several contents of a path the longest counts (of equals, the one of greater hash)."""
    version = F.struct(F.length("content").alias("length"), F.xxhash64("content").alias("hash"))
    asked = rows.select("path", F.struct(version.alias("version"), *[c.alias(n) for n, c in what.items()]).alias("m"))
    return asked.groupBy("path").agg(F.max("m").alias("m")).select("path", *[F.col(f"m.{n}").alias(n) for n in what])


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """``path, title, content`` once a path, where whole contents are what is asked for."""
    return once(corpus_rows(spark, d), {"title": F.col("title"), "content": F.col("content")})


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``path, embedding``: the usable vector with the greatest id of each path."""
    v = F.col("vector")
    good = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table(spark, d, "note_vectors").where(F.col("path").isNotNull() & good)
    return rows.groupBy("path").agg(F.max_by("vector", "vec_id").alias("embedding"))


#: The same views in SQL.
SQL = """
n AS (SELECT path, m.title AS title, m.date AS date, m.updated AS updated, m.summary AS summary, m.word_count AS word_count FROM (
  SELECT path, max({'i': ingested_at, 'title': coalesce(title, ''), 'date': coalesce(date, ''), 'updated': coalesce(updated, ''),
                    'summary': coalesce(summary, ''), 'word_count': coalesce(word_count, 0)}) AS m, max(deleted_at) AS gone
  FROM notes WHERE path IS NOT NULL GROUP BY path) WHERE gone IS NULL),
t AS (SELECT DISTINCT path, tag FROM tags WHERE path IS NOT NULL AND coalesce(tag, '') <> ''),
l AS (SELECT DISTINCT path, target FROM links WHERE path IS NOT NULL AND target IS NOT NULL),
c AS (SELECT path, m.t AS title, m.c AS content FROM (SELECT path, max({'l': length(coalesce(content, '')), 'c': coalesce(content, ''), 't': coalesce(title, '')}) AS m
  FROM corpus WHERE path IS NOT NULL GROUP BY path)),
v AS (SELECT path, arg_max(vector, vec_id) AS embedding FROM note_vectors
      WHERE path IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY path),
part0 AS (SELECT path, target, split_part(target, '#', 1) AS head FROM l),
part AS (SELECT path, target, CASE WHEN head LIKE '%.md' THEN left(head, length(head) - 3) ELSE head END AS part FROM part0 WHERE head NOT IN ('', '.md')),
stem AS (SELECT path, CASE WHEN path LIKE '%.md' THEN left(path, length(path) - 3) ELSE path END AS stem FROM n),
pairs AS (SELECT DISTINCT part, stem.path AS resolved FROM (SELECT DISTINCT part FROM part) p JOIN stem ON stem.stem = part OR ends_with(stem.stem, '/' || part))
"""
