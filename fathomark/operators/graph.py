"""The link graph: resolving raw wikilink targets to notes, links and backlinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.functions.paths import note_part, path_suffixes, stem_path


def suffix_table(notes: DataFrame) -> DataFrame:
    """``suffix, resolved``: every trailing run of path components of every note."""
    return notes.where(F.col("path").isNotNull()).select("path").distinct().select(F.explode(path_suffixes(F.col("path"))).alias("suffix"), F.col("path").alias("resolved"))


def targets(links: DataFrame) -> DataFrame:
    """``path, target, part``: distinct links that name a note; anchors into the own note are left out."""
    return links.select("path", "target").distinct().withColumn("part", note_part(F.col("target"))).where(F.col("part").isNotNull())


def edges(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``path, target, resolved``: each link with every note it can mean; an ambiguous link gives several rows.

    Distinct parts are resolved once and the result is joined back, so a target that a third of all links share is
    looked up once.
    """
    own = targets(links)
    found = own.select("part").distinct().join(suffix_table(notes), F.col("part") == F.col("suffix")).select("part", "resolved")
    return own.join(found, "part").select("path", "target", "resolved")


def unresolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``path, target`` of links that no note answers."""
    return targets(links).join(suffix_table(notes), F.col("part") == F.col("suffix"), "left_anti").select("path", "target")


def ambiguous(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``target, notes``: targets that several notes answer, and how many."""
    parts = targets(links).select("target", "part").distinct()
    many = suffix_table(notes).groupBy("suffix").agg(F.count("*").alias("notes")).where("notes > 1")
    return parts.join(many, F.col("part") == F.col("suffix")).select("target", "notes")


def links_of(links: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """``resolved, target`` of the notes that ``path`` links to: each once, under the first of its targets, in the order of targets."""
    found = edges(links.where(F.col("path") == path), notes)
    first = found.groupBy("resolved").agg(F.min(F.struct("target", "resolved")).alias("m"))
    return first.select(F.col("m.target").alias("target"), "resolved").orderBy("target", "resolved")


def backlinks(links: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """``path, date`` of the notes that may link to ``path``, latest first, without a date last, equals by path."""
    own = notes.sparkSession.createDataFrame([(path,)], "path string").select(F.explode(path_suffixes(F.col("path"))).alias("part"))
    sources = targets(links).join(F.broadcast(own), "part", "left_semi").select("path").distinct()  # as many rows as the path has components
    return notes.join(sources, "path", "left_semi").select("path", F.coalesce("date", F.lit("")).alias("date")).orderBy(F.desc("date"), F.asc("path"))


def backlink_counts(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``path, backlinks``: how many notes may link to each note that any links to."""
    pairs = edges(links, notes).select("path", "resolved").distinct()
    return pairs.groupBy(F.col("resolved").alias("path")).agg(F.count("*").alias("backlinks"))


def resolve_note(notes: DataFrame, name: str) -> DataFrame:
    """``path`` of the notes that a note argument can mean: that very path if there is such a note, else those that end in it."""
    known = notes.where(F.col("path").isNotNull()).select("path").distinct()
    exact = known.where(F.col("path") == name)
    if not exact.isEmpty():
        return exact
    stem = name[:-3] if name.endswith(".md") else name
    stemmed = stem_path(F.col("path"))
    return known.where((stemmed == stem) | stemmed.endswith("/" + stem))
