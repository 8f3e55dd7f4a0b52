"""Link targets and note paths as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def note_part(target: Column) -> Column:
    """The part of a raw link target that names a note: up to the first ``#``, one final ``.md`` dropped.

    NULL for null and empty targets and for anchors into the note itself.
    """
    head = F.substring_index(target, "#", 1)
    stem = stem_path(head)
    return F.when(stem != "", stem)


def _drop_tail(value: Column, count: int) -> Column:
    return F.substring(value, F.lit(1), F.length(value) - F.lit(count))


def stem_path(path: Column) -> Column:
    """A note's path without its final ``.md``."""
    return F.when(path.endswith(".md"), _drop_tail(path, 3)).otherwise(path)


def path_suffixes(path: Column) -> Column:
    """Every trailing run of path components of ``path`` without ``.md``: the keys under which a link finds a note.

    Exploding them turns "equals or ends with /target" into an equality, so link resolution is a hash or merge
    join on a key instead of a nested loop over all notes.
    """
    parts = F.split(stem_path(path), "/")
    size = F.size(parts)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(parts, i, size - i + F.lit(1)), "/"))
