"""Queries of the general record problems, and the SQL that says the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomark.operators import changes, orphans
from fathomark.session import shared_dir, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.direct_orphans(table(spark, d, "notes"), table(spark, d, "links"), table(spark, d, "tags"))


def p1_cascade(spark: SparkSession, d: str) -> DataFrame:
    names = ("notes", "links", "tags", "collected_notes", "meta_notes", "note_vectors", "hits")
    return orphans.orphan_report({n: table(spark, d, n) for n in names})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The feed of a data directory stays in the shared folder: a second call works off only what is new since the first."""
    root = f"{shared_dir(spark).rstrip('/')}/fathomark/feeds/{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    return changes.capture_changes(*(table(spark, d, n) for n in ("collected_notes", "meta_notes", "meta")), root=root)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_cascade": p1_cascade, "p6_found": p6_found}

_PRESENCE = """
lived AS (SELECT path, CASE WHEN path LIKE '%.md' THEN left(path, length(path) - 3) ELSE path END AS stem,
                 min(ingested_at) AS first_at, min(deleted_at) AS gone_at FROM notes WHERE path IS NOT NULL GROUP BY path),
parts AS (SELECT link_id, seen_at, split_part(target, '#', 1) AS head FROM links WHERE target IS NOT NULL),
refs AS (
  SELECT DISTINCT 'links' AS ref_table, link_id AS ref_id, seen_at AS seen,
         CASE WHEN head LIKE '%.md' THEN left(head, length(head) - 3) ELSE head END AS stem, CAST(NULL AS VARCHAR) AS path
  FROM parts WHERE head NOT IN ('', '.md')
  UNION ALL
  SELECT DISTINCT 'tags', tag_id, seen_at, NULL, path FROM tags WHERE path IS NOT NULL)
"""

_P1 = f"""
WITH {_PRESENCE},
judged AS (
  SELECT ref_table, ref_id, seen, count(l.path) AS n,
         coalesce(bool_or(l.first_at <= seen AND (l.gone_at IS NULL OR seen < l.gone_at)), false) AS here,
         coalesce(bool_or(l.first_at > seen), false) AS after
  FROM refs r LEFT JOIN lived l ON (r.path = l.path) OR (r.stem = l.stem) OR ends_with(l.stem, '/' || r.stem)
  GROUP BY ref_table, ref_id, seen)
SELECT DISTINCT ref_table, ref_id, CASE WHEN n = 0 THEN 'missing' WHEN after THEN 'later' ELSE 'deleted' END AS kind,
       strftime(seen, '%Y-%m') AS period
FROM judged WHERE NOT here
"""

_P1_CASCADE = f"""
WITH {_PRESENCE},
every AS (SELECT ref_table, CAST(ref_id AS VARCHAR) AS rid, seen, stem, path FROM refs
          UNION ALL SELECT DISTINCT 'collected_notes', path || '|' || CAST(collected_at AS VARCHAR), collected_at, NULL, path FROM collected_notes WHERE path IS NOT NULL),
judged AS (
  SELECT ref_table, rid, seen, any_value(e.path) AS path, coalesce(bool_or(l.first_at <= seen AND (l.gone_at IS NULL OR seen < l.gone_at)), false) AS here
  FROM every e LEFT JOIN lived l ON (e.path = l.path) OR (e.stem = l.stem) OR ends_with(l.stem, '/' || e.stem)
  GROUP BY ref_table, rid, seen),
timed AS (SELECT ref_table, rid, strftime(seen, '%Y-%m') AS period, path FROM judged WHERE NOT here),
alive_notes AS (SELECT DISTINCT path FROM judged WHERE ref_table = 'collected_notes' AND here),
dead_notes AS (SELECT DISTINCT path FROM timed WHERE ref_table = 'collected_notes' AND path NOT IN (SELECT path FROM alive_notes)),
vec AS (SELECT DISTINCT CAST(vec_id AS VARCHAR) AS rid, path FROM note_vectors),
mn AS (SELECT DISTINCT CAST(run_id AS VARCHAR) || '|' || path AS rid, path FROM meta_notes WHERE path IS NOT NULL),
hit AS (SELECT DISTINCT CAST(query_id AS VARCHAR) || '|' || path || '|' || via AS rid, path FROM hits WHERE path IS NOT NULL),
collected AS (SELECT DISTINCT path FROM collected_notes WHERE path IS NOT NULL),
children AS (
  SELECT t, rid, path, CASE WHEN path NOT IN (SELECT path FROM collected) THEN 'direct' WHEN path IN (SELECT path FROM dead_notes) THEN 'inherited' END AS origin
  FROM (SELECT 'note_vectors' AS t, * FROM vec UNION ALL SELECT 'meta_notes', * FROM mn) WHERE path IS NOT NULL),
dead_vec AS (
  SELECT DISTINCT path FROM children WHERE t = 'note_vectors' AND origin IS NOT NULL
  EXCEPT SELECT path FROM children WHERE t = 'note_vectors' AND origin IS NULL),
hits_judged AS (
  SELECT rid, CASE WHEN path NOT IN (SELECT path FROM vec WHERE path IS NOT NULL) THEN 'direct' WHEN path IN (SELECT path FROM dead_vec) THEN 'inherited' END AS origin FROM hit)
SELECT ref_table, period, 'direct' AS origin, count(*) AS n FROM timed GROUP BY ALL
UNION ALL SELECT 'links', strftime(seen_at, '%Y-%m'), 'inherited', count(DISTINCT link_id) FROM links
  WHERE path IN (SELECT path FROM dead_notes) AND CAST(link_id AS VARCHAR) NOT IN (SELECT rid FROM timed WHERE ref_table = 'links') GROUP BY ALL
UNION ALL SELECT 'tags', strftime(seen_at, '%Y-%m'), 'inherited', count(DISTINCT tag_id) FROM tags
  WHERE path IN (SELECT path FROM dead_notes) AND CAST(tag_id AS VARCHAR) NOT IN (SELECT rid FROM timed WHERE ref_table = 'tags') GROUP BY ALL
UNION ALL SELECT t, NULL, origin, count(*) FROM children WHERE origin IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'hits', NULL, origin, count(*) FROM hits_judged WHERE origin IS NOT NULL GROUP BY ALL
"""

#: The latest good run.
RUN_SQL = """
runs AS (
  SELECT CAST(regexp_extract(key, '^\\s*run/(\\d+)/', 1) AS BIGINT) AS run_id,
         bool_and(lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) = 'ok') FILTER (key LIKE '%/state%') AS ok,
         max(TRY_CAST(value AS DOUBLE)) FILTER (key LIKE '%/generated%') AS seen
  FROM meta WHERE regexp_matches(key, '^\\s*run/\\d+/') GROUP BY 1),
run AS (SELECT run_id FROM runs WHERE ok ORDER BY seen DESC NULLS LAST, run_id DESC LIMIT 1)"""

_P6 = f"""
WITH {RUN_SQL},
now AS (SELECT path, lower(trim(arg_max(hash, collected_at))) AS h FROM collected_notes WHERE path IS NOT NULL GROUP BY path),
was AS (SELECT path, list(DISTINCT lower(trim(hash))) FILTER (hash IS NOT NULL) AS hs FROM meta_notes SEMI JOIN run USING (run_id) WHERE path IS NOT NULL GROUP BY path)
SELECT path, CASE WHEN was.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM now FULL JOIN was USING (path)
WHERE was.path IS NULL OR now.path IS NULL OR h IS NULL OR h = '' OR NOT coalesce(list_contains(hs, h), false)
"""

ORACLES: dict[str, str] = {"p1_found": _P1, "p1_cascade": _P1_CASCADE, "p6_found": _P6}
