"""Queries of the text and ranking problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomark.llm import lookalike, markup, neighbours, packing, ranking, reading, splitting, tokens
from fathomark.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "note_vectors"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, through the index with its number of cells tuned."""
    return neighbours.neighbours(table(spark, d, "note_vectors"), asked=F.col("vec_id") % 20 == 0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(lookalike.vault_values(*(table(spark, d, n) for n in ("notes", "tags", "corpus"))))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_forms(lookalike.vault_values(*(table(spark, d, n) for n in ("notes", "tags", "corpus"))))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of each value the digest that names its class."""
    return p3_canonical(spark, d).drop("class", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.structure(table(spark, d, "corpus"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(table(spark, d, "corpus"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "corpus"), table(spark, d, "collected_notes"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every item, as digests of themselves."""
    cut = splitting.pieces(splitting.vault_items(table(spark, d, "corpus"), table(spark, d, "collected_notes")))
    return cut.select("item_table", "path", "ord", "begin", "end", F.md5("piece").alias("digest")).distinct()


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item add up to: its characters and blanks without overlaps, and how many pieces are too
    long, leave a gap, or overlap by less than 100 or more than 200 characters."""
    cut = splitting.pieces(splitting.vault_items(table(spark, d, "corpus"), table(spark, d, "collected_notes")))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    narrow = cut.select("item_table", "path", "item", "ord", "begin", "end", blanks(F.col("piece")).alias("blanks"), F.substring("piece", 1, splitting.OVERLAP_HIGH).alias("head"), F.length("piece").alias("size")).distinct()
    before = F.lag("end", 1, 0).over(Window.partitionBy("item_table", "path", "item").orderBy("ord"))
    shared = narrow.withColumn("shared", before - F.col("begin"))
    wrong = (F.col("size") > splitting.LIMIT) | (F.col("size") != F.col("end") - F.col("begin"))
    apart = F.when(F.col("ord") == 1, F.col("shared") != 0).otherwise(~F.col("shared").between(splitting.OVERLAP_LOW, splitting.OVERLAP_HIGH))
    return shared.groupBy("item_table", "path", "item").agg(
        F.max("end").alias("chars"), F.sum(F.col("blanks") - blanks(F.substring("head", F.lit(1), F.col("shared").cast("int")))).alias("blanks"),
        F.sum(wrong.cast("long")).alias("too_long"), F.sum(apart.cast("long")).alias("apart"),
    ).drop("item")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.clear_winners(table(spark, d, "hits"))


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking(table(spark, d, "hits"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.bands(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_graded(spark: SparkSession, d: str) -> DataFrame:
    """What graded documents come out with: their grade."""
    known = reading.grades(table(spark, d, "reading_labels")).select("doc_id")
    return p10_levels(spark, d).join(known, "doc_id", "left_semi").select("doc_id", F.round("level", 6).alias("level"), "band")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_nearest": p2_nearest, "p3_found": p3_found, "p3_canonical": p3_canonical, "p3_classes": p3_classes, "p4_found": p4_found, "p4_clean": p4_clean,
    "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_cover": p5_cover, "p7_found": p7_found, "p7_ranking": p7_ranking,
    "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_levels": p10_levels, "p10_graded": p10_graded,
}


# Letters and the letters they look like, as the SQL that checks the operator has them. The operator takes
# them from the Unicode data instead, so the two do not share a table.
_LIKE_LATIN = {
    "A": "ΑА", "B": "ΒВ", "C": "ϹС", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ͿЈ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟОՕ", "P": "ΡР",
    "S": "ЅՏ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "a": "ɑа", "c": "ϲс", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "ϳј",
    "n": "ո", "o": "οоօ", "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "-": "‐‑",
    "力": "カ", "口": "ロ", "夕": "タ", "卜": "ト", "工": "エ", "二": "ニ", "八": "ハ", "へ": "ヘ", "一": "ー",
}


def _look_sql(column: str) -> str:
    """The mapped form in SQL: characters replaced one for one, others spelled out, the result composed."""
    letters = {ord(c): to for to, others in _LIKE_LATIN.items() for c in others}
    table = lookalike.with_letters(lookalike.plain_forms(), letters)
    one = {k: v for k, v in table.items() if v is not None and len(v) == 1}
    gone = "".join(chr(k) for k, v in table.items() if v is None)
    long = {chr(k): v for k, v in table.items() if v is not None and len(v) > 1}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"translate({column}, {quote(''.join(map(chr, one)) + gone)}, {quote(''.join(one.values()))})"
    for k, v in long.items():
        sql = f"replace({sql}, {quote(k)}, {quote(v)})"
    return f"nfc_normalize({sql})"


def _values() -> str:
    return """every AS (
  SELECT 'title' AS field, path AS key, title AS value FROM notes
  UNION SELECT 'tag', tag, tag FROM tags
  UNION SELECT 'content', path, content FROM corpus),
vals AS (SELECT * FROM every WHERE value IS NOT NULL AND key IS NOT NULL)"""


_HITS = """
WITH scores AS (
  SELECT query_id, path, lower(regexp_replace(via, '\\s+', '', 'g')) AS stream, max(score) AS score
  FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND via IS NOT NULL GROUP BY ALL),
ranks AS (
  SELECT query_id, path, stream, rank() OVER w - 1 AS above,
         rank() OVER w + (count(*) OVER (PARTITION BY query_id, stream, score) - 1) / 2.0 AS r
  FROM scores WHERE stream IN ('bm25', 'vec', 'bm25+vec')
  WINDOW w AS (PARTITION BY query_id, stream ORDER BY score DESC)),
notes AS (SELECT query_id, path, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT DISTINCT query_id, path FROM hits)),
points AS (
  SELECT n.query_id, n.path, count(r.r) * any_value(n) - coalesce(sum(r.r), 0) + (3 - count(r.r)) * (any_value(n) - 1) / 2.0 AS points,
         count(*) FILTER (r.above < 3) AS top
  FROM notes n LEFT JOIN ranks r USING (query_id, path) GROUP BY n.query_id, n.path)
"""

_VECTORS = """
WITH usable AS (
  SELECT DISTINCT vec_id, vector::DOUBLE[64] AS v FROM note_vectors
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id, b.vec_id AS other, array_cosine_similarity(a.v, b.v) AS cosine
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id)
"""

ORACLES: dict[str, str] = {
    "p2_found": _VECTORS + """
SELECT DISTINCT least(vec_id, other) AS vec_a, greatest(vec_id, other) AS vec_b FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 6) DESC, other) AS place FROM pairs)
WHERE place <= 5 AND cosine >= 0.9
""",
    "p5_found": """
SELECT DISTINCT 'corpus' AS item_table, path FROM corpus WHERE length(content) > 2000
UNION ALL
SELECT 'collected_notes', path FROM collected_notes GROUP BY path HAVING length(arg_max(text, collected_at)) > 2000
""",
    "p5_cover": """
WITH items AS (
  SELECT DISTINCT 'corpus' AS item_table, path, content AS text FROM corpus
  UNION ALL
  SELECT 'collected_notes', path, arg_max(text, collected_at) FROM collected_notes GROUP BY path)
SELECT item_table, path, length(text) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS blanks, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS apart
FROM items WHERE text IS NOT NULL
""",
    "p7_found": _HITS + "SELECT query_id, arg_min(path, (-points, path)) AS path FROM points GROUP BY query_id HAVING count(*) FILTER (top = 3) = 1",
    "p7_ranking": _HITS + "SELECT query_id, path, CAST(points AS DOUBLE) AS points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, path) AS position FROM points",
    "p3_classes": f"""
WITH {_values()},
forms AS (SELECT field, key, md5(value) AS vid, {_look_sql("value")} AS form FROM vals)
SELECT DISTINCT field, key, min(vid) OVER (PARTITION BY field, form) AS canonical FROM forms
""",
    "p10_graded": """
WITH g AS (SELECT doc_id, avg(band) AS grade FROM (SELECT DISTINCT doc_id, reader, band FROM reading_labels WHERE band BETWEEN 1 AND 4 AND doc_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, round(grade, 6) AS level, CAST(round_even(grade, 0) AS BIGINT) AS band FROM documents JOIN g USING (doc_id) WHERE text IS NOT NULL
""",
    "p3_found": f"""
WITH {_values()},
forms AS (SELECT field, key, value, {_look_sql("value")} AS form FROM vals),
kinds AS (SELECT field, form, value, min(key) AS other FROM forms GROUP BY ALL)
SELECT DISTINCT a.field, least(key, other) AS key_a, greatest(key, other) AS key_b
FROM forms a JOIN kinds b ON a.field = b.field AND a.form = b.form AND a.value <> b.value AND key <> other
""",
}
