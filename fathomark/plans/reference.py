"""Queries of the retrieval engine over the test vault, and the SQL that says the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.functions import text as tx
from fathomark.functions.parse import parse_texts
from fathomark.operators import browse, changes, fusion, graph, health, lexical, vector
from fathomark.plans import vault
from fathomark.plans.problems import RUN_SQL
from fathomark.session import scratch_path, table
from fathomark.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
WITH = "WITH" + vault.SQL
#: The note whose links, backlinks and neighbours are asked for: the hub of the link graph.
HUB = "start-here"


def _scored(df: DataFrame) -> DataFrame:
    return df.select("path", F.round("score", 6).alias("score"))


def _counted(spark: SparkSession, d: str, terms: list[str]) -> DataFrame:
    """Length and term counts of each note: contents are read and counted where they lie."""
    rows = vault.corpus_rows(spark, d)
    return vault.once(rows, lexical.frequencies(rows, terms))


def _hits(spark: SparkSession, d: str, query: str, limit: int = 50) -> lexical.Found:
    terms = tx.split_terms(query)
    if lexical.by_relevance(terms):
        return lexical.Found(lexical.best_scores(_counted(spark, d, terms), terms, limit), "relevance", limit)
    held = vault.once(vault.corpus_rows(spark, d), {"held": lexical.holds_all(terms)}).where("held")
    return lexical.Found(lexical.by_latest(vault.notes(spark, d), held, limit), "date", limit)


def _find(query: str, limit: int = 50) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = _hits(spark, d, query, limit).hits
        return _scored(hits) if "score" in hits.columns else hits

    return run


def _bm25_sql(terms: list[str], limit: int = 50, extra: str = "") -> str:
    quote = lambda t: "'" + t.lower().replace("'", "''") + "'"
    f = ", ".join(
        f"(length(lt) - length(replace(lt, {quote(t)}, ''))) // {len(t)} + (length(lc) - length(replace(lc, {quote(t)}, ''))) // {len(t)} AS f{i}" for i, t in enumerate(terms)
    )
    idf = ", ".join(f"greatest(ln((count(*) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5)), 1e-6) AS i{i}" for i in range(len(terms)))
    score = " + ".join(f"i{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(terms)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""
folded AS (SELECT path, lower(title) AS lt, lower(content) AS lc, greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0) AS len FROM c),
tf AS (SELECT path, len, {f} FROM folded),
st AS (SELECT sum(len) / count(*) AS avg, {idf} FROM tf),
bm AS (SELECT path, {score} AS score FROM tf, st WHERE {every} ORDER BY score DESC, path LIMIT {limit})"""


def find_meta(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many hits, in which order, and whether the limit was reached."""
    found = _hits(spark, d, "pipeline")
    return found.hits.agg(F.count("*").alias("count")).select("count", F.lit(found.order).alias("order"), (F.col("count") >= found.limit).alias("capped"))


def find_postings(spark: SparkSession, d: str) -> DataFrame:
    """A search through stored postings, which this query stores first."""
    place = scratch_path(spark, "postings")
    lexical.write_postings(vault.corpus(spark, d), place)
    return _scored(lexical.search_stored(spark, place, ["calibration", "kitchen"], 50))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(vault.corpus(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = vault.corpus_rows(spark, d)
    return lexical.length_stats(vault.once(rows, {"len": lexical.length_in_grams(rows)}))


def _tag(keyword: str, mode: str = "compat") -> Query:
    return lambda spark, d: browse.by_tag(vault.notes(spark, d), vault.tags(spark, d), keyword, mode)


def title_substring(spark: SparkSession, d: str) -> DataFrame:
    return browse.by_title(vault.notes(spark, d), "Notes")


def list_tags(spark: SparkSession, d: str) -> DataFrame:
    return browse.tag_counts(vault.tags(spark, d))


def recent(spark: SparkSession, d: str) -> DataFrame:
    return browse.recent(vault.notes(spark, d), 10)


def hit_enrich(spark: SparkSession, d: str) -> DataFrame:
    n = vault.notes(spark, d)
    full = browse.enrich(browse.recent(n, 50), n, vault.tags(spark, d))
    return full.select("path", "title", "date", F.array_join("tags", ", ").alias("tags"), "summary")


def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(vault.links(spark, d), vault.notes(spark, d))


def links_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved(vault.links(spark, d), vault.notes(spark, d))


def links_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return graph.ambiguous(vault.links(spark, d), vault.notes(spark, d))


def _hub(spark: SparkSession, d: str) -> str:
    """The path that the hub's name resolves to (the least, should there be several)."""
    found = graph.resolve_note(vault.notes(spark, d), HUB).orderBy("path").first()
    return found.path if found else HUB


def hub_backlinks(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlinks(vault.links(spark, d), vault.notes(spark, d), _hub(spark, d))


def backlink_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlink_counts(vault.links(spark, d), vault.notes(spark, d))


def links_of_busiest(spark: SparkSession, d: str) -> DataFrame:
    """The resolved links of the note that links most (of equals, the least)."""
    links = vault.links(spark, d)
    most = links.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").first()
    return graph.links_of(links, vault.notes(spark, d), most.path if most else "")


def resolve_argument(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_note(vault.notes(spark, d), HUB)


def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return vault.once(vault.corpus_rows(spark, d), {"targets": tx.wikilinks(F.col("content"))}).select("path", F.explode("targets").alias("target"))


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return vault.once(vault.corpus_rows(spark, d), {"word_count": tx.word_count(F.col("content"))})


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = vault.vectors(spark, d).orderBy("path").select("embedding").first()
    return [float(x) for x in row.embedding] if row else [1.0] * 64


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scored(vector.nearest(vault.vectors(spark, d), _query_vector(spark, d), 10))


def semantic_notes(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest, those that are no present note dropped afterwards."""
    return _scored(vector.semantic(vault.vectors(spark, d), vault.notes(spark, d), _query_vector(spark, d), 20))


def embeddings_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()
    top = vector.nearest(e, list(q.embedding), 10, ident="vec_id")
    return top.select("vec_id", F.round("score", 6).alias("score"))


def _hybrid(has_vectors: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        depth = 10 * 4
        words = lexical.best_scores(_counted(spark, d, ["pipeline"]), ["pipeline"], depth)
        words = words.withColumn("score", F.round("score", 9))
        lex = fusion.ranked(words, [F.desc("score"), F.asc("path")], depth)
        vec = None
        if has_vectors:
            near = vector.nearest(vault.vectors(spark, d), _query_vector(spark, d), depth).withColumn("score", F.round("score", 9))
            vec = fusion.ranked(near, [F.desc("score"), F.asc("path")], depth)
        out = fusion.reciprocal_rank_fusion(lex, vec, 10)
        return out.select("path", F.round("score", 12).alias("score"), "via")

    return run


def hybrid_via(spark: SparkSession, d: str) -> DataFrame:
    """How many of the fused hits come from which ranking."""
    return _hybrid(True)(spark, d).groupBy("via").agg(F.count("*").alias("n"))


def embed_plan(spark: SparkSession, d: str) -> DataFrame:
    """What an embedding run over the present contents would keep, encode and drop, against the hashes of the latest good run."""
    run = F.broadcast(changes.latest_good_run(table(spark, d, "meta")))  # one row at most
    now = table(spark, d, "collected_notes").groupBy("path").agg(F.max_by("hash", F.struct("collected_at", "hash")).alias("hash"))
    old = table(spark, d, "meta_notes").join(run, "run_id", "left_semi").groupBy("path").agg(F.max("hash").alias("hash"))
    return vector.plan_embedding(now, old)


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    joined = vault.notes(spark, d).select("path", "title", "summary").join(vault.corpus(spark, d).select("path", "content"), "path")
    text = tx.embedding_text(F.col("title"), F.col("summary"), F.col("content"), "passage: ")
    return joined.select("path", F.sha2(text, 256).alias("digest"))


def _health(check: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        n, t = vault.notes(spark, d), vault.tags(spark, d)
        return health.findings(n, t).where(F.col("check") == check).select("path", "title", "word_count")

    return run


def health_total(spark: SparkSession, d: str) -> DataFrame:
    n, t = vault.notes(spark, d), vault.tags(spark, d)
    return health.totals(n, health.findings(n, t, skip=("drafts/",)), skip=("drafts/",))


def path_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of the sorted path list: one value over all paths in order, a line each, so the paths, sorted by Spark,
    pass through the driver, a partition at a time."""
    digest, many = hashlib.sha256(), 0
    for r in vault.notes(spark, d).select("path").orderBy("path").toLocalIterator():
        digest.update((("\n" if many else "") + r.path).encode())
        many += 1
    return spark.createDataFrame([(digest.hexdigest(), many)], "digest string, notes long")


def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """How many notes were collected after the index was generated."""
    made = table(spark, d, "meta").where("key = 'generated'").agg(F.max(F.trim("value").try_cast("double"))).first()[0]
    rows = table(spark, d, "collected_notes").groupBy("path").agg(F.max("collected_at").alias("at"))
    after = F.unix_micros(F.col("at").cast("timestamp")) / F.lit(1e6) > F.lit(made)
    return rows.agg(F.sum(after.cast("long")).alias("stale"))


def documents_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The documents as notes: fields, and what is wrong with their frontmatter."""
    rows = parse_texts(table(spark, d, "documents").select("doc_id", "path", "text"))
    return rows.select("doc_id", "title", F.array_join("tags", ", ").alias("tags"), "date", "updated", "summary", F.sha2("content", 256).alias("content"), "readable", "issue")


def documents_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = parse_texts(table(spark, d, "documents").select("path", "text"))
    return rows.groupBy("readable", "issue").agg(F.count("*").alias("n"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_texts(table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "path", "text"))


def parsed_content(spark: SparkSession, d: str) -> DataFrame:
    """Of each readable document the body without frontmatter: its digest and words."""
    return _parsed(spark, d).where("readable").select("doc_id", F.sha2("content", 256).alias("digest"), tx.word_count(F.col("content")).alias("word_count"))


def parsed_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _parsed(spark, d).where("readable")
    return rows.select("doc_id", "title", "date", "updated", "summary", F.size("tags").cast("long").alias("tags"), F.array_join("tags", "|").alias("tag_list"))


def parsed_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose frontmatter is broken, and how."""
    return _parsed(spark, d).where(F.col("issue").isNotNull() | ~F.col("readable")).select("doc_id", "issue", "readable")


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many rows the index tables of the documents have, and how many different tags."""
    made = catalog.note_tables(parse_texts(table(spark, d, "documents").select("path", "text")))
    ones = [made[name].select(F.lit(name).alias("t"), F.col("tag").alias("tag") if name == "tags" else F.lit(None).cast("string").alias("tag")) for name in ("notes", "tags", "links", "corpus")]
    every = ones[0].unionAll(ones[1]).unionAll(ones[2]).unionAll(ones[3])
    counts = [F.count_if(F.col("t") == n).alias(n) for n in ("notes", "tags", "links", "corpus")]
    return every.agg(*counts, F.count_distinct("tag").alias("distinct_tags"))


QUERIES: dict[str, Query] = {
    "find_bm25_single": _find("pipeline"), "find_bm25_multi": _find("calibration kitchen"), "find_bm25_accent": _find("déplacé goûter"),
    "find_bm25_cjk": _find("ロボット"), "find_zero": _find("zzqqxx"), "find_short_like": _find("庭"), "find_mixed_like": _find("pipeline 50"),
    "find_meta": find_meta, "find_postings": find_postings, "doc_freq": doc_freq, "corpus_stats": corpus_stats,
    "tag_substring": _tag("Steer"), "tag_wildcard": _tag("s_eer"), "tag_literal": _tag("field_", "literal"), "title_substring": title_substring,
    "list_tags": list_tags, "recent": recent, "hit_enrich": hit_enrich, "links_resolved": links_resolved, "links_unresolved": links_unresolved,
    "links_ambiguous": links_ambiguous, "hub_backlinks": hub_backlinks, "backlink_counts": backlink_counts, "links_of_busiest": links_of_busiest,
    "resolve_argument": resolve_argument, "wikilinks": wikilinks, "word_count": word_count, "semantic_topk": semantic_topk,
    "semantic_notes": semantic_notes, "embeddings_topk": embeddings_topk, "hybrid_rrf": _hybrid(True), "hybrid_degraded": _hybrid(False), "hybrid_via": hybrid_via,
    "embed_plan": embed_plan, "embedding_texts": embedding_texts, "health_no_tags": _health("tags"), "health_no_summary": _health("summary"),
    "health_low_words": _health("low_words"), "health_no_updated": _health("updated"), "health_total": health_total,
    "path_digest": path_digest, "stale_files": stale_files, "documents_parsed": documents_parsed, "documents_issues": documents_issues,
    "parsed_content": parsed_content, "parsed_fields": parsed_fields, "parsed_issues": parsed_issues, "index_counts": index_counts,
}


def _like(term: str) -> str:
    low = f"translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%{term}%'"
    return f"({low.format('c.content')} OR {low.format('c.title')})"


_QUERY_VECTOR = "q AS (SELECT embedding::DOUBLE[64] AS q FROM v ORDER BY path LIMIT 1)"
_NEAREST = _QUERY_VECTOR + ", near AS (SELECT path, array_inner_product(embedding::DOUBLE[64], q) AS score FROM v, q)"
_TAGS = "SELECT path, date FROM n WHERE path IN (SELECT path FROM t WHERE {})"
_ASCII = "translate(tag, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RRF = """
lex AS (SELECT path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r FROM bm),
vec AS (SELECT path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r FROM (SELECT * FROM near ORDER BY score DESC, path LIMIT 40))
SELECT path, round(coalesce(0.4 / (60 + lex.r), 0) + coalesce(0.6 / (60 + vec.r), 0), 12) AS score,
       concat_ws('+', CASE WHEN lex.r IS NOT NULL THEN 'bm25' END, CASE WHEN vec.r IS NOT NULL THEN 'vec' END) AS via
FROM lex FULL JOIN vec USING (path)
ORDER BY coalesce(0.4 / (60 + lex.r), 0) + coalesce(0.6 / (60 + vec.r), 0) DESC, lex.r NULLS LAST, vec.r NULLS LAST LIMIT 10"""
_HUB_PATH = f"hub AS (SELECT coalesce(min(path), '{HUB}') AS hub FROM stem WHERE stem = '{HUB}' OR ends_with(stem, '/{HUB}'))"
_GRAMS = """
g AS (SELECT path, 'title' AS field, lower(title) AS x FROM c UNION ALL SELECT path, 'content', lower(content) FROM c),
grams AS (SELECT path, substr(x, i, 3) AS gram FROM (SELECT path, x, unnest(range(1, length(x) - 1)) AS i FROM g))"""

_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}\x{1c}-\x{1f}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_GAP = _BLANK.replace(r"\s", r" \t\f\r")
#: The documents' frontmatter as lines of plain scalars and lists, which is all that these tables hold; other lines among
#: them make it unreadable.
_PARSED = rf"""
raw AS (SELECT doc_id, path, text, {_TRIM('text')} AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT *, split_part(t, chr(10), 1) AS head, substr(t, length(split_part(t, chr(10), 1)) + 1) AS rest FROM raw),
flags AS (SELECT *, regexp_full_match(head, '-{{3,}}{_BLANK}*') AND regexp_matches(rest, '(?m)^-{{3,}}{_BLANK}*$') AS framed FROM cut),
parts AS (SELECT *, CASE WHEN framed THEN regexp_extract(rest, '(?ms)\A(.*?)^-{{3,}}{_GAP}*$', 1) ELSE '' END AS fm,
  CASE WHEN framed THEN {_TRIM(rf"regexp_extract(rest, '(?ms)\A.*?^-{{3,}}{_GAP}*$(.*)', 1)")} ELSE t END AS content FROM flags),
counts AS (SELECT *, len(regexp_extract_all(fm, '(?m)^[a-z]+:(?:[ \r]|$)')) AS keyed, len(regexp_extract_all(fm, '(?m)^[^\s#-]')) AS begun FROM parts),
read AS (SELECT *, NOT (framed AND keyed > 0 AND begun > keyed) AS readable FROM counts)"""
_FIELD = lambda k: f"trim(regexp_extract(fm, '(?m)^{k}: +(.*?){_GAP}*$', 1))"
_FIELDS = rf"""
listed AS (SELECT *, CASE WHEN regexp_matches(fm, '(?m)^tags: *\[') THEN list_filter(list_transform(string_split(regexp_extract(fm, '(?m)^tags: *\[(.*)\]', 1), ','), lambda x: trim(x)), lambda x: x <> '')
  ELSE list_transform(regexp_extract_all(regexp_extract(fm, '(?m)^tags:[ ]*\n((?:[ ]*- .*\n?)+)', 1), '(?m)^ *- (.*)$', 1), lambda x: trim(x)) END AS tl FROM read),
fields AS (SELECT doc_id, readable, content, tl, CASE WHEN {_FIELD('title')} <> '' THEN {_FIELD('title')}
  WHEN regexp_matches(content, '(?m)^#{_GAP}(.+)$') THEN {_TRIM(f"regexp_extract(content, '(?m)^#{_GAP}(.+)$', 1)")}
  ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '\.md$', '') END AS title,
  {_FIELD('date')} AS date, {_FIELD('updated')} AS updated, {_FIELD('summary')} AS summary FROM listed)"""
_UNCLOSED_SQL = f"starts_with(text, '---') AND (NOT contains(text, chr(10)) OR NOT regexp_matches(substr(text, length(split_part(text, chr(10), 1)) + 2), '(?m)^---{_BLANK}*$'))"

ORACLES: dict[str, str] = {
    **{
        name: f"{WITH}, {_bm25_sql(terms)} SELECT path, round(score, 6) AS score FROM bm"
        for name, terms in {
            "find_bm25_single": ["pipeline"], "find_bm25_multi": ["calibration", "kitchen"], "find_bm25_accent": ["déplacé", "goûter"],
            "find_bm25_cjk": ["ロボット"], "find_zero": ["zzqqxx"], "find_postings": ["calibration", "kitchen"],
        }.items()
    },
    "find_short_like": f"{WITH} SELECT n.path, n.date FROM n JOIN c USING (path) WHERE {_like('庭')} ORDER BY n.date DESC, n.path LIMIT 50",
    "find_mixed_like": f"{WITH} SELECT n.path, n.date FROM n JOIN c USING (path) WHERE {_like('pipeline')} AND {_like('50')} ORDER BY n.date DESC, n.path LIMIT 50",
    "find_meta": f"{WITH}, {_bm25_sql(['pipeline'])} SELECT count(*) AS count, 'relevance' AS \"order\", count(*) >= 50 AS capped FROM bm",
    "doc_freq": f"{WITH}, {_GRAMS} SELECT gram, count(DISTINCT path) AS notes FROM grams GROUP BY gram",
    "corpus_stats": f"{WITH} SELECT count(*) AS n, CAST(sum(greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0)) AS BIGINT) AS total FROM c",
    "tag_substring": f"{WITH} " + _TAGS.format(f"{_ASCII} LIKE '%steer%'"),
    "tag_wildcard": f"{WITH} " + _TAGS.format(f"{_ASCII} LIKE '%s_eer%'"),
    "tag_literal": f"{WITH} " + _TAGS.format("contains(lower(tag), 'field_')"),
    "title_substring": f"{WITH} SELECT path, date FROM n WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%notes%'",
    "list_tags": f"{WITH} SELECT tag, count(*) AS count FROM t GROUP BY tag",
    "recent": f"{WITH} SELECT path, date FROM n WHERE date <> '' ORDER BY date DESC, path LIMIT 10",
    "hit_enrich": f"{WITH}, r AS (SELECT * FROM n WHERE date <> '' ORDER BY date DESC, path LIMIT 50) "
    "SELECT r.path, r.title, r.date, coalesce((SELECT string_agg(tag, ', ' ORDER BY tag) FROM t WHERE t.path = r.path), '') AS tags, r.summary FROM r",
    "links_resolved": f"{WITH} SELECT path, target, resolved FROM part JOIN pairs USING (part)",
    "links_unresolved": f"{WITH} SELECT path, target FROM part WHERE part NOT IN (SELECT part FROM pairs)",
    "links_ambiguous": f"{WITH} SELECT target, count(DISTINCT resolved) AS notes FROM part JOIN pairs USING (part) GROUP BY target HAVING count(DISTINCT resolved) > 1",
    "hub_backlinks": f"{WITH}, {_HUB_PATH} SELECT DISTINCT n.path, n.date FROM n JOIN part USING (path) JOIN pairs USING (part) JOIN hub ON resolved = hub",
    "backlink_counts": f"{WITH} SELECT resolved AS path, count(DISTINCT path) AS backlinks FROM part JOIN pairs USING (part) GROUP BY resolved",
    "links_of_busiest": f"{WITH}, b AS (SELECT path FROM l GROUP BY path ORDER BY count(*) DESC, path LIMIT 1) "
    "SELECT min(target) AS target, resolved FROM part JOIN pairs USING (part) WHERE path = (SELECT path FROM b) GROUP BY resolved",
    "resolve_argument": f"{WITH} SELECT path FROM stem WHERE stem = '{HUB}' OR ends_with(stem, '/{HUB}')",
    "wikilinks": rf"{WITH} SELECT DISTINCT path, unnest(regexp_extract_all(content, '\[\[([^\]|]+?)(?:\|[^\]]+?)?\]\]', 1)) AS target FROM c",
    "word_count": rf"{WITH} SELECT path, CAST(len(regexp_extract_all(content, '[\x{{3000}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{ff66}}-\x{{ff9f}}]')) + len(regexp_extract_all(content, '[a-zA-Z0-9]+')) AS BIGINT) AS word_count FROM c",
    "semantic_topk": f"{WITH}, {_NEAREST} SELECT path, round(score, 6) AS score FROM near ORDER BY near.score DESC, path LIMIT 10",
    "semantic_notes": f"{WITH}, {_NEAREST} SELECT path, round(score, 6) AS score FROM (SELECT * FROM near ORDER BY score DESC, path LIMIT 20) WHERE path IN (SELECT path FROM n)",
    "embeddings_topk": "SELECT a.vec_id, round(array_inner_product(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 "
    "ORDER BY array_inner_product(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]) DESC, a.vec_id LIMIT 10",
    "hybrid_rrf": f"{WITH}, {_bm25_sql(['pipeline'], 40)}, {_NEAREST}, {_RRF}",
    "hybrid_degraded": f"{WITH}, {_bm25_sql(['pipeline'], 40)} SELECT path, round(1.0 / (60 + row_number() OVER (ORDER BY round(bm.score, 9) DESC, path)), 12) AS score, 'bm25' AS via FROM bm ORDER BY score DESC LIMIT 10",
    "hybrid_via": f"{WITH}, {_bm25_sql(['pipeline'], 40)}, {_NEAREST}, {_RRF}".replace("SELECT path, round(coalesce", "SELECT via, count(*) AS n FROM (SELECT path, round(coalesce") + ") GROUP BY via",
    "embed_plan": f"""WITH {RUN_SQL}, now AS (SELECT path, arg_max(hash, {{'a': collected_at, 'h': hash}}) AS h FROM collected_notes WHERE path IS NOT NULL GROUP BY path),
old AS (SELECT path, max(hash) AS o FROM meta_notes SEMI JOIN run USING (run_id) WHERE path IS NOT NULL GROUP BY path)
SELECT path, CASE WHEN now.path IS NULL THEN 'drop' WHEN old.path IS NOT NULL AND h = o THEN 'keep' ELSE 'encode' END AS action FROM now FULL JOIN old USING (path)""",
    "health_no_tags": f"{WITH} SELECT path, title, word_count FROM n WHERE path NOT IN (SELECT path FROM t)",
    "health_no_summary": f"{WITH} SELECT path, title, word_count FROM n WHERE summary = ''",
    "health_low_words": f"{WITH} SELECT path, title, word_count FROM n WHERE word_count < 50",
    "health_no_updated": f"{WITH} SELECT path, title, word_count FROM n WHERE updated = ''",
    "health_total": f"{WITH}, k AS (SELECT * FROM n WHERE NOT starts_with(path, 'drafts/')) SELECT count(*) AS notes, CAST(sum((path NOT IN (SELECT path FROM t))::INT + (summary = '')::INT + (word_count < 50)::INT + (updated = '')::INT) AS BIGINT) AS issues FROM k",
    "path_digest": f"{WITH} SELECT sha256(string_agg(path, chr(10) ORDER BY path)) AS digest, count(*) AS notes FROM n",
    "parsed_content": f"""WITH {_PARSED}
SELECT doc_id, sha256(content) AS digest, CAST(len(regexp_extract_all(content, '[\\x{{3000}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{ff66}}-\\x{{ff9f}}]')) + len(regexp_extract_all(content, '[a-zA-Z0-9]+')) AS BIGINT) AS word_count
FROM read WHERE readable""",
    "parsed_fields": f"""WITH {_PARSED}, {_FIELDS}
SELECT doc_id, title, date, updated, summary, CAST(len(tl) AS BIGINT) AS tags, array_to_string(tl, '|') AS tag_list FROM fields WHERE readable""",
    "documents_parsed": f"""WITH {_PARSED}, {_FIELDS}
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN regexp_replace(regexp_extract(d.path, '[^/]*$'), '\\.md$', '') WHEN readable THEN title ELSE '' END AS title,
  CASE WHEN readable THEN array_to_string(tl, ', ') ELSE '' END AS tags, CASE WHEN readable THEN date ELSE '' END AS date, CASE WHEN readable THEN updated ELSE '' END AS updated,
  CASE WHEN readable THEN summary ELSE '' END AS summary, sha256(CASE WHEN readable THEN content ELSE '' END) AS content, coalesce(readable, true) AS readable,
  CASE WHEN {_UNCLOSED_SQL.replace('text', 'd.text')} THEN '閉じ---欠落' WHEN NOT readable THEN 'YAMLエラー' END AS issue
FROM documents d LEFT JOIN fields USING (doc_id)""",
    "index_counts": f"""WITH {_PARSED}, {_FIELDS},
kept AS (SELECT d.path, tl, content FROM documents d LEFT JOIN fields USING (doc_id) WHERE coalesce(readable, true)),
tagged AS (SELECT DISTINCT path, unnest(tl) AS tag FROM kept)
SELECT (SELECT count(*) FROM kept) AS notes, (SELECT count(*) FROM tagged) AS tags,
  (SELECT CAST(coalesce(sum(len(list_distinct(regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]', 1)))), 0) AS BIGINT) FROM kept) AS links,
  (SELECT count(*) FROM kept) AS corpus, (SELECT count(DISTINCT tag) FROM tagged) AS distinct_tags""",
    "documents_issues": f"""WITH {_PARSED}
SELECT coalesce(readable, true) AS readable, CASE WHEN {_UNCLOSED_SQL.replace('text', 'd.text')} THEN '閉じ---欠落' WHEN NOT readable THEN 'YAMLエラー' END AS issue, count(*) AS n
FROM documents d LEFT JOIN read USING (doc_id) GROUP BY ALL""",
    "parsed_issues": f"""WITH {_PARSED}
SELECT doc_id, CASE WHEN {_UNCLOSED_SQL} THEN '閉じ---欠落' WHEN NOT readable THEN 'YAMLエラー' END AS issue, readable FROM read WHERE NOT readable OR ({_UNCLOSED_SQL})""",
    "stale_files": """WITH m AS (SELECT max(TRY_CAST(trim(value) AS DOUBLE)) AS made FROM meta WHERE key = 'generated'),
r AS (SELECT path, max(collected_at) AS seen FROM collected_notes GROUP BY path)
SELECT CAST(sum((epoch_us(seen) / 1e6 > made)::INT) AS BIGINT) AS stale FROM r, m""",
    "embedding_texts": f"""{WITH} SELECT path, sha256('passage: ' || regexp_replace(n.title || chr(10) || n.summary || chr(10) || c.content,
  '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{b}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{b}}]+$', '', 'g')) AS digest
FROM n JOIN c USING (path)""",
}
