"""The index as Parquet tables: building, staleness, reading; and stored embeddings."""

from __future__ import annotations

import json
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.config import Config, ConfigError
from fathomark.functions import text as tx
from fathomark.functions.parse import parse_texts
from fathomark.operators.lexical import Found, by_relevance, corpus_stats, search_stored, write_postings
from fathomark.operators.lexical import find as find_texts
from fathomark.operators.vector import Encoder, plan_embedding, update_embeddings
from fathomark.session import materialise
from fathomark.sources import discover, safetensors
from fathomark.sources.store import Store

TABLES = ("notes", "tags", "links", "corpus")
#: Fixed value: the file in which other tools keep the matrix of vectors.
MATRIX = "embeddings.safetensors"


@dataclass
class Built:
    notes: int
    tags: int
    broken: list[tuple[str, str, str]]


def index_store(spark: SparkSession, cfg: Config) -> Store:
    return Store(spark, cfg.url(cfg.index_path))


def embedding_store(spark: SparkSession, cfg: Config) -> Store:
    return Store(spark, cfg.url(cfg.embeddings_dir))


def note_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The index tables of parsed files (``path`` and the fields of a note): one pass of the parser feeds them all."""
    good = parsed.where("readable")
    return {
        "notes": good.select("path", "title", "date", "updated", "summary", tx.word_count(F.col("content")).alias("word_count")),
        "tags": good.select("path", F.explode("tags").alias("tag")).distinct(),
        "links": good.select("path", F.explode(tx.wikilinks(F.col("content"))).alias("target")),
        "corpus": good.select("path", "title", "content"),
    }


def build(spark: SparkSession, cfg: Config, postings: bool = True) -> Built:
    """Rebuild the index: all tables anew, beside the old ones, then swapped in. With ``postings`` trigrams are stored too."""
    files = discover.note_files(cfg)
    now = time.time_ns()
    place = index_store(spark, cfg)
    fresh = place.beside("new")
    parsed = materialise(parse_texts(discover.read_files(spark, files).where(F.col("text").isNotNull())), "parsed")
    for name, df in note_tables(parsed).items():
        df.write.parquet(f"{fresh.url}/{name}")
    corpus = fresh.table("corpus")
    stats = corpus_stats(corpus).first()
    if postings:
        write_postings(corpus, f"{fresh.url}/grams")
    broken = [(r.path, r.issue, r.detail) for r in parsed.where(F.col("issue").isNotNull()).orderBy("ord").select("path", "issue", "detail").toLocalIterator()]  # shown to the user
    meta = {"generated": f"{now // 10**9}.{now % 10**9:09d}", "scanned_paths_sha256": discover.paths_digest([f.rel for f in files]), "notes": stats.n, "total": stats.total or 0}
    fresh.write("meta.json", json.dumps(meta))
    tags = fresh.table("tags").agg(F.count_distinct("tag")).first()[0]
    place.replace_by(fresh)
    return Built(stats.n, tags, broken)


def read_meta(spark: SparkSession, cfg: Config) -> dict:
    try:
        return json.loads(index_store(spark, cfg).read("meta.json") or "{}")
    except ValueError:
        return {}


def stale(spark: SparkSession, cfg: Config) -> bool:
    """Whether a source is newer than the index, the set of files differs, or the index cannot say."""
    meta = read_meta(spark, cfg)
    try:
        made, digest = float(meta["generated"]), meta["scanned_paths_sha256"]
    except (KeyError, ValueError, TypeError):
        return True
    files = discover.note_files(cfg)
    return digest != discover.paths_digest([f.rel for f in files]) or any(discover.modified_at(f.path) > made for f in files)


def newer_files(spark: SparkSession, cfg: Config, skip: tuple[str, ...] = ()) -> int | None:
    """How many files are newer than the index; None if it has no time."""
    try:
        made = float(read_meta(spark, cfg)["generated"])
    except (KeyError, ValueError, TypeError):
        return None
    return sum(discover.modified_at(f.path) > made for f in discover.note_files(cfg) if not f.rel.startswith(skip or ("\0",)))


def ensure(spark: SparkSession, cfg: Config, rebuild: bool = True) -> None:
    """Build a missing index; with ``rebuild`` and the setting for it also a stale one. Says so on stderr only."""
    place = index_store(spark, cfg)
    if not place.exists("meta.json") and not all(place.exists(t) for t in TABLES):
        print("no index yet: building one", file=sys.stderr)
        build(spark, cfg)
    elif rebuild and cfg.auto_rebuild and stale(spark, cfg):
        print("files have changed: building the index anew", file=sys.stderr)
        build(spark, cfg)


def load(spark: SparkSession, cfg: Config, name: str) -> DataFrame:
    return index_store(spark, cfg).table(name)


def find(spark: SparkSession, cfg: Config, query: str, limit: int) -> Found:
    """A full-text search of the index: through its postings, which reads only the terms' trigrams, if the terms have
    trigrams and the index has postings, else over the texts."""
    terms = tx.split_terms(query)
    grams = f"{index_store(spark, cfg).url}/grams"
    if by_relevance(terms) and index_store(spark, cfg).exists("grams/lengths/_SUCCESS"):
        return Found(search_stored(spark, grams, terms, limit), "relevance", limit)
    return find_texts(load(spark, cfg, "corpus"), load(spark, cfg, "notes"), query, limit)


# --- embeddings ---


def embeddings_meta(spark: SparkSession, cfg: Config) -> dict | None:
    try:
        text = embedding_store(spark, cfg).read("metadata.json")
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def stored_embeddings(spark: SparkSession, cfg: Config) -> DataFrame | None:
    """The stored vectors, unless they are missing or their number is not what the metadata says.

    Vectors that another tool stored, as a safetensors file beside the metadata with the notes in its order, are read as well.
    """
    meta, place = embeddings_meta(spark, cfg), embedding_store(spark, cfg)
    if meta is None:
        return None
    if place.exists("vectors"):
        df = place.table("vectors")
    elif place.exists(MATRIX) and isinstance(meta.get("notes"), list):
        notes = [(i, n.get("path"), n.get("title"), n.get("hash")) for i, n in enumerate(meta["notes"])]
        try:
            rows = safetensors.read_matrix(spark, f"{place.url}/{MATRIX}", "vectors")
        except safetensors.FormatError:
            return None
        df = spark.createDataFrame(notes, "row long, path string, title string, hash string").join(rows, "row").select("path", "title", "hash", "embedding")
        return df if rows.count() == len(notes) == meta.get("note_count", len(notes)) else None
    else:
        return None
    return df if df.count() == meta.get("note_count") else None


def export_matrix(spark: SparkSession, cfg: Config) -> None:
    """Write the stored vectors as a safetensors file beside them, and the notes in its order into the metadata."""
    meta, stored = embeddings_meta(spark, cfg), stored_embeddings(spark, cfg)
    if meta is None or stored is None:
        raise ConfigError("no stored embeddings")
    place = embedding_store(spark, cfg)
    notes = safetensors.write_matrix(stored.orderBy("path"), f"{place.url}/{MATRIX}", "vectors", ["path", "title", "hash"])
    place.write("metadata.json", json.dumps(meta | {"notes": notes}, ensure_ascii=False))


def embed(spark: SparkSession, cfg: Config, encoder: Encoder, force: bool = False) -> dict[str, int]:
    """Bring the stored vectors up to date: only new and changed notes are encoded, removed ones go.

    Everything is encoded anew when forced, when the encoder or the passage prefix changed, or when what is stored
    is broken. Without notes the stored files are removed. Gives counts by action; nothing to do writes nothing.
    """
    files = discover.note_files(cfg)
    parsed = parse_texts(discover.read_files(spark, files).where(F.col("text").isNotNull())).where("readable")
    current = materialise(parsed.select("path", "title", "hash", tx.embedding_text(F.col("title"), F.col("summary"), F.col("content")).alias("text")), "current")
    place = embedding_store(spark, cfg)
    many = current.count()
    if not many:
        place.delete()
        return {}
    meta = embeddings_meta(spark, cfg)
    old = stored_embeddings(spark, cfg)
    same = meta is not None and meta.get("model") == encoder.name and meta.get("passage_prefix") == cfg.passage_prefix
    rebuild = force or old is None or not same
    none = spark.createDataFrame([], "path string, hash string")
    counts = {r.action: r["count"] for r in plan_embedding(current, none if rebuild else old).groupBy("action").count().collect()}  # three rows at most
    if set(counts) == {"keep"}:
        return counts
    fresh = place.beside("new")
    update_embeddings(current, None if rebuild else old, encoder, cfg.passage_prefix, rebuild).write.parquet(f"{fresh.url}/vectors")
    made = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    data = {"generated": made, "model": encoder.name, "query_prefix": cfg.query_prefix, "passage_prefix": cfg.passage_prefix, "note_count": many}
    fresh.write("metadata.json", json.dumps(data, ensure_ascii=False))
    place.replace_by(fresh)
    return counts
