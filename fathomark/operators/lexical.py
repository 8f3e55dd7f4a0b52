"""Full-text search: exact trigram BM25, and substring search in date order for short terms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fathomark.functions.text import fold, fold_term, like_any, occurrences, split_terms
from fathomark.session import materialise

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms shorter than this have no trigram.
GRAM = 3


@dataclass(frozen=True)
class Found:
    """Ranked paths (``path, rank`` and what ranks them) and how they came about."""

    hits: DataFrame
    order: str
    limit: int

    def capped(self, count: int) -> bool:
        return self.limit >= 0 and count >= self.limit


def length_in_grams(corpus: DataFrame) -> Column:
    """A note's length in trigrams, title and content."""
    grams = lambda c: F.greatest(F.length(F.coalesce(F.col(c), F.lit(""))) - 2, F.lit(0)).cast("long")
    return grams("title") + grams("content")


def length_stats(lengths: DataFrame) -> DataFrame:
    """One row ``n, total`` from the notes' lengths (``len``): how many there are, and their length together; may be stored
    with an index."""
    return lengths.agg(F.count("*").alias("n"), F.sum("len").alias("total"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """:func:`length_stats` of a corpus."""
    return length_stats(corpus.select(length_in_grams(corpus).alias("len")))


def frequencies(corpus: DataFrame, terms: Sequence[str]) -> dict[str, Column]:
    """``len, f0, f1, ...``: a note's length and how often each term occurs in it, as expressions."""
    title, content = (fold(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "content"))
    counts = {f"f{i}": occurrences(title, fold_term(t)) + occurrences(content, fold_term(t)) for i, t in enumerate(terms)}
    return {"len": length_in_grams(corpus), **counts}


def term_frequencies(corpus: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``path, len, f0, f1, ...``: in one pass, what :func:`frequencies` says of each note."""
    return corpus.select("path", *[c.alias(n) for n, c in frequencies(corpus, terms).items()])


def bm25_score(n: float, total: float, found: Sequence[int], length: Column) -> Column:
    """The score of a note from the corpus's figures and the note's term counts ``f0, f1, ...``."""
    average = total / n if n and total else 1.0
    score = F.lit(0.0)
    for i, count in enumerate(found):
        idf = math.log((n - count + 0.5) / (count + 0.5)) if n else 0.0
        idf = idf if idf > 0 else LEAST_IDF
        f = F.col(f"f{i}").cast("double")
        score = score + F.lit(idf) * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(average)))
    return score


def _top(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    ranked = df.orderBy(*order)
    return ranked if limit < 0 else ranked.limit(limit)


def all_found(terms: Sequence[str]) -> Column:
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & (F.col(f"f{i}") > 0)
    return every


def best_scores(counted: DataFrame, terms: Sequence[str], limit: int = 50) -> DataFrame:
    """``path, score`` of the ``limit`` best notes from their counts (:func:`term_frequencies`), best first, equals by path.

    The texts are read once: while the notes that hold every term are written aside, the same pass observes the sums
    over all notes on which their scores depend. A negative limit means all.
    """
    seen = Observation()
    sums = [F.count("*").alias("n"), F.sum("len").alias("total"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]]
    held = materialise(counted.observe(seen, *sums).where(all_found(terms)), "found")
    got = seen.get
    score = bm25_score(float(got.get("n") or 0), float(got.get("total") or 0), [int(got.get(f"d{i}") or 0) for i in range(len(terms))], F.col("len"))
    return _top(held.select("path", score.alias("score")), [F.desc("score"), F.asc("path")], limit)


def search_bm25(corpus: DataFrame, terms: Sequence[str], limit: int = 50) -> DataFrame:
    """``path, score`` of the ``limit`` best notes that hold every term, best first, equals by path.

    One pass over title and content, map-side but for one row of sums and the top rows. A negative limit means all.
    Null texts are empty; every row of ``corpus`` is a note.
    """
    return best_scores(term_frequencies(corpus, terms), terms, limit)


def holds_all(terms: Sequence[str], mode: str = "compat") -> Column:
    """Whether every term occurs in title or content."""
    every = F.lit(True)
    for t in terms:
        every = every & (like_any(F.coalesce(F.col("content"), F.lit("")), t, mode) | like_any(F.coalesce(F.col("title"), F.lit("")), t, mode))
    return every


def by_latest(notes: DataFrame, held: DataFrame, limit: int = 50) -> DataFrame:
    """``path, date`` of the notes named in ``held``, latest date first, equals by path."""
    return _top(notes.join(held.select("path"), "path", "left_semi").select("path", F.coalesce("date", F.lit("")).alias("date")), [F.desc("date"), F.asc("path")], limit)


def search_substring(corpus: DataFrame, notes: DataFrame, terms: Sequence[str], limit: int = 50, mode: str = "compat") -> DataFrame:
    """``path, date`` of notes in which every term occurs in title or content, latest date first, equals by path."""
    return by_latest(notes, corpus.where(holds_all(terms, mode)), limit)


def by_relevance(terms: Sequence[str]) -> bool:
    """Whether notes can be ranked by relevance: every term has a trigram."""
    return all(len(t) >= GRAM for t in terms)


def find(corpus: DataFrame, notes: DataFrame, query: str, limit: int = 50, mode: str = "compat") -> Found:
    """Full-text search: by relevance if every term has at least three characters, else by date."""
    terms = split_terms(query)
    if by_relevance(terms):
        return Found(search_bm25(corpus, terms, limit), "relevance", limit)
    return Found(search_substring(corpus, notes, terms, limit, mode), "date", limit)


def postings(corpus: DataFrame) -> DataFrame:
    """``gram, path, field, pos``: the positions (from 1) of every trigram in title and content. One row a character: worth
    building only for many queries on a large corpus, by :func:`write_postings`."""
    parts = []
    for field in ("title", "content"):
        text = fold(F.coalesce(F.col(field), F.lit("")))
        grams = _grams(text)
        parts.append(corpus.where(F.length(text) >= GRAM).select("path", F.lit(field).alias("field"), F.posexplode(grams).alias("p", "gram")))
    return parts[0].unionByName(parts[1]).select("gram", "path", "field", (F.col("p") + 1).alias("pos"))


#: Postings are dealt by a hash of the trigram over folders of about so many characters, at least so many folders; and the
#: tasks that write one of them.
BUCKET_CHARS, LEAST_BUCKETS, WRITERS = 200_000_000, 8, 4


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_postings(corpus: DataFrame, place: str, buckets: int | None = None) -> None:
    """Store the postings of a corpus, in folders by bucket (None: as many as its length asks for) and sorted by trigram, and
    the notes' lengths beside them.

    A trigram's rows lie in one folder, in stretches of few row groups; a frequent trigram is shared by several tasks.
    """
    buckets = buckets or max(LEAST_BUCKETS, int(corpus_stats(corpus).first().total or 0) // BUCKET_CHARS)
    rows = postings(corpus).withColumn("bucket", _bucket(F.col("gram"), buckets))
    dealt = rows.repartition(buckets * WRITERS, "bucket", F.pmod(F.xxhash64("path"), F.lit(WRITERS))).sortWithinPartitions("bucket", "gram", "path", "field", "pos")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{place}/postings")
    corpus.select("path", length_in_grams(corpus).alias("len"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{place}/lengths")


def stored_postings(spark: SparkSession, place: str, terms: Sequence[str]) -> DataFrame:
    """The stored postings of the terms' trigrams: only their folders are listed, only their row groups read."""
    buckets = spark.read.parquet(f"{place}/lengths").select("buckets").limit(1).first()
    grams = sorted({t[i : i + GRAM] for t in map(fold_term, terms) for i in range(len(t) - GRAM + 1)})
    if buckets is None:
        return spark.createDataFrame([], "gram string, path string, field string, pos int, bucket int")
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets[0]).alias("b")).distinct()
    numbers = sorted(r.b for r in wanted.collect())  # at most the trigrams of the terms
    return spark.read.schema("gram string, path string, field string, pos int, bucket int").parquet(f"{place}/postings").where(F.col("bucket").isin(numbers) & F.col("gram").isin(grams))


def search_stored(spark: SparkSession, place: str, terms: Sequence[str], limit: int = 50) -> DataFrame:
    """:func:`search_bm25` from what :func:`write_postings` stored; no text is read."""
    return search_postings(stored_postings(spark, place, terms), spark.read.parquet(f"{place}/lengths"), terms, limit)


def _grams(text: Column) -> Column:
    """All trigrams in order, in time linear in the text: its characters zipped with themselves one and two places on."""
    signs = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    count = F.greatest(F.length(text) - (GRAM - 1), F.lit(0))
    first = F.slice(signs, F.lit(1), count)
    join = lambda a, b: F.concat(a, b)
    return F.zip_with(F.zip_with(first, F.slice(signs, F.lit(2), count), join), F.slice(signs, F.lit(3), count), join)


def document_frequency(corpus: DataFrame) -> DataFrame:
    """``gram, notes``: in how many notes each trigram occurs. A note's trigrams are made distinct before they become rows."""
    title, content = (fold(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "content"))
    return corpus.select(F.explode(F.array_distinct(F.concat(_grams(title), _grams(content)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("notes"))


def postings_frequencies(index: DataFrame, term: str) -> DataFrame:
    """``path, f``: how often a term of three or more characters occurs in each note, by position adjacency.

    The i-th trigram of an occurrence stands i places after the first; shifting each posting back by its trigram's
    place makes an occurrence a group with all trigrams.
    """
    folded = fold_term(term)
    grams = [folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)]
    spark = index.sparkSession
    places = spark.createDataFrame([(g, i) for i, g in enumerate(grams)], "gram string, place int")
    starts = index.join(F.broadcast(places), "gram").select("path", "field", (F.col("pos") - F.col("place")).alias("start"), "place")
    whole = starts.groupBy("path", "field", "start").agg(F.count("*").alias("c")).where(F.col("c") == len(grams))
    return whole.groupBy("path").agg(F.count("*").alias("f"))


def search_postings(index: DataFrame, lengths: DataFrame, terms: Sequence[str], limit: int = 50) -> DataFrame:
    """:func:`search_bm25` from an index: ``lengths`` has ``path, len`` of every note."""
    sums = lengths.agg(F.count("*").alias("n"), F.sum("len").alias("total")).first()
    joined, found = None, []
    for i, t in enumerate(terms):
        each = materialise(postings_frequencies(index, t).withColumnRenamed("f", f"f{i}"), "term")
        found.append(each.count())
        joined = each if joined is None else joined.join(each, "path")
    joined = joined.join(lengths.select("path", "len"), "path")
    score = bm25_score(float(sums["n"]), float(sums["total"] or 0), found, F.col("len"))
    return _top(joined.select("path", score.alias("score")), [F.desc("score"), F.asc("path")], limit)
