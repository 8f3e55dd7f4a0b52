"""Reading level of documents: difficulty spreads from graded documents over words to all documents.

The graph joins documents to the words of their sentences. Graded documents are clamped to their grade. A word's
difficulty is the mean of its documents', a document's level the weighted mean of its words' (the sharper a word's, the
more it counts); both steps repeat until levels settle. Bands are read off afterwards: from how the difficulties of a
document's sentences are distributed, as the graded documents of each band have them. Words are hashed into a fixed
number of buckets, so what the driver and every worker hold of the graph, one number pair a bucket, has a size that
does not grow with the corpus; documents stay distributed.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.chars import BASES, LETTER, SPACE, classes, join, lower, run_hashes
from fathomark.llm.markup import mask
from fathomark.session import materialise, spread

#: Hash buckets for words; a documented bound on what is broadcast (8 bytes each) and collected (28 bytes each).
BUCKETS = 1 << 20
#: What all ungraded documents together weigh against all graded ones as words take their means. At equal weight the
#: levels of so dense a graph run together.
UNGRADED = 0.2
#: Labels up to this number are broadcast to the documents; more are joined by shuffle.
LABELS_BROADCAST = 500_000
#: Sentence difficulties are told apart in this many steps.
STEPS = 16
BANDS = (1, 2, 3, 4)
LEAST_CHARS = 300
#: The band of texts without anything to judge by, where there are no labels to take the mean of.
FALLBACK = 2

_FRONT = re.compile(r"\A\s*-{3,}[ \t]*\n.*?\n-{3,}[ \t]*(?:\n|\Z)", re.S)
_LINKS = re.compile(r"\[\[[^\]\n]*\]\]|</?[A-Za-z][^<>]*>|\\[A-Za-z]+|https?://\S+|[\x01-\x03]")


def prose(text: str) -> str:
    """A document without frontmatter, code, formulas, comments, tags, commands and link targets."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if text.lstrip()[:3] == "---":
        text = _FRONT.sub("", text, count=1)
    return _LINKS.sub(" ", mask(text)[0])


_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    """The top bits of a mixed hash, as many as :data:`BUCKETS` has."""
    h = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def sentence_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all sentences end to end, each sentence's number of words, and each text's number of sentences.

    Words are runs of letters in lower case; runs of kana and ideographs count as their overlapping pairs. A word
    counts once a sentence; sentences of fewer than two words are none.
    """
    whole, points, ends = join(texts)
    many = len(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(many, np.int64)
    low = lower()[points]
    kind = classes()[points]
    letter = kind == LETTER
    script = letter & (((points >= 0x3040) & (points < 0x3100)) | ((points >= 0x3400) & (points < 0xA000)) | ((points >= 0xF900) & (points < 0xFB00)))
    head = np.zeros(len(points) + 1, bool)
    head[ends[:-1]] = True
    head = head[:-1]
    plain = letter & ~script
    before = np.concatenate(([False], plain[:-1])) & ~head
    after = np.append(plain[1:] & ~head[1:], False)
    start, stop = np.flatnonzero(plain & ~before), np.flatnonzero(plain & ~after) + 1
    pair = np.flatnonzero(script[:-1] & script[1:] & ~head[1:])
    mixed = low[pair].astype(np.uint64) * np.uint64(BASES[0]) + low[pair + 1].astype(np.uint64) * np.uint64(BASES[1])
    bucket = np.concatenate((_bucket(run_hashes(low, start, stop, BASES[0])), _bucket(mixed)))
    place = np.concatenate((start, pair))
    stop_sign = np.isin(points, np.array([0x3002, 0xFF01, 0xFF1F, 10], np.uint32))
    point = np.isin(points, np.array([33, 46, 63], np.uint32))
    point[:-1] &= kind[1:] == SPACE
    breaks = np.concatenate(([False], (stop_sign | point)[:-1])) | head
    sentence = np.cumsum(breaks) - 1
    text_of = np.searchsorted(ends, np.flatnonzero(breaks), side="right") - 1
    both = np.unique(sentence[place] * BUCKETS + bucket)
    own, words = both // BUCKETS, both % BUCKETS
    sizes = np.bincount(own, minlength=len(text_of))
    keep = sizes >= 2
    words = words[keep[own]]
    texts_kept = text_of[keep]
    return words, sizes[keep], np.bincount(texts_kept, minlength=many)


#: Longer texts are read in runs of lines of about this many characters.
GIANT = 2_000_000


def sentences_of(texts: list[str], giant: int = GIANT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`sentence_words`, with texts of more than ``giant`` characters read in runs of whole lines, where
    sentences end anyway: the result is the same."""
    if not any(len(t) > giant for t in texts):
        return sentence_words(texts)
    runs, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > giant and (end := t.find("\n", at + giant // 2) + 1):
            runs.append(t[at:end])
            owner.append(i)
            at = end
        runs.append(t[at:])
        owner.append(i)
    words, sizes, sentences = (np.concatenate(x) for x in zip(*(sentence_words([r]) for r in runs), strict=True))
    return words, sizes, np.bincount(owner, sentences, len(texts)).astype(np.int64)


_PREPARED = "doc_id long, chars int, words array<int>, sizes array<int>"


def prepared(documents: DataFrame) -> DataFrame:
    """Each document with a text as its sentences' words; null texts and ids have no row. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column(0), b.column(1)
            begin = 0
            while begin < b.num_rows:
                texts, size, end = [], 0, begin
                while end < b.num_rows and (end == begin or size < 2_000_000):
                    texts.append(column[end].as_py())
                    size += len(texts[-1])
                    end += 1
                words, sizes, sentences = sentences_of([prose(t) for t in texts])
                at = np.concatenate(([0], np.cumsum(sentences)))
                word_at = np.concatenate(([0], np.cumsum(sizes)))[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin), pa.array([len(t) for t in texts], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(word_at, pa.int32()), pa.array(words, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sizes, pa.int32())),
                    ],
                    names=["doc_id", "chars", "words", "sizes"],
                )
                begin = end

    source = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return spread(source.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _PREPARED)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and each list's length."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), np.diff(offsets)


class _Words:
    """What is known of the words: difficulty and weight a bucket. Sent to the workers, only the known ones."""

    def __init__(self, mean: np.ndarray, weight: np.ndarray):
        self.mean, self.weight = mean.astype(np.float32), weight.astype(np.float32)

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.weight).astype(np.int32)
        return len(self.mean), at, self.mean[at], self.weight[at]

    def __setstate__(self, state: tuple) -> None:
        many, at, mean, weight = state
        self.mean, self.weight = np.zeros(many, np.float32), np.zeros(many, np.float32)
        self.mean[at], self.weight[at] = mean, weight

    def moved(self, last: _Words) -> float:
        """By how much the words known then and now have moved, by weight."""
        both = (last.weight > 0) & (self.weight > 0)
        total = float(self.weight[both].sum(dtype=float))
        return float((self.weight * np.abs(self.mean - last.mean))[both].sum(dtype=float)) / total if total else 0.0

    @staticmethod
    def of(rows: pa.Table) -> _Words:
        """The sharper a word's difficulty and the more documents tell of it, the more it weighs; of few documents it
        is taken to spread by a band."""
        den, num, sq = (np.zeros(BUCKETS) for _ in range(3))
        at = rows["bucket"].to_numpy()
        for into, name in ((den, "den"), (num, "num"), (sq, "sq")):
            into[at] = rows[name].to_numpy()
        held = np.maximum(den, 1e-9)
        mean = num / held
        spread = (np.maximum(sq / held - mean**2, 0) * den + 1) / (den + 1)
        return _Words(mean, den / (den + 1) / (spread + 0.15))

    def levels(self, words: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level of each document, the weighted mean of its words, and whether any of them is known."""
        of = np.repeat(np.arange(len(each)), each)
        weight = self.weight[words].astype(float)
        total = np.bincount(of, weight, len(each))
        return np.bincount(of, weight * self.mean[words], len(each)) / np.maximum(total, 1e-30), total > 0

    def steps(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The difficulty step of each sentence, -1 where none of its words is known."""
        if not len(sizes):
            return np.zeros(0, np.int64)
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        weight = self.weight[words].astype(float)
        total = np.add.reduceat(weight, at)
        level = np.add.reduceat(weight * self.mean[words], at) / np.maximum(total, 1e-30)
        low, high = BANDS[0], BANDS[-1]
        step = np.clip(((level - low) / (high - low) * STEPS).astype(np.int64), 0, STEPS - 1)
        return np.where(total > 0, step, -1)


def _bands(b: pa.RecordBatch, words: _Words, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's likeliest band by its sentences, and whether it has a sentence to judge by."""
    flat, _ = _lists(b.column("words"))
    sizes, sentences = _lists(b.column("sizes"))
    step = words.steps(flat, sizes)
    text = np.repeat(np.arange(b.num_rows), sentences)
    good = step >= 0
    text, step = text[good], step[good]
    logs = np.stack([np.bincount(text, chance[k, step], b.num_rows) for k in range(len(BANDS))], axis=1)
    return logs.argmax(1) + BANDS[0], np.bincount(text, minlength=b.num_rows) > 0


def _spread(docs: DataFrame, words: _Words | None, trust: float) -> _Words:
    """What documents make of their words: first the graded ones alone, then all with their level by ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        sums = np.zeros((3, BUCKETS))
        for b in batches:
            if not b.num_rows:
                continue
            grade = b.column("grade").to_numpy(zero_copy_only=False).astype(float)
            graded = ~np.isnan(grade)
            flat, each = _lists(b.column("words"))
            level, weight = np.where(graded, grade, 0), graded.astype(float)
            if words is not None:
                own, known = words.levels(flat, each)
                level, weight = np.where(graded, grade, own), np.where(graded, 1.0, trust * known)
            w, f = np.repeat(weight, each), np.repeat(level, each)
            for k, part in enumerate((w, w * f, w * f * f)):
                sums[k] += np.bincount(flat, part, BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(s[at]) for s in sums)], names=["bucket", "den", "num", "sq"])

    parts = docs.select("grade", "words").mapInArrow(run, "bucket int, den double, num double, sq double")
    rows = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("den", "num", "sq")]).toArrow()  # at most BUCKETS rows
    shared.destroy()
    return _Words.of(rows)


def _chances(graded: DataFrame, words: _Words) -> np.ndarray:
    """Log probability of each difficulty step by band, counted over the graded documents' sentences."""
    shared = graded.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(BANDS), STEPS), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            flat, _ = _lists(b.column("words"))
            sizes, sentences = _lists(b.column("sizes"))
            step = shared.value.steps(flat, sizes)
            text = np.repeat(np.arange(b.num_rows), sentences)
            band = _whole(b.column("grade").to_numpy().astype(float)) - BANDS[0]
            good = step >= 0
            np.add.at(counts, (band[text[good]], step[good]), 1)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, k], pa.int32()) for k in range(2)), pa.array(counts[tuple(at.T)])], names=["b", "s", "n"])

    rows = graded.select("grade", "words", "sizes").mapInArrow(run, "b int, s int, n long")
    counts = np.zeros((len(BANDS), STEPS))
    for r in rows.groupBy("b", "s").agg(F.sum("n").alias("n")).collect():  # at most bands x steps
        counts[r.b, r.s] = r.n
    counts = counts + counts * 20 / np.maximum(counts.sum(1, keepdims=True), 1)
    side = np.pad(counts, ((0, 0), (1, 1)))
    smooth = counts + 0.5 * (side[:, :-2] + side[:, 2:]) + 0.05
    return np.log(smooth / smooth.sum(1, keepdims=True))


def _whole(grade: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(grade), BANDS[0], BANDS[-1]).astype(np.int64)


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: the mean of a document's distinct labels from 1 to 4; null labels are none."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("band").between(BANDS[0], BANDS[-1])).select("doc_id", "reader", "band").distinct()
    return good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("band").alias("grade"))


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = 100, ungraded: float = UNGRADED, settled: float = 0.001) -> DataFrame:
    """``doc_id, chars, level, band, judged``: continuous level and band 1 to 4 of each document that has a text, and the band
    by its text alone.

    The harmonic iterations end when no further word becomes known and words' difficulties move by less than ``settled``
    on average, by weight; ``rounds`` is a safety bound, and a warning says so if it ends them. Graded documents
    keep their grade as level and, rounded, as band; ``judged`` is what their text says, as labels err. Ungraded
    documents pass on their level, all together with ``ungraded`` times the weight of all graded ones. A text without
    known words (empty, blank, only code) has nulls for level and bands, unless it is graded. Without any label all are
    null. A repeated document id is judged per row. Whole texts count; lang and n_chars, which may be wrong, are not read.
    """
    spark = documents.sparkSession
    grade = materialise(grades(labels), "grades")
    few = grade.count() <= LABELS_BROADCAST
    docs = materialise(prepared(documents).join(F.broadcast(grade) if few else grade, "doc_id", "left"), "sentences")
    graded = materialise(docs.where(F.col("grade").isNotNull()), "graded")
    given = graded.count()
    trust = ungraded * given / max(docs.count() - given, 1)
    words = _spread(graded, None, trust)
    for _ in range(rounds):
        if not given:
            break
        new = _spread(docs, words, trust)
        done = new.moved(words) < settled and not ((words.weight == 0) & (new.weight > 0)).any()
        words = new
        if done:
            break
    else:
        warnings.warn(f"reading levels have not settled in {rounds} rounds", stacklevel=2)
    shared = spark.sparkContext.broadcast((words, _chances(graded, words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chance = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            judged, known = _bands(b, words, chance)
            level, heard = words.levels(*_lists(b.column("words")))
            given = b.column("grade").to_numpy(zero_copy_only=False).astype(float)
            own = ~np.isnan(given)
            band = np.where(own, _whole(np.where(own, given, BANDS[0])), judged)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("chars"), pa.array(np.where(own, given, level), mask=~(own | heard)), pa.array(band, pa.int64(), mask=~(own | known)), pa.array(judged, pa.int64(), mask=~known)],
                names=["doc_id", "chars", "level", "band", "judged"],
            )

    return docs.select("doc_id", "chars", "words", "sizes", "grade").mapInArrow(run, "doc_id long, chars int, level double, band long, judged long")


def bands(documents: DataFrame, labels: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, band`` of the documents whose text has at least ``least`` characters, as a careful reader gives it: by the
    text, also where a label, which may err, says otherwise.

    One that nothing tells of (only code, or no word that labels reach) has the rounded mean of all grades.
    """
    mean = grades(labels).agg(F.avg("grade")).first()[0]
    fallback = FALLBACK if mean is None else int(_whole(np.array([mean]))[0])
    long = reading_levels(documents, labels).where(F.col("chars") >= least)
    return long.select("doc_id", F.coalesce("judged", F.lit(fallback).cast("long")).alias("band")).distinct()
