"""Cutting oversized texts at natural boundaries, byte range by byte range, with overlap.

A text, in a table's cell or in a file, is read in byte ranges with halos. A worker sees one range: it finds the
boundaries in it and where the pieces begin and end. Ranges do not wait for each other, because two neighbours find the
same cut where they meet. The boundary tables, a row a range, are stitched by prefix sums of the ranges' lengths and
pieces; then pieces are emitted by offset. No worker ever holds a whole giant text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.operators.ordering import running_before
from fathomark.session import materialise, spread
from fathomark.sources.store import arrow_uri

LIMIT, OVERLAP_LOW, OVERLAP_HIGH = 2000, 100, 200
#: Bytes of a text that one range covers; a worker sees a range and a halo on either side.
RANGE = 65_536

NONE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_MARKS = {c: n for n, cs in {1: " \t 　", 2: "\n\r\u0085  ", 3: ".!?", 4: "。！？．"}.items() for c in cs}


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: what it can end, and whether it hangs on the sign before it."""
    kind = np.zeros(0x110000, np.uint8)
    for c, n in _MARKS.items():
        kind[ord(c)] = n
    hangs = np.fromiter((unicodedata.category(chr(i))[0] == "M" or i == 0x200D for i in range(0x110000)), bool, 0x110000)
    return kind, hangs


def boundaries(points: np.ndarray) -> np.ndarray:
    """The strength of the cut before each character (and at the end): paragraph, line, sentence, word or none; 255 where none may be."""
    kind, hangs = _kinds()
    k = kind[points]
    size = len(points)
    out = np.zeros(size + 1, np.uint8)
    if not size:
        return out
    blank, line = k == 1, k == 2
    space = blank | line
    fresh = ~np.append(space[1:], True)  # the next sign begins something
    out[1:][blank & fresh] = WORD
    ended = np.zeros(size, bool)
    ended[1:] = (k[:-1] == 3) & space[1:]
    out[1:][((k == 4) | ended) & ~np.append(k[1:] == 4, False)] = SENTENCE
    out[1:][line] = LINE
    gap = np.zeros(size, bool)
    gap[1:] = line[1:] & line[:-1] & ~((points[1:] == 10) & (points[:-1] == 13))
    crlf = np.zeros(size, bool)
    crlf[3:] = (points[3:] == 10) & (points[2:-1] == 13) & (points[1:-2] == 10)
    out[1:][(gap | crlf) & ~np.append(line[1:], False)] = PARAGRAPH
    out[:-1][hangs[points]] = 255
    inside = np.flatnonzero((points[1:] == 10) & (points[:-1] == 13)) + 1
    out[inside] = 255
    return out


def _best(strength: np.ndarray, low: int, high: int) -> int:
    """The last of the strongest cuts in ``low..high``; without any, the last place where a character may be parted."""
    low, high = max(low, 0), min(high, len(strength) - 1)
    window = strength[low : high + 1]
    allowed = np.where(window == 255, 0, window)
    top = allowed.max(initial=0)
    if top == NONE:
        free = np.flatnonzero(window != 255)
        return low + int(free[-1]) if len(free) else high
    return low + int(np.flatnonzero(allowed == top)[-1])


def halo(limit: int = LIMIT, high: int = OVERLAP_HIGH) -> int:
    """Bytes beyond a range's ends that decide on its pieces; a character has four at most."""
    return 4 * (limit // 2 + high + 8)


@dataclass
class Cut:
    """A range's part of the boundary table: its own characters, and of each piece that it emits the first character and
    the end, counted from its first own character (so the first may be negative), and the same in bytes of the window."""

    chars: int
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def cut_range(window: bytes, base: int, number: int, total: int, limit: int = LIMIT, overlap: tuple[int, int] = (OVERLAP_LOW, OVERLAP_HIGH), width: int = RANGE) -> Cut:
    """The pieces that range ``number`` of a UTF-8 text of ``total`` bytes emits.

    ``window`` are the bytes from ``base`` on: the range and its halos. Where two ranges meet, both find the same cut,
    for both look at the same characters before the meeting point. Malformed bytes count as one sign each sequence.
    """
    raw = np.frombuffer(window, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not base and len(raw) and (not len(starts) or starts[0]):
        starts = np.concatenate(([0], starts))
    if base + len(raw) < total:  # the last character may be cut off
        starts, stop = starts[:-1], int(starts[-1]) if len(starts) else len(raw)
    else:
        stop = len(raw)
    at = np.append(starts, stop)
    text = window[int(at[0]) : stop].decode("utf-8", errors="replace")
    if len(text) != len(starts):  # malformed
        text = "".join(window[i:j].decode("utf-8", errors="replace")[:1] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    points = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)
    strength = boundaries(points)
    if base + len(raw) < total:
        strength[-1] = 0  # what follows is not seen
    low, high = overlap
    place = lambda byte: int(np.searchsorted(at, byte - base))  # the first character from a byte on
    own = place(number * width)
    chars = place(min((number + 1) * width, total)) - own

    def meet(n: int) -> int:
        if n == 0 or n * width >= total:
            return place(total) if n else place(0)
        here = place(n * width)
        return _best(strength, here - limit // 2, here)

    back = lambda end: _best(strength, end - high, end - low)
    begin, goal = meet(number), meet(number + 1)
    start = back(begin) if number else begin
    out = []
    while goal - start > limit:
        end = _best(strength, start + limit // 2, start + limit)
        out.append((start, end))
        start = back(end)
    if goal > begin or not total:
        out.append((start, goal))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return Cut(chars, pairs[:, 0] - own, pairs[:, 1] - own, at[pairs[:, 0]], at[pairs[:, 1]])


_SHAPE = "begin long, end long, piece string"


def _cut_cells(cells: DataFrame, keys: Sequence[str], params: dict, with_text: bool) -> DataFrame:
    """``keys, _range`` and, for the boundary table, ``chars, count``, or, to emit, ``n, begin, end, piece``."""
    types = dict(cells.select(*keys).dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rows, chars, count, n, begin, end, piece, size = [], [], [], [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                held = [c.take(pa.array(rows, pa.int64())) for c in (*(column[k] for k in keys), column["_range"])]  # noqa: B023
                if with_text:
                    new = [pa.array(n, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(piece, pa.string())]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*held, *new], names=[*keys, "_range", "n", "begin", "end", "piece"])
                return pa.RecordBatch.from_arrays([*held, pa.array(chars, pa.int64()), pa.array(count, pa.int64())], names=[*keys, "_range", "chars", "count"])  # noqa: B023

            for i in range(b.num_rows):
                window, base, number, total = (column[c][i].as_py() for c in ("_window", "_base", "_range", "_total"))
                cut = cut_range(window, base, number, total, **params)
                if with_text:
                    many = len(cut.begin)
                    rows += [i] * many
                    n += range(many)
                    begin += cut.begin.tolist()
                    end += cut.end.tolist()
                    piece += [window[x:y].decode("utf-8", errors="replace") for x, y in zip(cut.first.tolist(), cut.last.tolist(), strict=True)]
                    size += len(window)
                    if size > 8_000_000:
                        yield flush()
                        rows, n, begin, end, piece, size = [], [], [], [], [], 0
                else:
                    rows.append(i)
                    chars.append(cut.chars)
                    count.append(len(cut.begin))
            if rows:
                yield flush()

    return cells.mapInArrow(run, f"{head}, _range int, " + (f"n int, {_SHAPE}" if with_text else "chars long, count long"))


def _stitched(cells: DataFrame, keys: Sequence[str], params: dict) -> DataFrame:
    """The pieces of ``cells`` (``keys, _range, _base, _total, _window``; one row a range): ``keys, ord, begin, end, piece``.

    Texts of one range are cut in place. Of the others, the boundary table is made first, a narrow row a range; its
    prefix sums say how many characters and pieces lie before each range, also of a text of any number of ranges; they
    are joined to the ranges, which then emit. Repeated rows of ``cells`` stay repeated.
    """
    width = params["width"]
    pick = [*keys, "ord", "begin", "end", "piece"]
    one = _cut_cells(cells.where(F.col("_total") <= width), keys, params, True).withColumn("ord", F.col("n").cast("long") + 1).select(*pick)
    giant = cells.where(F.col("_total") > width)
    marked = [F.struct(*[F.col(k) for k in keys]).alias("_key")]
    # A digest stands for the keys, which may be null, in sums and joins.
    digest = F.sha2(F.to_json(*marked), 256)
    parts = ["_range", "_base", "_total", "_window"]
    table = materialise(_cut_cells(giant.select(digest.alias("_item"), *parts), ["_item"], params, False).distinct(), "boundaries")
    if table.isEmpty():
        return one
    lengths = running_before(table, ["_item"], [F.col("_range")], F.col("chars"), "_chars")
    before = running_before(lengths, ["_item"], [F.col("_range")], F.col("count"), "_count").select(F.col("_item").alias("_of"), F.col("_range").alias("_at"), "_chars", "_count")
    placed = giant.withColumn("_item", digest)
    placed = placed.join(before, (F.col("_item") == F.col("_of")) & (F.col("_range") == F.col("_at"))).drop("_item", "_of", "_at")
    many = _cut_cells(placed, [*keys, "_chars", "_count"], params, True)
    many = many.select(*keys, (F.col("_count") + F.col("n") + 1).alias("ord"), (F.col("_chars") + F.col("begin")).alias("begin"), (F.col("_chars") + F.col("end")).alias("end"), "piece")
    return one.unionByName(many)


def _params(limit: int, overlap: tuple[int, int], width: int) -> dict:
    low, high = overlap
    if not 0 <= low <= high < limit // 2 or width < 4 * limit:
        raise ValueError("overlap must be less than half the limit, and a range hold at least four bytes a character of a piece")
    return {"limit": limit, "overlap": overlap, "width": width}


def pieces(items: DataFrame, text: str = "text", limit: int = LIMIT, overlap: tuple[int, int] = (OVERLAP_LOW, OVERLAP_HIGH), width: int = RANGE) -> DataFrame:
    """Each row of ``items`` as pieces: its columns but ``text``, and ``ord, begin, end, piece``, counting from 1 and in characters.

    A piece has at most ``limit`` characters; each but a text's first begins with the last ``overlap`` characters of
    the one before; together they give the whole text. Cuts fall on the strongest natural boundary in the second
    half of what fits: blank line, line end, sentence, word; without one, between two characters, never before a
    combining mark or inside a line end. A text within the limit is one piece, the empty text one empty piece, a
    null text none. Repeated rows are cut each; columns named ``ord, begin, end, piece`` or ``n`` must be renamed first.

    The JVM cuts a cell's bytes into ranges with halos; workers see ranges. Map-only for texts of one range; of longer
    ones each range is shuffled once.
    """
    reach = halo(limit, overlap[1])
    kept = [c for c in items.columns if c != text]
    if {"ord", "begin", "end", "piece", "n", "chars", "count", "_range", "_base", "_total", "_window"} & set(kept):
        raise ValueError("a column's name is one of the result's")
    total = F.octet_length(text)
    ranges = F.sequence(F.lit(0), F.greatest(F.ceil(total / F.lit(width)) - 1, F.lit(0)).cast("int"))
    cells = (
        items.where(F.col(text).isNotNull())
        .select(*kept, F.col(text).cast("binary").alias("_bytes"), total.cast("long").alias("_total"), F.explode(ranges).alias("_range"))
        .withColumn("_base", F.greatest(F.col("_range") * F.lit(width) - F.lit(reach), F.lit(0)))
        .select(*kept, "_range", F.col("_base").cast("long").alias("_base"), "_total", F.substring(F.col("_bytes"), F.col("_base") + 1, F.least(F.lit(width + 2 * reach), (F.col("_range") + 1) * F.lit(width) + F.lit(reach) - F.col("_base"))).alias("_window"))
    )
    return _stitched(cells, kept, _params(limit, overlap, width))


def file_pieces(spark: SparkSession, folder: str, limit: int = LIMIT, overlap: tuple[int, int] = (OVERLAP_LOW, OVERLAP_HIGH), width: int = RANGE, glob: str = "*") -> DataFrame:
    """``file, ord, begin, end, piece`` of the UTF-8 text files below ``folder``, cut as by :func:`pieces`.

    Only names and sizes are listed; each range is read by its offset, from any file system that pyarrow opens by
    the URIs Spark lists, by the task that cuts it. Files may be of any size; empty ones, which Spark does not list, have
    no piece.
    """
    reach = halo(limit, overlap[1])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select(F.col("path").alias("file"), F.col("length").alias("_total"))
    count = F.greatest(F.ceil(F.col("_total") / F.lit(width)), F.lit(1)).cast("int")
    # A giant file's ranges are dealt over all tasks.
    listed = files.select("file", "_total", F.explode(F.sequence(F.lit(0), count - 1)).alias("_range")).repartition("file", "_range")
    listed = listed.withColumn("_base", F.greatest(F.col("_range").cast("long") * F.lit(width) - F.lit(reach), F.lit(0)).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile | None] = ("", None)
        for b in batches:
            for file, number, base, total in zip(*(b.column(n).to_pylist() for n in ("file", "_range", "_base", "_total")), strict=True):
                if opened[0] != file:
                    system, path = arrow_fs.FileSystem.from_uri(arrow_uri(file))
                    opened = file, system.open_input_file(path)
                opened[1].seek(base)
                window = opened[1].read(min(total, (number + 1) * width + reach) - base)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int32()), pa.array([base], pa.int64()), pa.array([total], pa.int64()), pa.array([window], pa.binary())], names=["file", "_range", "_base", "_total", "_window"])

    cells = listed.select("file", "_range", "_base", "_total").mapInArrow(read, "file string, _range int, _base long, _total long, _window binary")
    return _stitched(cells, ["file"], _params(limit, overlap, width))


def vault_items(corpus: DataFrame, collected: DataFrame) -> DataFrame:
    """``item_table, path, item, text``: contents of ``corpus`` and texts of the current ``collected_notes`` rows.

    ``item`` is a digest of the text, by which several contents of a path are told apart. Repeated rows of ``corpus`` stay
    repeated, so its texts are not shuffled. The current row of a path has the greatest ``collected_at`` (of equals, the
    greatest digest).
    """
    notes = spread(corpus.where(F.col("content").isNotNull()).select("path", "content")).select(F.lit("corpus").alias("item_table"), "path", F.xxhash64("content").alias("item"), F.col("content").alias("text"))
    rows = collected.select("path", F.struct("collected_at", F.xxhash64("text").alias("item")).alias("at"), "text")
    rows = rows.groupBy("path").agg(F.max("at").alias("at"), F.max_by("text", "at").alias("text")).where(F.col("text").isNotNull())
    return notes.unionByName(rows.select(F.lit("collected_notes").alias("item_table"), "path", F.col("at.item").alias("item"), "text"))


def oversized(corpus: DataFrame, collected: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``item_table, path`` of the items that :func:`pieces` cuts into more than one piece.

    Every row is cut where it is read, older rows of ``collected_notes`` too; which of those is the current one is told
    afterwards from the numbers of pieces, so that no text is shuffled for it.
    """
    never = F.lit(None).cast(dict(collected.dtypes)["collected_at"])
    notes = spread(corpus.select("path", F.col("content").alias("text"))).select(F.lit("corpus").alias("item_table"), "path", never.alias("at"), F.xxhash64("text").alias("item"), "text")
    rows = spread(collected.select("path", "collected_at", "text")).select(F.lit("collected_notes").alias("item_table"), "path", F.col("collected_at").alias("at"), F.xxhash64("text").alias("item"), "text")
    every = notes.unionByName(rows)
    cut = pieces(every, limit=limit).select("item_table", "path", "at", "item", "ord")
    none = every.where(F.col("text").isNull()).select("item_table", "path", "at", "item", F.lit(0).cast("long").alias("ord"))
    sizes = cut.unionByName(none).groupBy("item_table", "path", "at", "item").agg(F.max("ord").alias("n"))
    # A path of the corpus may have several contents; of a collected note the latest row counts (of equals, the greatest digest).
    own = sizes.groupBy("item_table", "path").agg(F.max("n").alias("most"), F.max(F.struct("at", "item", "n")).alias("m"))
    return own.where(F.when(F.col("item_table") == "corpus", F.col("most")).otherwise(F.col("m.n")) > 1).select("item_table", "path")
