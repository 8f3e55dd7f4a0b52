"""One form for texts that look the same: widths, blanks, invisible signs, composed accents, look-alike letters."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm.chars import join
from fathomark.operators.ordering import hot_join
from fathomark.session import materialise, spread

#: Code points looked at; beyond them lie only tags, variation selectors and private use, of which the first two vanish.
_PLANES = 0x32000


@functools.cache
def confusable_letters(spark: SparkSession) -> dict[int, str]:
    """Letters and the letter that each looks like, from the Unicode confusables data that Spark's ICU library holds.

    Taken are those of its mappings that lead from one letter outside ASCII to one other letter of the same case: what
    differs in accents, punctuation, digits or case stays apart, and so do letters that look like several. Capital
    letters that look like the capital I (which the data puts with the small l) become that.
    """
    simple = lambda c: (form := unicodedata.decomposition(c)) == "" or form.startswith("<compat")  # noqa: E731  (no accents, no other shapes)
    letters = [c for c in map(chr, range(0x80, _PLANES)) if unicodedata.category(c)[0] == "L" and simple(c) and not 0xAC00 <= ord(c) < 0xD7A4]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shapes = checker.getSkeleton("\n".join(letters)).split("\n")
    out = {}
    for c, shape in zip(letters, shapes, strict=True):
        s = unicodedata.normalize("NFC", shape)
        if s == "l" and c.isupper():
            s = "I"
        if len(s) == 1 and s != c and unicodedata.category(s)[0] == "L" and not (c.isupper() and s.islower()) and not (c.islower() and s.isupper()):
            out[ord(c)] = s
    return out


def plain_forms() -> dict[int, str | None]:
    """What each character becomes but for look-alike letters. By rule: blanks of any kind are a space; format signs,
    variation selectors and fillers vanish; wide and narrow forms, ligatures, radicals and compatibility ideographs take
    their plain form. Superscripts, circled and other forms that look different stay."""
    table: dict[int, str | None] = {9: " ", 0x2010: "-"}
    for i in (*range(_PLANES), *range(0xE0000, 0xE0200)):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        c = chr(i)
        kind, form = unicodedata.category(c), unicodedata.decomposition(c)
        tag = form.split(">")[0] if form.startswith("<") else ""
        if kind == "Zs":
            table[i] = " "
        elif kind == "Cf" or 0xFE00 <= i < 0xFE10 or 0xE0100 <= i < 0xE01F0 or i in (0x115F, 0x1160, 0x3164, 0x034F):
            table[i] = None
        elif tag == "<noBreak":
            table[i] = "-"
        elif tag in ("<wide", "<narrow") or tag == "<compat" and (0x2E80 <= i < 0x2FE0 or 0xFB00 <= i < 0xFB07):
            table[i] = unicodedata.normalize("NFKC", c)
        elif form and not tag and len(form.split()) == 1:
            table[i] = unicodedata.normalize("NFC", c)
    return table


def with_letters(table: Mapping[int, str | None], letters: Mapping[int, str]) -> dict[int, str | None]:
    """``table`` with look-alike letters, also under accents and behind other forms."""
    of = dict(letters)
    for k, v in letters.items():
        seen = {k}
        while len(v) == 1 and ord(v) in letters and ord(v) not in seen:
            seen.add(ord(v))
            v = letters[ord(v)]
        of[k] = v
    out = {k: v and v.translate(of) for k, v in table.items()} | of
    for i in range(0xC0, _PLANES):
        form = unicodedata.decomposition(chr(i))
        if form and form[0] != "<" and len(form.split()) > 1 and not 0xAC00 <= i < 0xD7A4:
            parts = unicodedata.normalize("NFD", chr(i))
            changed = parts.translate(of)
            if changed != parts:
                out[i] = unicodedata.normalize("NFC", changed)
    return {k: v for k, v in out.items() if v != chr(k)}


@functools.cache
def _table(letters: tuple[tuple[int, str], ...]) -> dict[int, str | None]:
    return with_letters(plain_forms(), dict(letters))


def look(text: str, letters: tuple[tuple[int, str], ...]) -> str:
    """The one form of a text, given the look-alike letters."""
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    table = _table(letters)
    # Halfwidth sound marks come out as combining ones, and composing may leave a letter that looks like another.
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(table)).translate(table))


@functools.cache
def _arrays(letters: tuple[tuple[int, str], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first, second and further code points that each code point becomes, how many they are, and where these would
    become others again."""
    table = _table(letters)
    to = np.zeros((max(len(v or "") for v in table.values()), 0x110000), np.uint32)
    to[0] = np.arange(0x110000)
    size, odd = np.ones(0x110000, np.uint8), np.zeros(0x110000, bool)
    for k, v in table.items():
        v = v or ""
        size[k], odd[k] = len(v), v.translate(table) != v
        for i, c in enumerate(v):
            to[i, k] = ord(c)
    return to, size, odd


def look_all(texts: list[str], letters: tuple[tuple[int, str], ...]) -> list[str]:
    """:func:`look` of many texts, which are mapped together as one array."""
    out = list(texts)
    wide = [i for i, t in enumerate(texts) if not t.isascii()]
    for i, t in enumerate(texts):
        if "\t" in t and t.isascii():
            out[i] = t.replace("\t", " ")
    to, size_of, odd = _arrays(letters)
    at = 0
    while at < len(wide):
        many, size = at, 0
        while many < len(wide) and (many == at or size < 1_000_000):
            size += len(texts[wide[many]])
            many += 1
        own = wide[at:many]
        _, points, ends = join([texts[i] for i in own])
        strange = np.concatenate(([0], np.cumsum(odd[points])))[ends]
        sizes = size_of[points]
        begin = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        forms = np.repeat(to[0][points], sizes)
        for i in range(1, len(to)):
            longer = np.flatnonzero(sizes > i)
            forms[begin[longer] + i] = to[i][points[longer]]
        ends = begin[ends]
        shown = forms.tobytes().decode("utf-32-le")
        for n, i in enumerate(own):
            t = shown[ends[n] : ends[n + 1]]
            out[i] = t if strange[n] == strange[n + 1] and unicodedata.is_normalized("NFC", t) else look(texts[i], letters)
        at = many
    return out


#: Digests of texts that a task remembers having mapped.
REMEMBERED = 200_000


def mapped(values: DataFrame) -> DataFrame:
    """``field, key, vid, fid, form, value`` of ``field, key, value``: the digests of a value and of its look-alike-mapped form,
    and the form itself where a task meets the value first in a field; later copies have a null there. The value is kept
    only where there is a form that differs from it. Map-only."""
    letters = tuple(sorted(confusable_letters(values.sparkSession).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, bytes], bytes] = {}
        for b in batches:
            column = b.column(2)
            begin = 0
            while begin < b.num_rows:
                texts, size, end = [], 0, begin
                while end < b.num_rows and (end == begin or size < 4_000_000):
                    texts.append(column[end].as_py())
                    size += len(texts[-1])
                    end += 1
                vids = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts]
                n = end - begin
                own = list(zip(b.column(0).slice(begin, n).to_pylist(), vids, strict=True))
                if len(known) > REMEMBERED:
                    known.clear()
                first = {k: i for i, k in reversed(list(enumerate(own))) if k not in known}
                forms: list[str | None] = [None] * len(texts)
                other: list[str | None] = [None] * len(texts)
                for (k, i), form in zip(first.items(), look_all([texts[i] for i in first.values()], letters), strict=True):
                    forms[i] = form
                    known[k] = vids[i] if form == texts[i] else hashlib.md5(form.encode(), usedforsecurity=False).digest()
                    other[i] = None if form == texts[i] else texts[i]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, n), b.column(1).slice(begin, n), pa.array(vids, pa.binary()), pa.array([known[k] for k in own], pa.binary()), pa.array(forms, pa.string()), pa.array(other, pa.string())],
                    names=["field", "key", "vid", "fid", "form", "value"],
                )
                begin = end

    keyed = values.where(F.col("value").isNotNull() & F.col("key").isNotNull())
    return spread(keyed.select(F.col("field").cast("string").alias("field"), F.col("key").cast("string").alias("key"), "value")).mapInArrow(run, "field string, key string, vid binary, fid binary, form string, value string")


def _members(values: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The classes of :func:`look_classes` in digests: ``field, key, vid, class, canonical, member``, where ``member`` is the
    digest of the least value; ``field, member, text, n`` of the least values, with the rows that each stands for, not
    read before it is used; and the number of rows."""
    forms = materialise(mapped(values), "forms")
    rows = materialise(forms.select("field", "key", "vid", "fid").distinct(), "values")
    met = forms.where(F.col("form").isNotNull()).withColumn("value", F.coalesce("value", "form"))
    collated = met.select("field", "fid", "value", F.expr("form COLLATE UNICODE").alias("form"))
    classes = collated.groupBy("field", "form").agg(F.collect_set("fid").alias("fids"), F.unhex(F.md5(F.min("value"))).alias("member"))
    classes = materialise(classes.select("field", "member", F.array_min("fids").alias("cid"), F.explode("fids").alias("fid")), "collated")
    found = rows.groupBy("field", "fid").agg(F.min("vid").alias("least"), F.count("*").alias("n")).join(classes, ["field", "fid"])
    canonical = found.groupBy("field", "cid").agg(F.min("least").alias("canonical"), F.sum("n").alias("size"))
    known = materialise(found.join(canonical, ["field", "cid"]).select("field", "fid", "n", "canonical", "member", "size"), "classes")
    total = rows.count()
    members = hot_join(rows, known.drop("size"), ["field", "fid"], ["key"], "n", total)
    members = members.select("field", "key", "vid", F.xxhash64("field", "member").alias("class"), "canonical", "member")
    standing = known.select("field", "member", F.col("size").alias("n")).distinct()
    texts = met.select("field", F.col("vid").alias("member"), F.col("value").alias("text")).join(standing, ["field", "member"])
    return members, texts.groupBy("field", "member").agg(F.first("text").alias("text"), F.first("n").alias("n")), total


def _with_text(members: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """``members`` with ``text`` for ``member``."""
    return hot_join(members, materialise(texts, "texts"), ["field", "member"], ["key"], "n", total).drop("member", "n")


def look_classes(values: DataFrame) -> DataFrame:
    """``field, key, value`` to ``field, key, vid, class, canonical, text``: equivalence classes of texts of one look.

    Values are grouped, per field, by their mapped form under the accent- and case-sensitive Unicode collation,
    which also takes differently composed accents for equal. The canonical member of a class is its least value by code
    point, so that a plain spelling goes before wide or foreign letters; its ``text`` is joined back to every row, and the
    class id is made of its digest. ``vid`` is the digest of a value and ``canonical`` the least of them in the class. Null
    values and keys belong to no class; the empty text is a class of its own. Repeated rows fold into one.

    Each text is mapped once a task. Whole forms are shuffled once with the least value of each, copies folded map-side
    before, so that a text held by a third of all rows is one row a task; digests move until the texts of the
    canonical members are fetched by theirs and joined, which again spreads hot classes.
    """
    return _with_text(*_members(values))


def vault_values(notes: DataFrame, tags: DataFrame, corpus: DataFrame) -> DataFrame:
    """``field, key, value`` of note titles, tags and contents."""
    return (
        notes.select(F.lit("title").alias("field"), F.col("path").alias("key"), F.col("title").alias("value"))
        .unionByName(tags.select(F.lit("tag").alias("field"), F.col("tag").alias("key"), F.col("tag").alias("value")))
        .unionByName(corpus.select(F.lit("content").alias("field"), F.col("path").alias("key"), F.col("content").alias("value")))
    )


def look_pairs(values: DataFrame) -> DataFrame:
    """``field, key_a, key_b``: keys whose values look the same but are not the same characters.

    Each key of a value is paired with one key (the least) of every other value of its class. Among exact copies of
    two values not all pairs are listed, but every key is linked to every other spelling. So there are as many rows as
    links between different texts; :func:`canonical_forms` says the same in a row a key.
    """
    members = materialise(_members(values)[0].select("field", "key", "vid", "class"), "members")
    spellings = members.groupBy("field", "class", "vid").agg(F.min("key").alias("other"), F.count("*").alias("own"))
    sizes = spellings.groupBy("field", "class").agg(F.sum("own").alias("n"), F.count("*").alias("spellings")).where("spellings > 1").drop("spellings")
    spellings = materialise(spellings.join(sizes, ["field", "class"]).select("field", "class", F.col("vid").alias("ovid"), "other", "n"), "spellings")
    return (
        hot_join(members, spellings, ["field", "class"], ["key"], "n", members.count())
        .where((F.col("vid") != F.col("ovid")) & (F.col("key") != F.col("other")))
        .select("field", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))
        .distinct()
    )


def canonical_forms(values: DataFrame) -> DataFrame:
    """``field, key, class, canonical, text``: each value's class, the least digest (MD5) in it, and the text of the member
    that stands for it."""
    members, texts, total = _members(values)
    members = members.select("field", "key", "class", F.lower(F.hex("canonical")).alias("canonical"), "member").distinct()
    return _with_text(members, texts, total)
