"""Encoding a corpus with a public byte-level BPE vocabulary, through a sentencepiece model written from it.

The vocabulary's tokens are byte strings with ranks. They are serialised, without training, as a sentencepiece BPE
model: every token becomes a piece whose characters stand for its bytes and whose score is its negative rank, and
the normaliser is the identity. Merging the adjacent pair with the best score is then merging the pair of lowest
rank, so encoding each pre-token gives the vocabulary's own ids.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm.chars import LETTER, SPACE, classes, first_of_equal, join
from fathomark.session import spread

#: Fixed value: the pre-token pattern of the public byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the driver finds the vocabulary; a parameter of every function here. Workers get the file from the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself where it is a printable Latin-1 character, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (payload if kind != 2 else _varint(len(payload)) + payload)


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece BPE model; piece n is the token of rank n, one more is unknown."""
    alphabet = byte_alphabet()
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 2)
    for token, rank in ranks.items():
        tokens[rank] = token
    out = []
    unknown = len(tokens) - 1
    for rank, token in enumerate(tokens):
        kind = 2 if rank == unknown else 1 if token is not None else 5  # unknown, normal, unused
        name = "<unk>" if rank == unknown else "".join(alphabet[b] for b in token) if token is not None else f"<gap{rank}>"
        out.append(_field(1, 2, _field(1, 2, name.encode()) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(kind))))
    no_id = _varint((1 << 64) - 1)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens))) + _field(40, 0, _varint(unknown)) + b"".join(_field(n, 0, no_id) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normaliser)


def pretoken_starts(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of :data:`PATTERN` begin in texts laid end to end, found by class changes.

    A blank before a letter, number or other sign belongs to it; of a longer run of white space all but the last
    sign form a token; an apostrophe takes the letters of an English contraction.
    """
    size = len(points)
    kind = classes()[points]
    begin = np.zeros(size + 1, bool)
    begin[1:size] = kind[1:] != kind[:-1]
    head = texts[:-1][np.diff(texts) > 0]
    begin[head] = True
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    inner = np.ones(size + 1, bool)
    inner[head] = False
    after = after[inner[after]]
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    mark = np.flatnonzero((points[:-1] == 39) & begin[: size - 1] & inner[1:size] & (kind[1:] == LETTER))
    if len(mark):
        padded = np.concatenate((points, [0, 0]))
        one, two = padded[mark + 1], padded[mark + 2]
        inside = np.concatenate((inner, [False, False]))[mark + 2]
        single = np.isin(one, _codes("sdmt"))
        double = inside & (((one == 108) & (two == 108)) | ((np.isin(one, _codes("vr"))) & (two == 101)))
        for hit, width in ((single, 2), (double & ~single, 3)):
            begin[mark[hit] + 1] = False
            begin[mark[hit] + width] = True
    return np.flatnonzero(begin[:size])


def _codes(letters: str) -> np.ndarray:
    return np.array([ord(c) for c in letters], np.uint32)


class Encoder:
    """Encodes and decodes texts with one vocabulary. ``remember`` bounds the pre-tokens whose ids are kept between batches."""

    def __init__(self, path: str = VOCABULARY, remember: int = 200_000):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.known: dict[str, np.ndarray] = {}
        self.remember = remember

    def _pieces(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each distinct pre-token."""
        if len(self.known) > self.remember:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        mapped = [w.encode().decode("latin-1").translate(self.alphabet) for w in fresh]
        ids = [np.array(x, dtype=np.int32) for x in self.model.encode(mapped, num_threads=1)] if fresh else []
        own = dict(zip(fresh, ids, strict=True))
        found = [self.known[w] if w in self.known else own[w] for w in words]
        self.known.update((w, x) for w, x in own.items() if len(w) < 64)
        return found

    def _split(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of the distinct pre-tokens, the kind of each pre-token in order, and where each text's pre-tokens begin."""
        whole, points, ends = join(texts)
        if not len(points):
            return [], np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
        start = pretoken_starts(points, ends)
        end = np.append(start[1:], len(points))
        first, kind = first_of_equal(points, start, end)
        words = [whole[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        return self._pieces(words), kind, np.searchsorted(start, ends)

    def batch(self, texts: list[str | None], giant: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (one more number than texts). Null and empty have none.

        Texts of more than ``giant`` characters are encoded part by part, so memory does not follow their length.
        """
        giant = giant or SLICE_CHARS
        if any(t and len(t) > giant for t in texts):
            own = [[self._ids([p]) for p in parts(t, giant)] if t and len(t) > giant else [self._ids([t])] for t in texts]
            ends = np.cumsum([0, *(sum(map(len, o)) for o in own)])
            return np.concatenate([np.zeros(0, np.int32), *(x for o in own for x in o)]), ends
        return self._whole(texts)

    def _ids(self, texts: list[str | None]) -> np.ndarray:
        return self._whole(texts)[0]

    def _whole(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        pieces, kind, ends = self._split(texts)
        if not pieces:
            return np.zeros(0, np.int32), ends
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate(([0], np.cumsum(size)))
        length = size[kind]
        upto = np.concatenate(([0], np.cumsum(length)))
        take = np.arange(upto[-1]) + np.repeat(start[kind] - upto[:-1], length)
        return np.concatenate(pieces)[take], upto[ends]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Only the number of ids of each text."""
        if any(t and len(t) > SLICE_CHARS for t in texts):
            return np.array([sum(int(self._counts([p]).sum()) for p in parts(t, SLICE_CHARS)) if t and len(t) > SLICE_CHARS else int(self._counts([t]).sum()) for t in texts], np.int64)
        return self._counts(texts)

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        pieces, kind, ends = self._split(texts)
        if not pieces:
            return np.zeros(len(texts), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.diff(np.concatenate(([0], np.cumsum(size[kind])))[ends])

    def decode(self, ids) -> str:
        """The text of ``ids``: each piece's bytes by the inverse mapping."""
        return b"".join(self.bytes_of[int(i)] for i in ids).decode(errors="replace")


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to all workers, once an application; the name by which they find it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoder(name: str) -> Encoder:
    """One encoder a worker process, of a vocabulary that was shipped."""
    path = SparkFiles.get(name)
    key = (os.getpid(), path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


#: Characters of text encoded at once: bounds the memory of a Python worker whatever the Arrow batch holds.
SLICE_CHARS = 2_000_000


#: Places where a pre-token begins whatever stands around: white space after anything else; a Japanese full stop or comma
#: after a letter, and a kana after those. Only a single pre-token longer than a part stays whole.
_SURE = re.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=[^\W\d_])(?=[。、])|(?<=[。、])(?=[\u3041-\u3096])")


def parts(text: str, most: int) -> list[str]:
    """A text cut, after about ``most`` characters, where a pre-token surely begins; the parts give the same ids."""
    out, at = [], 0
    while len(text) - at > most:
        m = _SURE.search(text, at + max(most // 2, 1))
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``most`` characters each, or one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: one row a row of ``documents``, null and empty texts as an empty list; whole texts, no special tokens.

    Map-only: no shuffle, but where the table has fewer splits than there are cores. Other columns are not read.
    """

    name = ship(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                ids, at = enc.batch(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens``: the length of what :func:`encode` gives, without carrying the ids."""

    name = ship(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(enc.counts(texts[i:j]), pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, tokens long")
