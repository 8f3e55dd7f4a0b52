"""Whole batches of texts as one array of code points: character classes and run hashes without a Python loop."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    # The code points of Unicode's White_Space property.
    for i in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] = SPACE
    return out


@functools.cache
def lower() -> np.ndarray:
    """The lower-case code point of every code point, itself where that is more than one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):
        if not 0xD800 <= i < 0xE000 and len(c := chr(i).lower()) == 1:
            out[i] = ord(c)
    return out


def join(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts end to end, their code points, and where each begins (one more number than texts)."""
    held = [t or "" for t in texts]
    whole = "".join(held)
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))))
    return whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends


@functools.cache
def _powers(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


#: Odd multipliers (each invertible modulo 2**64) of two independent run hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def run_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each run ``points[start:end]``: equal runs get equal numbers wherever they lie."""
    size = 1 << max(10, int(len(points)).bit_length())
    power, back = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    upto = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=upto[1:])
    return (upto[end] - upto[start]) * back[start]


def first_of_equal(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs: the index of one run of each distinct kind, and for every run the place of its kind in that list.

    Kinds are told apart by 64 bits of hash, and by the runs' second hash and length where those should collide.
    """
    one = run_hashes(points, start, end, BASES[0])
    _, first, kind = np.unique(one, return_index=True, return_inverse=True)
    two = run_hashes(points, start, end, BASES[1]) ^ (end - start).astype(np.uint64)
    if not (two[first][kind] == two).all():
        _, first, kind = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
        kind = kind.reshape(-1)
    return first, kind
