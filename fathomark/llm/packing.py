"""Filling containers of fixed capacity with documents, by best-two-fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.tokens import VOCABULARY, token_counts
from fathomark.session import materialise

CAPACITY = 2048
#: Items packed together in one task. Each such group leaves at most one container poorly filled.
GROUP_ITEMS = 20_000


class _Shelf:
    """Unpacked items by size: a count for each size, and the sizes that are there as bits of one integer."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.tolist()
        self.bits = sum(1 << s for s, n in enumerate(self.left) if n and s)

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, 0 if none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.bits and most > 0 and self.bits & ((1 << (most + 1)) - 1) else 0

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            self.bits &= ~(1 << size)

    def put(self, size: int) -> None:
        self.left[size] += 1
        self.bits |= 1 << size

    def best_two(self, room: int, over: int) -> tuple[int, int] | None:
        """Two items whose sum is the greatest up to ``room`` and more than ``over``; None if there are none."""
        best, found = over, None
        a = self.largest(room - 1)
        while a and 2 * a > best:
            b = self.largest(min(a, room - a))
            if b == a and self.left[a] < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            a = self.largest(a - 1)
        return found


def best_two_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container, counted from 0, of each item of ``sizes`` (each 0 to ``capacity``).

    A container is filled greedily with the largest items that fit. Then, as long as that leaves less room, its
    smallest item is replaced by the two unpacked items that fit the gap so widened most tightly. Items of size 0
    go into the first container.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    shelf = _Shelf(np.bincount(sizes, minlength=capacity + 1))
    slots: list[tuple[int, int]] = []  # size, container
    box = 0
    while shelf.bits:
        gap, held = capacity, []
        while size := shelf.largest(gap):
            shelf.take(size)
            held.append(size)
            gap -= size
        while gap and len(held) > 1:
            small = held[-1]
            pair = shelf.best_two(gap + small, small)
            if not pair:
                break
            held.pop()
            shelf.put(small)
            for size in pair:
                shelf.take(size)
                held.append(size)
            gap += small - sum(pair)
            held.sort(reverse=True)
        slots.extend((size, box) for size in held)
        box += 1
    out = np.zeros(len(sizes), dtype=np.int64)
    if slots:
        items = np.flatnonzero(sizes)
        items = items[np.argsort(sizes[items], kind="stable")]
        size, place = np.array(slots).T
        out[items] = place[np.lexsort((place, size))]
    return out


def pack(documents: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``doc_id, piece, tokens, container``: every document in a container of ``capacity`` tokens.

    A document is cut only if it has more tokens than a container: into pieces of exactly ``capacity`` and a rest,
    numbered from 0. Null and empty texts have 0 tokens and lie in some container. Repeated rows are items each; rows
    without an id are left out.

    The sizes, two numbers a document, are written once. Pieces that fill a container are done where they are read (their containers have negative numbers). Of each
    document at most one item is left; these are dealt in turn over groups of at most ``group_items`` and one more a
    task, whatever their ids, and each group is packed by :func:`best_two_fit` in a task of its own. Only ids and
    sizes are shuffled. Sizes need not be spread evenly: the groups are of the same mixture.
    """
    sized = materialise(token_counts(documents.where(F.col("doc_id").isNotNull()), path).withColumn("_n", F.monotonically_increasing_id()), "sizes")
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") % capacity
    left = (rest > 0) | (F.col("tokens") == 0)
    groups = max(1, -(-sized.where(left).count() // group_items))
    # The running number in a task, and the task's number times a step, so that tasks do not all begin at one group.
    batch = F.pmod(F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright(F.col("_n"), 33) * F.lit(7919), F.lit(groups))
    filled = sized.where(whole > 0).select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), F.lit(capacity).cast("long").alias("tokens"))
    filled = filled.select("doc_id", "piece", "tokens", (-1 - F.monotonically_increasing_id()).alias("container"))
    items = sized.where(left).select("doc_id", whole.alias("piece"), rest.alias("tokens"), batch.alias("batch"))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable")
        place = best_two_fit(frame["tokens"].to_numpy(), capacity) + (int(key[0]) << 32)
        return pd.DataFrame({"doc_id": frame["doc_id"], "piece": frame["piece"], "tokens": frame["tokens"], "container": place})

    return items.groupBy("batch").applyInPandas(fill, "doc_id long, piece int, tokens long, container long").unionByName(filled)
