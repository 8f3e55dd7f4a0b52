"""The most similar vectors of every vector: score-aware quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomark.operators.ordering import hot_join
from fathomark.session import materialise

DIMENSIONS = 64
#: Vectors on which centres and codebooks are fitted, chosen by a hash of their ids; the index holds every vector.
SAMPLE = 16_384
#: Vectors a cell is meant to hold, the most centres of a level, and the members of a cell that one task scans.
CELL, MOST_CENTRES, BLOCK = 400, 2048, 2_000
#: Cells that a query looks into first, where all others that may hold something follow.
PROBES = 2
#: Queries by which the number of cells is tuned, the most cells tried, and the share of true neighbours wanted in them.
TUNED_BY, MOST_TRIED, TARGET = 256, 4096, 0.97
#: Candidates of a query in a block that are scored exactly first; further ones follow as far as the error bound demands.
RERANK = 64
#: Members and queries that meet in a task of the further cells.
ROOM, GUESTS = 20_000, 16_000
#: What 32-bit sums may be off by, and angles computed from them (radians).
SLACK, ANGLE_SLACK = 1e-5, 5e-3
#: Inner products from which on accuracy matters most; sets the price of the error along the vector.
AIM = 0.2
_SUBSPACES, _CODES = 16, 16


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the right number of entries, all finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Quantiser:
    """Coarse centres, for each of 16 subspaces a codebook of 16 codewords for what a centre leaves over, and fine
    centres of what the means of the coarse ones' vectors leave over. A cell is a coarse and a fine centre, so that cells can be many more
    than the sample has vectors, while what every worker holds is two short lists."""

    centres: np.ndarray
    books: np.ndarray
    means: np.ndarray
    fine: np.ndarray

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coarse and the fine centre of each vector."""
        coarse = _nearest(x, self.centres)
        if len(self.fine) == 1:
            return coarse, np.zeros(len(x), np.int64)
        return coarse, _closest_centre(x - self.means[coarse], self.fine)

    def order(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``most`` cells of each query, nearest first: coarse and fine centres. Among the fine cells of as
        many coarse ones."""
        many, wide = len(self.centres), len(self.fine)
        most = min(most, many * wide)
        score = queries @ self.centres.T
        if wide == 1:
            best = np.argsort(-score, axis=1, kind="stable")[:, :most]
            return best, np.zeros_like(best)
        few = min(most, many)
        coarse = np.argpartition(-score, few - 1, axis=1)[:, :few]
        of_mean = queries @ self.means.T - (self.means**2).sum(1) / 2
        of_fine = queries @ self.fine.T - (self.fine**2).sum(1) / 2
        whole = np.take_along_axis(of_mean, coarse, 1)[:, :, None] + of_fine[:, None, :] - (self.means @ self.fine.T)[coarse]
        flat = whole.reshape(len(queries), -1)
        best = np.argpartition(-flat, min(most, flat.shape[1]) - 1, axis=1)[:, :most]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(coarse, best // wide, 1), best % wide

    @property
    def price(self) -> float:
        return (self.centres.shape[1] - 1) * AIM**2 / (1 - AIM**2)

    @staticmethod
    def fit(x: np.ndarray, cells: int, fine: int = 1, rounds: int = 8) -> Quantiser:
        """Spherical k-means for the coarse centres, k-means of what they leave for the fine ones; then codewords that minimise the anisotropic loss: the squared error,
        with the part parallel to the vector weighted by ``price``."""
        rng = np.random.default_rng(7)
        cells = max(1, min(cells, len(x)))
        centres = x[rng.permutation(len(x))[:cells]].copy()
        for _ in range(rounds):
            own = _nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres).astype(np.float32)
        own = _nearest(x, centres)
        means = centres * (np.bincount(own, np.einsum("nd,nd->n", x, centres[own]), cells) / np.maximum(np.bincount(own, minlength=cells), 1))[:, None].astype(np.float32)
        left = x - centres[own]
        fines = np.zeros((1, x.shape[1]), np.float32)
        if fine > 1:
            far = x - means[own]
            fines = far[rng.permutation(len(x))[: min(fine, len(x))]].copy()
            for _ in range(rounds):
                own = _closest_centre(far, fines)
                sums, size = np.zeros_like(fines), np.bincount(own, minlength=len(fines))[:, None]
                np.add.at(sums, own, far)
                fines = np.where(size > 0, sums / np.maximum(size, 1), fines).astype(np.float32)
        rest = left.reshape(len(x), _SUBSPACES, -1)
        books = np.stack([rest[rng.integers(0, len(x), _CODES), m] + rng.normal(0, 1e-3, (_CODES, rest.shape[2])) for m in range(_SUBSPACES)])
        out = Quantiser(centres, books.astype(np.float32), means, fines)
        for _ in range(rounds):
            codes = out.encode(x)
            parts = x.reshape(rest.shape)
            along = np.einsum("nmd,nmd->nm", rest - out.books[np.arange(_SUBSPACES), codes], parts)
            for m in range(_SUBSPACES):
                others = along.sum(1) - along[:, m]
                goal = others + np.einsum("nd,nd->n", rest[:, m], parts[:, m])
                for c in range(_CODES):
                    mine = codes[:, m] == c
                    if mine.sum() < 2:
                        continue
                    p, q = parts[mine, m], rest[mine, m]
                    extra = out.price - 1
                    system = mine.sum() * np.eye(p.shape[1]) + extra * p.T @ p
                    out.books[m, c] = np.linalg.solve(system, q.sum(0) + extra * (p * goal[mine, None]).sum(0))
                along[:, m] = np.einsum("nd,nd->n", rest[:, m] - out.books[m, codes[:, m]], parts[:, m])
        return out

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Four-bit codes of each subspace, chosen in turn so that the anisotropic loss of the whole vector is least."""
        rest = (x - self.centres[_nearest(x, self.centres)]).reshape(len(x), _SUBSPACES, -1)
        parts = x.reshape(rest.shape)
        flat = lambda x: np.matmul(x.transpose(1, 0, 2), self.books.transpose(0, 2, 1)).transpose(1, 0, 2)  # noqa: E731  (inner products with all codewords)
        error = (rest**2).sum(2)[:, :, None] - 2 * flat(rest) + (self.books**2).sum(2)
        along = np.einsum("nmd,nmd->nm", rest, parts)[:, :, None] - flat(parts)
        codes = error.argmin(2)
        rows = np.arange(len(x))
        total = sum(along[rows, m, codes[:, m]] for m in range(_SUBSPACES)) if len(x) else np.zeros(0)
        for _ in range(rounds):
            for m in range(_SUBSPACES):
                others = total - along[rows, m, codes[:, m]]
                codes[:, m] = (error[:, m] + (self.price - 1) * (others[:, None] + along[:, m]) ** 2).argmin(1)
                total = others + along[rows, m, codes[:, m]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and each pair of subspaces, the inner product with all 256 pairs of codewords."""
        q = queries.reshape(len(queries), _SUBSPACES, -1)
        t = np.einsum("nmd,mcd->nmc", q, self.books)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(queries), _SUBSPACES // 2, -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _closest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - size).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    return (codes[:, 0::2] * _CODES + codes[:, 1::2]).astype(np.uint8)


def _double(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(exact: np.ndarray, k: int, floor: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest of each row that reach its floor; equals to six digits go by column."""
    many = exact.shape[1]
    row, col = np.nonzero(exact >= floor)
    if len(row) > k * len(exact):
        key = np.rint(exact * 1e6).astype(np.int64) * many + (many - 1 - np.arange(many))
        key[exact < floor] = np.iinfo(np.int64).min
        if many > k:
            least = np.partition(key, many - k, axis=1)[:, many - k, None]
            row, col = np.nonzero((key >= least) & (exact >= floor))
    return row, col


def scan(quantiser: Quantiser, centre: np.ndarray, packed: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, least: float | None, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, member and cosine of the ``k`` best members of one block for each query, itself included if it is there.

    All members are scored from the tables, and the ``rerank`` best of each query exactly. A table score is off by at
    most the length of what the member's code leaves over, so that every member whose score and that length together
    reach the k-th exact cosine and ``least`` is scored exactly as well: nothing of the block is lost.
    """
    out: tuple[list, list, list] = ([], [], [])
    many = len(packed)
    codes = np.stack([packed // _CODES, packed % _CODES], axis=2).reshape(many, -1)
    off = np.linalg.norm(vectors - centre - quantiser.books[np.arange(_SUBSPACES), codes].reshape(many, -1), axis=1)
    precise = _double(vectors)
    step = int(np.clip(512_000 // max(many, 1), 16, 256))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        t = quantiser.tables(q)
        score = np.repeat((q @ centre)[:, None], many, axis=1)
        for m in range(packed.shape[1]):
            score += t[:, m][:, packed[:, m]]
        exact_q = _double(q)
        floor = np.full(len(q), -2.0 if least is None else least)
        if many > rerank >= k:
            best = np.argpartition(-score, rerank - 1, axis=1)[:, :rerank]
            first = np.einsum("nd,nrd->nr", exact_q, precise[best])
            floor = np.maximum(floor, np.partition(first, rerank - k, axis=1)[:, rerank - k] - 1e-6)
        open_ = score + off >= floor[:, None] - SLACK
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            continue
        exact = exact_q[rows] @ precise[cols].T
        row, col = _top(exact, k, -2.0 if least is None else least - SLACK)
        for into, part in zip(out, (rows[row] + i, cols[col], exact[row, col]), strict=True):
            into.append(part)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def distinct_vectors(table: DataFrame, k: int = 5, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """The usable vectors once each, ``rep, n, hubs, vector``, and ``vec_id, rep``.

    ``rep`` is the least id with that vector, ``n`` how many ids have it, ``hubs`` the ``k + 1`` least of them. A vec_id
    with several vectors keeps the least. Copies are folded before anything is compared, so a vector that a third
    of all rows share is one row; the window that finds the hubs keeps ``k + 1`` rows a group on either side of its shuffle.
    """
    good = table.where(usable(F.col("vector"), dimensions) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<float>").alias("vector"))
    one = materialise(good.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("look", F.struct(F.xxhash64("vector").alias("a"), F.hash("vector").alias("b"))), "vectors")
    same = one.groupBy("look").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("look").orderBy("vec_id"))
    hubs = one.select("look", "vec_id", rank.alias("r")).where(F.col("r") <= k + 1).groupBy("look").agg(F.sort_array(F.collect_list("vec_id")).alias("hubs"))
    reps = materialise(same.join(hubs, "look"), "distinct")
    members = hot_join(one.select("look", "vec_id"), reps.select("look", "rep", "n"), ["look"], ["vec_id"], "n", one.count())
    return reps.select("rep", "n", "hubs", "vector"), members.select("vec_id", "rep")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors held as bytes, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def search(
    reps: DataFrame, k: int, asked: DataFrame | None = None, probes: int | None = None, least: float | None = None, exact: bool = False,
    per_cell: int = CELL, most_centres: int = MOST_CENTRES, target: float = TARGET,
) -> DataFrame:
    """``rep, other, cosine``: up to ``k`` nearest distinct vectors of each of ``asked`` (default: all), itself left out.

    Centres and codebooks are fitted on a bounded sample on the driver; every vector is indexed in its nearest cell.
    Cells hold about ``per_cell`` vectors however many there are: beyond ``most_centres`` cells, and an eighth of the
    sample, each is parted by fine centres. A query visits its ``probes`` nearest cells. None: as many as hold the
    ``target`` share of the true neighbours of a fixed number of queries, which are compared with every vector for that.
    With ``exact`` it then visits every other cell that may hold a vector as near as its k-th so far (see ``_further``).
    Cells with many members or visitors are cut into parts of a fixed size, so no task holds an unbounded group.
    With ``least``, only pairs of at least that cosine. Cosines equal to six digits go by id.
    """
    spark = reps.sparkSession
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "rep long, other long, cosine double")
    raw = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow()["vector"]
    dims = len(raw[0].as_py())
    sample = _unit(np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in raw.chunks]).reshape(-1, dims))
    wanted = max(1, total // per_cell)
    coarse = int(np.clip(wanted, 1, min(most_centres, max(1, len(sample) // 8))))
    fine = int(np.clip(-(-wanted // coarse), 1, min(most_centres, max(1, len(sample) // 8))))
    quantiser = Quantiser.fit(sample, coarse, fine)
    coarse, fine = len(quantiser.centres), len(quantiser.fine)
    shared = spark.sparkContext.broadcast(quantiser)  # at most 2 x 2048 centres and 4 KB of codewords

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                code = pack(z.encode(x))
                cell, inner = z.cells(x)
                near = np.einsum("nd,nd->n", _double(x), _double(z.centres)[cell])
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep"), pa.array(cell, pa.int32()), pa.array(inner, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near, pa.float64())],
                    names=["rep", "cell", "fine", "code", "unit", "near"],
                )

    members = materialise(reps.select("rep", "vector").mapInArrow(index, "rep long, cell int, fine int, code binary, unit binary, near double"), "cells")
    own = members if asked is None else members.join(asked.select("rep"), "rep", "left_semi")
    visits = min(probes if probes else _tuned(members, own, quantiser, k, least, target), coarse * fine)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("unit"), dims)
            step = max(1, 4_000_000 // (visits * fine))
            for i in range(0, len(x), step):
                cell, inner = z.order(x[i : i + step], visits)
                take = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]) + i)
                yield pa.RecordBatch.from_arrays([b.column("rep").take(take), pa.array(cell.reshape(-1), pa.int32()), pa.array(inner.reshape(-1), pa.int32()), b.column("unit").take(take)], names=["rep", "cell", "fine", "unit"])

    queries = own.select("rep", "unit").mapInArrow(visit, "rep long, cell int, fine int, unit binary")
    asking = total if asked is None else own.count()
    visitors = F.lit(max(1, int(asking * visits // (coarse * fine * 8 * BLOCK))))
    queries = queries.withColumn("turn", F.pmod(F.xxhash64("rep"), visitors).cast("int"))
    placed = members.select("rep", "cell", "fine", "code", "unit")
    # Cells of more than a block's members, a row each, join on either side: few, and broadcast only if Spark finds them small.
    full = materialise(members.groupBy("cell", "fine").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cell", "fine", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "full")
    if full.isEmpty():
        placed, queries = placed.withColumn("part", F.lit(0)), queries.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        placed = placed.join(full, ["cell", "fine"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).drop("parts")
        queries = queries.join(full, ["cell", "fine"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), visitors - 1)))

    def meet(key: tuple, there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if there.empty or here.empty:
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        there = there.sort_values("rep")
        z = shared.value
        unit = lambda f: np.frombuffer(b"".join(f["unit"]), np.float32).reshape(-1, dims)
        packed = np.frombuffer(b"".join(there["code"]), np.uint8).reshape(-1, _SUBSPACES // 2)
        q, m, cosine = scan(z, z.centres[int(key[0])], packed, unit(there), unit(here), k + 1, least)
        a, b = here["rep"].to_numpy()[q], there["rep"].to_numpy()[m]
        keep = a != b
        return pd.DataFrame({"rep": a[keep], "other": b[keep], "cosine": cosine[keep].astype(float)})

    at = ["cell", "fine", "part", "turn"]
    met = placed.groupBy(*at).cogroup(queries.groupBy(*at)).applyInPandas(meet, "rep long, other long, cosine double")
    found = _closest(met, k)
    if not exact or visits == coarse * fine:
        return found
    found = materialise(found, "probed")
    counts, widest = np.zeros(coarse, np.int64), np.zeros(coarse)
    for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect():  # a row a coarse centre
        counts[r["cell"]], widest[r["cell"]] = r["n"], np.arccos(np.clip(r["near"], -1, 1))
    more = _further(members, own.select("rep", "unit"), found, quantiser.centres, counts, widest, k, least)
    return found if more is None else _closest(found.unionByName(more).groupBy("rep", "other").agg(F.max("cosine").alias("cosine")), k)


def _tuned(members: DataFrame, own: DataFrame, quantiser: Quantiser, k: int, least: float | None, target: float) -> int:
    """How many cells hold the ``target`` share of the true nearest of :data:`TUNED_BY` of the queries, chosen by a hash.

    Each of these is compared with every vector, in one pass that leaves ``k`` rows a query and task. If more than
    :data:`MOST_TRIED` cells are needed, that many are visited and a warning says which share they hold.
    """
    dims = quantiser.centres.shape[1]
    rows = own.orderBy(F.xxhash64("rep", F.lit(2)), "rep").limit(TUNED_BY).select("rep", "unit").toArrow()
    if not rows.num_rows:
        return 1
    ids, queries = rows["rep"].to_numpy(), _matrix(rows["unit"], dims)
    shared = members.sparkSession.sparkContext.broadcast((ids, queries))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        score, cell, fine = np.full((len(ids), k), -2, np.float32), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own_score = queries @ _matrix(b.column("unit"), dims).T
            own_score[ids[:, None] == b.column("rep").to_numpy()[None, :]] = -2
            top = np.argpartition(-own_score, min(k, own_score.shape[1]) - 1, axis=1)[:, :k]
            each = lambda name: b.column(name).to_numpy()[top]  # noqa: E731, B023
            score, cell, fine = np.concatenate([score, np.take_along_axis(own_score, top, 1)], 1), np.concatenate([cell, each("cell")], 1), np.concatenate([fine, each("fine")], 1)
            keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, cell, fine = (np.take_along_axis(x, keep, 1) for x in (score, cell, fine))
        at = np.repeat(np.arange(len(ids)), k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(x.reshape(-1), t) for x, t in ((score, pa.float32()), (cell, pa.int32()), (fine, pa.int32())))], names=["q", "score", "cell", "fine"])

    every = members.select("rep", "cell", "fine", "unit").mapInArrow(best, "q int, score float, cell int, fine int").where(F.col("score") >= F.lit(-1.5 if least is None else float(least)))
    true = every.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k).select("q", "cell", "fine").toArrow()  # k rows a query
    if not true.num_rows:
        return 1
    q, cell, fine = (true[c].to_numpy() for c in ("q", "cell", "fine"))
    coarse, inner = quantiser.order(queries, MOST_TRIED)
    hit = (coarse[q] == cell[:, None]) & (inner[q] == fine[:, None])
    place = np.where(hit.any(1), hit.argmax(1), MOST_TRIED)
    need = int(np.sort(place)[max(0, int(np.ceil(target * len(place))) - 1)]) + 1
    if need > MOST_TRIED:
        warnings.warn(f"{MOST_TRIED} cells hold {(place < MOST_TRIED).mean():.3f} of the nearest vectors", stacklevel=3)
    return min(need, MOST_TRIED)


def _closest(met: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.round("cosine", 6).desc(), "other"))
    return met.withColumn("place", best).where(F.col("place") <= k).drop("place")


def _further(members: DataFrame, asking: DataFrame, found: DataFrame, centres: np.ndarray, counts: np.ndarray, widest: np.ndarray, k: int, least: float | None) -> DataFrame | None:
    """``rep, other, cosine`` from the cells that may still hold one of the ``k`` nearest, however many they are.

    A cell is left out only if it cannot: if a query is further from its centre than the cell's widest member and the
    query's k-th cosine so far (``least``, if that is more or fewer were found) allow together. Cells are put together
    to rooms of a fixed size, so that a query travels once to a room and not to each cell; it is scored there exactly
    against the cells within its reach. None if no query has any such cell.
    """
    spark = members.sparkSession
    cells, dims = centres.shape
    parts = np.maximum(1, -(-counts // ROOM))
    first = np.zeros(cells, np.int64)
    rooms = held = 0  # the room being filled and its members
    for c in range(cells):
        if held and (parts[c] > 1 or held + counts[c] > ROOM):
            rooms, held = rooms + 1, 0
        first[c] = rooms
        rooms, held = (rooms + parts[c], 0) if parts[c] > 1 else (rooms, held + counts[c])
    many = int(rooms + 1)
    shared = spark.sparkContext.broadcast((_double(centres), np.where(counts > 0, widest, -9.0), parts, first))

    def reach(x: np.ndarray, floor: np.ndarray, c: np.ndarray, wide: np.ndarray) -> np.ndarray:
        far = np.arccos(np.clip(x @ c.T, -1, 1))
        return far - wide <= np.arccos(np.clip(floor - 2e-6, -1, 1))[:, None] + ANGLE_SLACK

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, wide, parts, first = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _double(np.frombuffer(b"".join(b.column("unit").to_pylist()), np.float32).reshape(-1, dims))
            floor = b.column("floor").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 2048):
                row, cell = np.nonzero(reach(x[i : i + 2048], floor[i : i + 2048], c, wide))
                times = parts[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pair = np.unique(np.repeat(row, times) * many + np.repeat(first[cell], times) + part)
                take = pa.array(pair // many + i)
                yield pa.RecordBatch.from_arrays([b.column("rep").take(take), pa.array(pair % many, pa.int32()), b.column("unit").take(take), b.column("floor").take(take)], names=["rep", "room", "unit", "floor"])

    floor = F.lit(-1.0 if least is None else float(least))
    sure = found.groupBy("rep").agg(F.min("cosine").alias("kth"), F.count("*").alias("n"))
    asking = asking.join(sure, "rep", "left").select("rep", "unit", F.when(F.col("n") >= k, F.greatest("kth", floor)).otherwise(floor).alias("floor"))
    guests = materialise(asking.mapInArrow(visit, "rep long, room int, unit binary, floor double"), "further")
    turns = np.zeros(many, np.int64)
    for r in guests.groupBy("room").count().collect():  # a row a room
        turns[r["room"]] = -(-r["count"] // GUESTS)
    if not turns.any():
        return None
    of = lambda values, at: F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)
    # not the hash that dealt members to the blocks
    dealt = F.xxhash64("rep", F.lit(1))
    guests = guests.withColumn("turn", F.pmod(dealt, of(turns, F.col("room"))).cast("int"))
    room = of(first, F.col("cell")) + F.pmod(dealt, of(parts, F.col("cell")))
    hosts = members.select("rep", "cell", "unit", room.cast("int").alias("room")).withColumn("turns", of(turns, F.col("room"))).where("turns > 0")
    hosts = hosts.select("rep", "cell", "unit", "room", F.explode(F.sequence(F.lit(0), F.col("turns").cast("int") - 1)).alias("turn"))

    def meet(key: tuple, there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        if there.empty or here.empty:
            return none
        c, wide, _, _ = shared.value
        there = there.sort_values(["cell", "rep"])
        unit = lambda f: np.frombuffer(b"".join(f["unit"]), np.float32).reshape(-1, dims)
        v, q, other, rep, least_ = unit(there), unit(here), there["rep"].to_numpy(), here["rep"].to_numpy(), here["floor"].to_numpy()
        held, begin = np.unique(there["cell"].to_numpy(), return_index=True)
        precise, seek = _double(v), _double(q)
        near = np.concatenate([reach(seek[i : i + 2048], least_[i : i + 2048], c[held], wide[held]) for i in range(0, len(q), 2048)])
        out = [none]
        for n, (start, stop) in enumerate(zip(begin, [*begin[1:], len(v)], strict=True)):
            who = np.flatnonzero(near[:, n])
            for a in range(start, stop, BLOCK):
                block = slice(a, min(a + BLOCK, stop))
                for i in range(0, len(who), 512):
                    w = who[i : i + 512]
                    open_ = q[w] @ v[block].T >= (least_[w, None] - 2e-6 - SLACK)
                    rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
                    if len(rows):
                        exact = seek[w[rows]] @ precise[block][cols].T
                        row, col = _top(exact, k + 1, least_[w[rows], None] - 2e-6)
                        out.append(pd.DataFrame({"rep": rep[w[rows[row]]], "other": other[block][cols[col]], "cosine": exact[row, col]}))
        met = pd.concat(out)
        return met[met["rep"] != met["other"]]

    return hosts.groupBy("room", "turn").cogroup(guests.groupBy("room", "turn")).applyInPandas(meet, "rep long, other long, cosine double")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squaring neither overflows nor vanishes
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbours(table: DataFrame, k: int = 5, asked: Column | None = None, least: float | None = None, exact: bool = False, dimensions: int = DIMENSIONS, **index: int | float | None) -> DataFrame:
    """``vec_id, other, cosine, place``: the ``k`` most similar others of each usable vector (``asked``: a condition
    on vec_id), nearest first, equals by id. ``index`` are parameters of :func:`search`.

    Vectors that are null, of another length than ``dimensions`` (a multiple of 16), all zero or not finite take no part;
    other columns are not read. Of a group of copies each member has the least other members as its neighbours, at
    cosine 1, and stands before others by its id; every vector reaches at most its ``k + 1`` least members, so copies
    are not expanded into all pairs. Without ``exact``, neighbours outside the cells visited are missed.
    """
    assert dimensions % _SUBSPACES == 0
    reps, members = distinct_vectors(table, k, dimensions)
    wanted = None
    if asked is not None:
        members = members.where(asked)
        wanted = members.select("rep").distinct()
    found = search(reps, k, wanted, least=least, exact=exact, **index)
    hubs = reps.select(F.col("rep").alias("other"), "hubs")
    wide = found.join(hubs, "other").select("rep", "cosine", F.explode("hubs").alias("to"))
    own = reps.where("n > 1").select("rep", F.lit(1.0).alias("cosine"), F.explode("hubs").alias("to"))
    # At most k * (k + 1) + k + 1 rows a vector, of which its copies each take the first k.
    near = wide.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.round("cosine", 6).desc(), "to"))).where(F.col("r") <= k + 1).drop("r")
    near = materialise(near.join(reps.select("rep", "n"), "rep"), "near")
    pairs = hot_join(members, near, ["rep"], ["vec_id"], "n", reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).where(F.col("vec_id") != F.col("to"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.round("cosine", 6).desc(), "to"))
    return pairs.select("vec_id", F.col("to").alias("other"), "cosine", place.alias("place")).where(F.col("place") <= k)


def similar_pairs(table: DataFrame, k: int = 5, least: float = 0.90, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_a, vec_b``: pairs of a cosine of at least ``least`` in which one is among the ``k`` most similar of the other.
    None is missed: cells are left out only where they can hold no such pair."""
    near = neighbours(table, k, least=least, exact=True, dimensions=dimensions, probes=PROBES).where(F.col("cosine") >= least)
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
