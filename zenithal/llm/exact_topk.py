"""Exact top-k search by a three-phase uniform threshold over fragments of the vectors.

Vectors of integers floor(256 x) are held in `fragments` runs of components; each
fragment gives every row a local score for a query, and the score is their sum.
Phase 1 gathers, for each query and fragment, the k best local scores and the least
one, over all rows. What a row lacks counts as the fragment's least score, so the
k-th best of the partial sums, tau, is a score that k rows surely reach. Phase 2 sends
out the cutoff: with local scores counted from the least, a row of score tau or more
has some local score of at least (tau - sum of the least scores) / fragments. It goes
fragment by fragment, the one with the widest scores first; a pair of a query and a row
falls away as soon as its scores so far and the best that the fragments to come have
anywhere stay under tau, or as soon as no fragment to come can hold the entry that it lacks.
Fragments that the cutoff leaves open are read for the remaining pairs alone. Phase 3 resolves
those that are left after all fragments exactly; tau rises with the k-th score found.

Queries go out in blocks of bounded size, each with two passes over the vectors;
only the best few of each task are shuffled, and one block at a time is at the driver.

Nulls and edges: vectors that are null or hold null or non-finite components take no
part; a zero vector does; equal scores go to the smaller id; a query meets every row
but those with its own id; vectors of another length are no candidates; sums beyond
the exact range of doubles are made with integers, and scores beyond 64 bits are held at
the nearest long.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import Kept

ROWS = 8192


_END = (1 << 63) - 1


def _long(v) -> int:
    """An integer as a long; beyond 64 bits, the nearest long."""
    return max(-_END - 1, min(_END, int(v)))


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def _cuts(dim: int, fragments: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), fragments)


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers as doubles where their products' sums are exact, else as integers."""
    big = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(x).max(initial=0)), 1.0) * q.shape[1]
    return (q, x) if big < 2**53 else tuple(np.frompyfunc(int, 1, 1)(m) for m in (q, x))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, fragments: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query."""
    spark = vectors.sparkSession
    data, asked = V.clean(vectors, id_col, vec_col), V.clean(queries, id_col, vec_col)

    def answer(ids: np.ndarray, rows: list[np.ndarray]):
        block = spark.sparkContext.broadcast((ids, [integers(r) for r in rows]))
        cutoffs = spark.sparkContext.broadcast(_cutoffs(data, block, len(ids), k, fragments))
        return data.mapInArrow(lambda b: _resolved(b, *block.value, cutoffs.value, k, fragments), "query_id long, query_at int, vec_id long, score long"), [block, cutoffs]

    return V.passes(asked, answer, k, "long")


def _blocks(batches, ids, rows, work):
    lens = np.array([len(r) for r in rows])
    held = {int(d): np.flatnonzero(lens == d) for d in np.unique(lens)}
    matrices = {d: np.stack([rows[i] for i in at]) for d, at in held.items()}
    for batch in V.rebatch(batches, ROWS):
        vec_ids = batch.column(0).to_numpy()
        for places, x in V.matrix(batch.column(1)):
            if (d := x.shape[1]) not in held:
                continue
            order = places[np.argsort(vec_ids[places], kind="stable")]
            x = integers(x[np.argsort(vec_ids[places], kind="stable")])
            for a in range(0, len(x), ROWS):
                for b in range(0, len(held[d]), 64):
                    own = held[d][b : b + 64]
                    yield work(ids, own, matrices[d][b : b + 64], vec_ids[order[a : a + ROWS]], x[a : a + ROWS])


def _cutoffs(data: DataFrame, block, n: int, k: int, fragments: int) -> list[tuple[int, list[int], list[int]] | None]:
    """Phase 1: for each query of the block tau, and the least and the best local score of each fragment."""

    def gather(batches):
        ids, rows = block.value
        best, least = V.Best(n * fragments, k, np.int64), np.full(n * fragments, _END, np.int64)

        def work(ids, own, q, vec_ids, x):
            wide = np.frompyfunc(_long, 1, 1)
            a, b = _exact(q, x)
            crc = np.array([zlib.crc32(r.tobytes()) for r in x], np.int64)
            mine = vec_ids[None, :] == ids[own][:, None]
            for f, c in enumerate(_cuts(q.shape[1], fragments)):
                s = a[:, c] @ b[:, c].T
                plain = s.dtype != object
                s = (s if plain else wide(s)).astype(np.int64)
                order = V.top(np.where(mine, -np.inf, s.astype(float)), vec_ids, min(k, s.shape[1]))[:, :k] if plain else np.argsort(~s, axis=1, kind="stable")
                at = own * fragments + f
                best.add(at, np.take_along_axis(s, order, 1), vec_ids[order], ~np.take_along_axis(mine, order, 1), crc[order])
                least[at] = np.minimum(least[at], s.min(1))

        for _ in _blocks(batches, ids, rows, work):
            pass
        q, j = np.nonzero(best.ok)
        arrays = [(q // fragments).astype(np.int32), (q % fragments).astype(np.int32), best.vec[q, j], best.row[q, j], best.score[q, j], least[q]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_at", "fragment", "vec_id", "row", "score", "least"])

    kept = Kept(data.mapInArrow(gather, "query_at int, fragment int, vec_id long, row long, score long, least long"), "lists")
    lists = kept.df
    # the k best of each list over all tasks; bounded by queries x fragments x k
    w = Window.partitionBy("query_at", "fragment").orderBy(F.desc("score"), "vec_id", "row")
    ends = {(r.query_at, r.fragment): (r.low, r.high) for r in lists.groupBy("query_at", "fragment").agg(F.min("least").alias("low"), F.max("score").alias("high")).collect()}
    seen: dict[int, dict[tuple[int, int], dict[int, int]]] = {}
    for r in lists.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect():
        seen.setdefault(r.query_at, {}).setdefault((r.vec_id, r.row), {})[r.fragment] = r.score  # rows that are equal count once
    kept.drop()
    out: list = [None] * n
    for at, rows in seen.items():
        low, high = ([ends.get((at, f), (0, 0))[i] for f in range(fragments)] for i in (0, 1))
        sums = sorted((sum(have.get(f, low[f]) for f in range(fragments)) for have in rows.values()), reverse=True)
        # scores beyond 64 bits bound nothing
        wild = any(abs(v) >= _END for v in (*low, *high, *(s for have in rows.values() for s in have.values())))
        out[at] = (sums[k - 1] if len(sums) >= k and not wild else None, low, high)
    return out


def _resolved(batches, ids, rows, cutoffs, k, fragments):
    best = V.Best(len(ids), k, np.int64)
    for _ in _blocks(batches, ids, rows, lambda *block: _resolve(best, *block, cutoffs, k, fragments)):
        pass
    yield best.rows(ids)


#: Below this share of pairs that are open, a fragment is read for each pair and not for all.
FEW = 1 / 16


def _resolve(best, ids, own, q, vec_ids, x, cutoffs, k, fragments):
    """Phases 2 and 3 over one block of rows."""
    own, q = (a[[i for i, at in enumerate(own) if cutoffs[at] is not None]] for a in (own, q))
    if not len(own):
        return
    a, b = _exact(q, x)
    cuts = _cuts(q.shape[1], fragments)
    open_ = vec_ids[None, :] != ids[own][:, None]
    if a.dtype == object:  # beyond the exact range of doubles nothing is bounded
        score = a @ b.T
        for i, at in enumerate(own):
            left = np.flatnonzero(open_[i])
            left = left[sorted(range(len(left)), key=lambda j, e=score[i][left]: (-e[j], j))[:k]]
            best.add(np.array([at]), np.array([[_long(v) for v in score[i][left]]], np.int64).reshape(1, -1), vec_ids[left][None, :])
        return
    low, high = (np.array([cutoffs[at][i] for at in own], float) for i in (1, 2))
    tau = np.array([-np.inf if cutoffs[at][0] is None else cutoffs[at][0] for at in own], float)
    known = best.ok[own, -1]  # k rows that this task has resolved raise the bound
    tau = np.where(known, np.maximum(tau, best.score[own, -1]), tau)
    cut = np.ceil((tau - low.sum(1)) / fragments)
    order = np.argsort(-(high - low).sum(0), kind="stable")
    rest, score, entry = high.sum(1), np.zeros(open_.shape), np.zeros(open_.shape, bool)
    for n, f in enumerate(order):
        c = cuts[f]
        rest = rest - high[:, f]
        if n and open_.mean() < FEW:
            i, j = np.nonzero(open_)
            s = np.einsum("nd,nd->n", a[i][:, c], b[j][:, c])
            score[i, j] += s
            entry[i, j] |= s - low[i, f] >= cut[i]
            stays = score[i, j] + rest[i] >= tau[i]
            if n == fragments - 1:
                stays &= entry[i, j] | (cut[i] <= 0)
            open_[i[~stays], j[~stays]] = False
            continue
        rows = np.flatnonzero(open_.any(0))
        s = a[:, c] @ b[rows][:, c].T
        score[:, rows] += s
        entry[:, rows] |= s - low[:, [f]] >= cut[:, None]
        stays = score[:, rows] + rest[:, None] >= tau[:, None]
        if n == fragments - 1:
            stays &= entry[:, rows] | (cut <= 0)[:, None]
        open_[:, rows] &= stays
    for i in np.flatnonzero(open_.any(1)):
        left = np.flatnonzero(open_[i])
        first = np.lexsort((left, -score[i, left]))[:k]
        best.add(own[[i]], score[i, left[first]].astype(np.int64)[None, :], vec_ids[left[first]][None, :])
