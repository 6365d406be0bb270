"""Approximate nearest neighbours by score-aware quantisation and four-bit table scans.

Vectors are brought to length 1, so that the largest inner product is the largest
cosine. A product quantiser with 16 centres for each pair of components (four bits)
is fitted with the anisotropic loss: the part of the residual parallel to the vector,
which moves its score, costs `eta` times as much as the part across it. Centres are
fitted on a sample of about `sample` rows chosen by hash (a documented bound), and so are
the middles of coarse cells, and the number of cells that a query looks into: so many that
they hold REACH of the nearest neighbours within the sample. Vectors that have no cells to
speak of get all of them.

The index is made once: every row is encoded, two codes to a byte, and written with its
residual's length, its cell and its vector into files by cell. Queries go to the
executors in blocks of bounded size, those of like cells together, and a block reads only
the folders of the cells that its queries look into. There a search adds table entries for the
codes, keeps the best `rerank` candidates of each batch of rows, and ranks these by the exact
cosine of the original vectors in double precision; so it does all further rows of the cell whose
table score plus the length of their residual reaches the k-th exact cosine. Nothing is
shuffled but the best few of each task and query. A hot cell is many files, each a task.

Nulls and edges: vectors that are null, zero, or hold null or non-finite components
take no part, as queries or as candidates; equal scores go to the smaller id; a query
meets every row but those with its own id; vectors of another length are no
candidates; repeated ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import Kept

#: Rows of vectors that are scanned together, and rows of the table and of the sample for each coarse cell.
ROWS, ROWS_A_CELL, SAMPLE_A_CELL = 8192, 1 << 16, 32
#: Share of the sample's nearest neighbours that the cells of a query are to hold.
REACH = 0.99
#: Parts that the rows of a cell are written from, so that a hot cell is no single task.
SALT = 8
#: More than the rounding of sums of table entries in single precision.
SLACK = 1e-3


class Quantiser:
    """Four-bit product quantiser under the anisotropic loss, for vectors of one length."""

    def __init__(self, dim: int, sub: int = 2, eta: float = 4.0, seed: int = 11):
        self.dim, self.sub, self.eta, self.seed = dim, sub, eta, seed
        self.parts = -(-dim // sub)
        self.parts += self.parts % 2  # two codes to a byte
        self.centres = np.zeros((self.parts, 16, sub))

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.sub))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.sub)

    def fit(self, x: np.ndarray, rounds: int = 8) -> Quantiser:
        """x: unit vectors. Lloyd steps with score-aware assignment and a weighted least-squares update."""
        rng, parts = np.random.default_rng(self.seed), self.split(x)
        for p in range(self.parts):
            self.centres[p] = parts[rng.choice(len(x), 16, replace=len(x) < 16), p] + rng.normal(0, 1e-6, (16, self.sub))
        for r in range(rounds):
            codes = self.encode(x, sweeps=0 if r < rounds // 2 else 1)
            for p in range(self.parts):
                # residual of the other parts along the vector, which this part may offset
                along = ((parts - self.decode(codes)) * parts).sum((1, 2)) - ((parts[:, p] - self.centres[p, codes[:, p]]) * parts[:, p]).sum(1)
                for c in range(16):
                    of = codes[:, p] == c
                    if not of.any():
                        self.centres[p, c] = parts[rng.integers(len(x)), p]
                        continue
                    y, a = parts[of, p], along[of] if r >= rounds // 2 else 0.0 * along[of]
                    left = of.sum() * np.eye(self.sub) + (self.eta - 1) * y.T @ y
                    right = y.sum(0) + (self.eta - 1) * ((a + (y * y).sum(1)) @ y)
                    self.centres[p, c] = np.linalg.solve(left, right)
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.parts), codes]

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A code for each part: nearest centres first, then sweeps of coordinate descent on the loss."""
        parts = self.split(x)
        codes = np.zeros((len(x), self.parts), np.int64)
        across = np.zeros((self.parts, len(x), 16))
        along = np.zeros((self.parts, len(x), 16))
        for p in range(self.parts):
            diff = parts[:, p, None, :] - self.centres[p]
            across[p] = (diff * diff).sum(2)
            along[p] = np.einsum("nks,ns->nk", diff, parts[:, p])
            codes[:, p] = across[p].argmin(1)
        rows = np.arange(len(x))
        total = sum(along[p][rows, codes[:, p]] for p in range(self.parts))
        for _ in range(sweeps):
            for p in range(self.parts):
                rest = total - along[p][rows, codes[:, p]]
                loss = across[p] + (self.eta - 1) * (rest[:, None] + along[p]) ** 2
                codes[:, p] = loss.argmin(1)
                total = rest + along[p][rows, codes[:, p]]
        return codes

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts / 2, rows) bytes, two codes in each; lengths of the residuals."""
        codes = self.encode(x)
        residual = np.sqrt(((self.split(x) - self.decode(codes)) ** 2).sum((1, 2)))
        codes = codes.astype(np.uint8)
        return np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T), residual

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts / 2, 256) scores of each byte of two codes."""
        t = np.einsum("qps,pks->qpk", self.split(q), self.centres).astype(np.float32)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.parts // 2, 256)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with the same row of x, in double precision."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


class Cells:
    """Coarse cells of unit vectors of one length: their middles, and how many of them a query looks into."""

    def __init__(self, x: np.ndarray, k: int, most: int, seed: int = 11, rounds: int = 10):
        n = max(1, min(most, len(x) // SAMPLE_A_CELL))
        rng = np.random.default_rng(seed)
        self.middles = x[rng.choice(len(x), n, replace=False)]
        for _ in range(rounds):
            of = (x @ self.middles.T).argmax(1)
            sums = np.zeros_like(self.middles)
            np.add.at(sums, of, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            self.middles = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), self.middles)
        self.look = n
        asked = x[rng.choice(len(x), min(len(x), 512), replace=False)]
        if n > 1 and len(x) > k + 1:
            near = np.argpartition(-(asked @ x.T), k, axis=1)[:, : k + 1]  # a query itself is among them
            place = np.argsort(np.argsort(-(asked @ self.middles.T), axis=1), axis=1)
            ranks = np.take_along_axis(place, (x @ self.middles.T).argmax(1)[near], 1)
            self.look = min(n, int(np.quantile(ranks, REACH, method="higher")) + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.middles.T).argmax(1)

    def near(self, q: np.ndarray) -> np.ndarray:
        """(queries x cells) which cells each query looks into."""
        s = q @ self.middles.T
        return s >= -np.partition(-s, self.look - 1, axis=1)[:, self.look - 1 : self.look]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, sample: int = 8192, k: int = 5, rows_a_cell: int = ROWS_A_CELL, **options) -> dict[int, tuple[Quantiser, Cells]]:
    """A quantiser and cells for each length of vector, from about `sample` rows in all."""
    n = vectors.count()
    if not n:
        return {}
    some = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / n)) if n > sample else vectors
    by: dict[int, list[np.ndarray]] = {}
    for r in some.collect():  # bounded by the sample
        by.setdefault(len(r.v), []).append(np.array(r.v))
    out = {}
    for d, rows in by.items():
        x = unit(np.unique(np.stack(rows), axis=0))
        out[d] = Quantiser(d, **options).fit(x), Cells(x, k, n // rows_a_cell)
    return out


#: Cell of the rows of a length that is not in the sample; all queries of that length look into it.
REST = -1


class Index:
    """Every row of the vectors with its codes, in files by the length of the vectors and cell."""

    def __init__(self, data: DataFrame, sample: int = 8192, k: int = 5, **options):
        spark = data.sparkSession
        self.k, self.model = k, spark.sparkContext.broadcast(fit(data, sample, k, **options))
        rows = data.mapInArrow(lambda batches: _encoded(batches, self.model.value), "dim int, cell int, id long, codes binary, residual double, v array<double>")
        dealt = rows.repartition("dim", "cell", F.pmod(F.xxhash64("id"), F.lit(SALT)))
        self.kept = Kept(dealt, "index", by=["dim", "cell"])

    def _near(self, rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of the vectors: places of the queries of that length, and (queries x cells) the cells that they look into."""
        lens, out = np.array([len(r) for r in rows]), {}
        for d in map(int, np.unique(lens)):
            at = np.flatnonzero(lens == d)
            known = d in self.model.value
            out[d] = at, self.model.value[d][1].near(unit(np.stack([rows[i] for i in at]))) if known else np.ones((len(at), 1), bool)
        return out

    def _dealt(self, queries: DataFrame) -> tuple[DataFrame, list]:
        """Many queries with their own cells, and the conditions that deal them to blocks: those of like cells together."""
        model = self.model

        def run(batches):
            for batch in batches:
                for places, x in V.matrix(batch.column(1)):
                    cell = model.value[x.shape[1]][1].of(unit(x)) if x.shape[1] in model.value else np.full(len(x), REST)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(places)) for c in batch.columns), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(cell.astype(np.int32))], ["id", "v", "dim", "cell"])

        kept = Kept(queries.mapInArrow(run, "id long, v array<double>, dim int, cell int"), "queries").df
        out, open_, size = [], F.lit(False), 0
        for r in kept.groupBy("dim", "cell").count().orderBy("dim", "cell").collect():  # bounded by the cells
            here, parts = (F.col("dim") == r.dim) & (F.col("cell") == r.cell), -(-r["count"] // V.QUERIES_A_PASS)
            if parts > 1:
                out += [here & (F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == i) for i in range(parts)]
                continue
            if size + r["count"] > V.QUERIES_A_PASS:
                out.append(open_)
                open_, size = F.lit(False), 0
            open_, size = open_ | here, size + r["count"]
        return kept, [*out, open_] if size else out

    def search(self, queries: DataFrame, rerank: int = 64) -> DataFrame:
        """(query_id, rank, vec_id, score) of clean queries (id, v)."""
        spark = queries.sparkSession

        def answer(ids: np.ndarray, rows: list[np.ndarray]):
            near = self._near(rows)
            block, k, model = spark.sparkContext.broadcast((ids, rows, near)), self.k, self.model
            wanted = F.lit(False)
            for d, (_, cells) in near.items():
                wanted |= (F.col("dim") == d) & F.col("cell").isin([*np.flatnonzero(cells.any(0)).tolist(), REST])
            found = self.kept.df.where(wanted).select("dim", "cell", "id", "codes", "residual", "v")
            return found.mapInArrow(lambda batches: _scan(batches, model.value, *block.value, k, rerank), "query_id long, query_at int, vec_id long, score double"), [block]

        return V.passes(queries, answer, self.k, "double", self._dealt)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: int = 64, sample: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query that were found."""
    data, asked = V.clean(vectors, id_col, vec_col, nonzero=True), V.clean(queries, id_col, vec_col, nonzero=True)
    return Index(data, sample, k, **options).search(asked, rerank)


def _encoded(batches, model):
    for batch in V.rebatch(batches, ROWS):
        ids = batch.column(0)
        for places, x in V.matrix(batch.column(1)):
            quantiser, cells = model.get(x.shape[1], (None, None))
            n = len(x)
            dim = pa.array(np.full(n, x.shape[1], np.int32))
            if quantiser is None:
                cell, codes, residual = np.full(n, REST), [b""] * n, np.zeros(n)
            else:
                u = unit(x)
                packed, residual = quantiser.packed(u)
                cell, codes = cells.of(u), [r.tobytes() for r in np.ascontiguousarray(packed.T)]
            taken = pa.array(places)
            yield pa.RecordBatch.from_arrays([dim, pa.array(cell.astype(np.int32)), ids.take(taken), pa.array(codes, pa.binary()), pa.array(residual), batch.column(1).take(taken)], ["dim", "cell", "id", "codes", "residual", "v"])


def _scan(batches, model, ids, rows, near, k, rerank):
    held = {}
    for d, (at, cells) in near.items():
        q = np.stack([rows[i] for i in at])
        held[d] = at, q, unit(q), cells
    best = V.Best(len(ids), k, float)
    for batch in V.rebatch(batches, ROWS):
        dim, cell = (batch.column(i).to_numpy() for i in (0, 1))
        for d, c in np.unique(np.stack([dim, cell]), axis=1).T.tolist():
            at, q, unit_q, cells = held[d]
            own = np.flatnonzero(cells[:, c]) if c != REST else np.arange(len(at))
            if not len(own):
                continue
            rows_of = batch.take(pa.array(np.flatnonzero((dim == d) & (cell == c))))
            vec_ids, residual = rows_of.column(2).to_numpy(), rows_of.column(4).to_numpy()
            x = V.matrix(rows_of.column(5))[0][1]
            quantiser = model[d][0] if d in model else None
            codes = np.frombuffer(b"".join(rows_of.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
            order = np.argsort(vec_ids, kind="stable")
            for start in range(0, len(x), ROWS):
                part = order[start : start + ROWS]
                _scan_block(best, vec_ids[part], x[part], np.ascontiguousarray(codes[part].T), residual[part], quantiser, ids, at[own], q[own], unit_q[own], rerank)
    yield best.rows(ids)


def _scan_block(best, vec_ids, x, codes, residual, quantiser, ids, at, q, unit_q, rerank):
    """Rows by rising ids against some queries."""
    for start in range(0, len(at), 64):
        own, part = at[start : start + 64], slice(start, start + 64)
        if not quantiser:  # no row of this length was in the sample: all are candidates
            cand = np.tile(np.arange(len(x)), (len(own), 1))
        else:
            tables = quantiser.tables(unit_q[part])
            scores = np.zeros((len(own), len(x)), np.float32)
            for b in range(len(codes)):
                scores += tables[:, b][:, codes[b]]
            cand = V.top(scores, vec_ids, rerank)
        n = cand.shape[1]
        exact = cosines(np.repeat(q[part], n, axis=0), x[cand.ravel()]).reshape(cand.shape)
        found = vec_ids[cand]
        best.add(own, exact, found, (found != ids[own][:, None]) & np.isfinite(exact))
        if not quantiser or n == len(x):
            continue
        # all others that may reach the k-th: a score is off by the length of the residual at most
        reach = scores + residual >= best.score[own, -1:] - SLACK
        np.put_along_axis(reach, cand, False, 1)
        for i in np.flatnonzero(reach.any(1)):
            rows = np.flatnonzero(reach[i])
            exact = cosines(q[start + i][None, :], x[rows])
            ok = (vec_ids[rows] != ids[own[i]]) & np.isfinite(exact)
            first = np.lexsort((vec_ids[rows], -exact, ~ok))[: best.k]
            best.add(own[[i]], exact[first][None, :], vec_ids[rows[first]][None, :], ok[first][None, :])
