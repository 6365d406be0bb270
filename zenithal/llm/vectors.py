"""What the two vector searches share: clean vectors, bounded blocks of queries, best-k merges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, ship

#: Queries that one pass over the vectors answers; bounds what is broadcast.
QUERIES_A_PASS = 16384


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(id, v) without null ids and without vectors that are null, empty or hold null or non-finite components (or, if asked, are zero)."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(ok & F.exists("v", lambda x: x != 0) if nonzero else ok, F.lit(False)))


def rebatch(batches, rows: int):
    """The same rows in batches of at least `rows`, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def matrix(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a list column, by length of the lists."""
    lens = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False))
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lens)
    out = []
    for d in np.unique(lens):
        at = np.flatnonzero(lens == d)
        out.append((at, values[(ends[at] - d)[:, None] + np.arange(d)]))
    return out


def by_hash(queries: DataFrame) -> tuple[DataFrame, list]:
    """The queries, and conditions that deal them to blocks."""
    blocks = -(-queries.count() // QUERIES_A_PASS)
    return queries, [F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == i for i in range(blocks)]


def passes(queries: DataFrame, answer: Callable, k: int, kind: str, deal: Callable = by_hash) -> DataFrame:
    """The k best rows of each query: answer(ids, rows) gives those of a block of about QUERIES_A_PASS queries, and the broadcasts behind them.

    Only one block at a time is at the driver: where there are several, the answer to each is written before the next one comes.
    """
    spark = queries.sparkSession

    def block(part: DataFrame):
        rows = sorted(part.select("id", "v").collect(), key=lambda r: r.id)
        if not rows:
            return None, []
        found, held = answer(np.array([r.id for r in rows], np.int64), [np.array(r.v, np.float64) for r in rows])
        return best(found, k), held

    if queries.count() <= QUERIES_A_PASS:
        found, _ = block(queries)
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}") if found is None else found
    queries, conditions = deal(queries)
    kept = []
    for condition in conditions:
        found, held = block(queries.where(condition))
        if found is not None:
            kept.append(Kept(found, "nearest"))
        for b in held:
            b.destroy()
    return spark.read.schema(kept[0].df.schema).parquet(*[x.path for x in kept])


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, ties to the smaller id."""
    w = Window.partitionBy("query_id", "query_at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The k best rows so far of each query of a block, within one task: what is shuffled grows with the tasks, not the rows."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.kind = k, kind
        self.score = np.full((queries, k), -np.inf if kind is float else np.iinfo(np.int64).min, kind)
        self.vec, self.row, self.ok = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64), np.zeros((queries, k), bool)

    def add(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray, ok: np.ndarray | None = None, row: np.ndarray | None = None) -> None:
        """Candidates (queries at x any number), of which those that are ok count; row tells rows of one id apart."""
        ok = np.ones(vec.shape, bool) if ok is None else ok
        row = np.zeros_like(vec) if row is None else row
        score, vec, row, ok = (np.concatenate([a[at], b], axis=1) for a, b in ((self.score, score), (self.vec, vec), (self.row, row), (self.ok, ok)))
        order = np.lexsort((row, vec, -score if self.kind is float else ~score, ~ok), axis=1)[:, : self.k]
        self.score[at], self.vec[at], self.row[at], self.ok[at] = (np.take_along_axis(a, order, 1) for a in (score, vec, row, ok))

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        q, j = np.nonzero(self.ok)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(q.astype(np.int32)), pa.array(self.vec[q, j]), pa.array(self.score[q, j])], ["query_id", "query_at", "vec_id", "score"])


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row (fewer columns: all), ties to the smaller id; ids ascend."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    # everything above the k-th value, then the smallest ids among its equals
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    rows, cols = np.nonzero(scores >= kth)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    return cols[first[:, None] + np.arange(k)]
