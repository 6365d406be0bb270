"""Synthetic catalogs from a small one: copy triangles of the hierarchical mesh over a region, or shift rows.

To fill a target triangle T, rows of a source triangle S (T itself if it has rows, else
one chosen by a hash) move by the matrix that takes the corners of S to those of T. A
key becomes T in the upper 32 bits and the key's rank within S in the lower ones; foreign
keys follow by the same ranks. The list of triangles is bounded by the level of the mesh.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spherical as S
from .chunker import Chunker

_MIX = 0x9E3779B97F4A7C15
#: Ranges of keys that are ranked apart.
RANGES = 64


def corners(htm: int) -> np.ndarray:
    """The corners of a triangle, as rows."""
    level = S.htm_level(htm)
    v = np.array(S.HTM_ROOTS[htm >> 2 * level])
    for k in range(level - 1, -1, -1):
        mid = lambda a, b: (a + b) / np.linalg.norm(a + b)
        w0, w1, w2 = mid(v[1], v[2]), mid(v[2], v[0]), mid(v[0], v[1])
        v = np.array([(v[0], w2, w1), (v[1], w0, w2), (v[2], w1, w0), (w0, w1, w2)][(htm >> 2 * k) & 3])
    return v


def triangles(level: int, box: tuple[float, float, float, float]) -> list[int]:
    """Triangles of a level that a box in longitude and latitude may touch: those whose circle of corners does."""
    out, stack = [], list(S.HTM_ROOTS)
    while stack:
        t = stack.pop()
        v = corners(t)
        c = v.sum(0) / np.linalg.norm(v.sum(0))
        r = np.degrees(np.arccos(np.clip((v @ c).min(), -1, 1)))
        lon, lat = np.degrees(np.arctan2(c[1], c[0])) % 360, np.degrees(np.arcsin(c[2]))
        half = S.max_alpha(min(r, 90.0), lat)
        span = (box[2] - box[0]) % 360 or 360.0 * (box[2] != box[0])
        mid = (box[0] + span / 2) % 360
        gap = abs((lon - mid + 180) % 360 - 180)
        if lat + r < box[1] or lat - r > box[3] or (half < 180 and gap > span / 2 + half):
            continue
        if S.htm_level(t) == level:
            out.append(t)
        else:
            stack += [4 * t + k for k in range(4)]
    return sorted(out)


def sources(targets: list[int], filled: list[int]) -> dict[int, int]:
    """The source triangle of each target."""
    have, order = set(filled), sorted(filled)
    return {t: t if t in have else order[(t * _MIX & (1 << 64) - 1) % len(order)] for t in targets} if order else {}


def key_ranks(director: DataFrame, key: str, lon: str, lat: str, level: int) -> DataFrame:
    """(key, source, rank): a director's keys with their triangle and their rank in it."""
    return _ranked(director.select(F.col(key).alias("key"), S.htm_id(F.col(lon), F.col(lat), level).alias("source")))


def child_ranks(child: DataFrame, own: str, key: str, ranks: DataFrame) -> DataFrame:
    """(key, source, rank): a child's own keys with the triangle of their director (by its key) and their rank in it."""
    of = ranks.select(F.col("key").alias("_key"), "source")
    return _ranked(child.select(F.col(own).alias("key"), F.col(key).alias("_key")).join(of, "_key").select("key", "source"))


def _ranked(at: DataFrame) -> DataFrame:
    """(key, source) with the key's rank in its source.

    Keys are cut into RANGES ranges of about as many rows; the rank counts the rows of lower
    ranges, and within a range a window does, so that a dense triangle is the work of many tasks.
    """
    cuts = at.where("source IS NOT NULL").agg(F.percentile_approx(F.col("key").cast("double"), [k / RANGES for k in range(1, RANGES)], 10000)).first()[0] or []
    at = at.where("source IS NOT NULL").withColumn("range", F.size(F.filter(F.lit(np.array(sorted(set(cuts)), float)), lambda c: c < F.col("key"))) if cuts else F.lit(0))
    counts = at.groupBy("source", "range").agg(F.count("*").alias("n"))
    lower = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source", "range", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "range").orderBy("key")) - 1
    return at.withColumn("rank", within).join(before, ["source", "range"]).select("key", "source", (F.col("before") + F.col("rank")).alias("rank"))


def sampled(fraction: float, seed: int, *by: Column) -> Column:
    """Whether a row belongs to a sample, by a hash of the seed and some columns: the same rows each time."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in by])), 1, 8), 16, 10).cast("long")
    return hashed < int(fraction * (1 << 32))


def duplicate(
    df: DataFrame, key: str, lon: str, lat: str, ranks: DataFrame, level: int, box: tuple[float, float, float, float], own: str | None = None, own_ranks: DataFrame | None = None, fraction: float = 1.0, seed: int = 0
) -> DataFrame:
    """Rows of a director (or of a child, by its foreign key) copied over a region; keys and position are made anew.

    ranks: `key_ranks` of the director; own, own_ranks: a child's own key and its `child_ranks`.
    fraction, seed: keep a sample of the copies, chosen by the director's new key, so that children
    stay with their directors.
    """
    spark = df.sparkSession
    filled = [r.source for r in ranks.select("source").distinct().collect()]  # at most 8 * 4 ** level
    rows = []
    for t, s in sources(triangles(level, box), filled).items():
        m = corners(t).T @ np.linalg.inv(corners(s).T)
        rows.append((s, t, [float(x) for x in m.ravel()]))
    moves = spark.createDataFrame(rows, "source long, target long, m array<double>")
    at = ranks.select(F.col("key").alias("_key"), F.col("source").alias("_source"), F.col("rank").alias("_rank"))
    joined = df.join(at, F.col(key) == F.col("_key")).join(moves.select(F.col("source").alias("_source"), F.col("target").alias("_target"), F.col("m").alias("_m")), "_source")
    x, y, z = S.unit_vector(F.col(lon), F.col(lat))
    p, q, r = (F.col("_m")[3 * i] * x + F.col("_m")[3 * i + 1] * y + F.col("_m")[3 * i + 2] * z for i in range(3))
    made = {key: F.shiftleft(F.col("_target"), 32) + F.col("_rank"), lon: S.lon_of(p, q), lat: S.lat_of(p, q, r)}
    if fraction < 1:
        joined = joined.where(sampled(fraction, seed, made[key]))
    if own is not None:
        joined = joined.join(own_ranks.select(F.col("key").alias("_own"), F.col("rank").alias("_own_rank")), F.col(own) == F.col("_own"))
        made[own] = F.shiftleft(F.col("_target"), 32) + F.col("_own_rank")
    return joined.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def shift(df: DataFrame, keys: list[str], lon: str, by: float, key_offset: int) -> DataFrame:
    """The rows moved in longitude, their keys (primary and foreign) moved by an offset."""
    made = {lon: S.reduce_lon(F.col(lon) + by)} | {k: F.col(k) + F.lit(key_offset) for k in keys}
    return df.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def estimate(ranks: DataFrame, chunker: Chunker, level: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(chunkId, n_rows): estimated sizes of the chunks of a duplication, by the centres of its triangles."""
    counts = {r.source: r.n for r in ranks.groupBy("source").agg(F.count("*").alias("n")).collect()}
    total: dict[int, int] = {}
    for t, s in sources(triangles(level, box), list(counts)).items():
        c = corners(t).sum(0)
        lon, lat = np.degrees(np.arctan2(c[1], c[0])) % 360, np.degrees(np.arctan2(c[2], np.hypot(c[0], c[1])))
        chunk = chunker.locate(float(lon), float(lat))[0]
        total[chunk] = total.get(chunk, 0) + counts[s]
    return ranks.sparkSession.createDataFrame(sorted(total.items()), "chunkId int, n_rows long")
