"""Partitioning tools as dataflows: home and overlap rows, indexes, matches, statistics, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spherical as S
from .chunker import Chunker

#: Flags of a match row: only its first, only its second, or both positions lie in the chunk.
LEFT, RIGHT, BOTH = 1, 2, 3
_EPSILON = 0.001


def locate(df: DataFrame, chunker: Chunker, lon: str, lat: str) -> DataFrame:
    """The rows with chunkId and subChunkId."""
    chunk, sub = chunker.columns(F.col(lon), F.col(lat))
    return df.withColumns({"chunkId": chunk, "subChunkId": sub})


def with_overlap(df: DataFrame, chunker: Chunker, lon: str, lat: str) -> DataFrame:
    """Home rows, and a copy for each other cell whose overlap region holds the row (column overlap)."""
    chunk, sub = chunker.columns(F.col(lon), F.col(lat))
    none = F.array().cast("array<struct<chunkId:int,subChunkId:int,overlap:boolean>>")
    home = F.array(F.struct(chunk.alias("chunkId"), sub.alias("subChunkId"), F.lit(False).alias("overlap")))
    halo = F.transform(chunker.overlap_cells(F.col(lon), F.col(lat)), lambda c: F.struct(c["chunkId"].alias("chunkId"), c["subChunkId"].alias("subChunkId"), F.lit(True).alias("overlap")))
    cells = df.withColumn("_cell", F.explode(F.concat(home, F.coalesce(halo, none))))
    return cells.select(*df.columns, "_cell.*")


def by_index(df: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Rows of a child with the cells of their director rows; index has key, chunkId, subChunkId."""
    at = index.select(F.col("key").alias("_key"), "chunkId", "subChunkId")
    return df.join(at, F.col(key) == F.col("_key")).drop("_key")


def object_index(df: DataFrame, key: str) -> DataFrame:
    """(key, chunkId, subChunkId) of located rows that are no overlap copies."""
    rows = df.where(~F.col("overlap")) if "overlap" in df.columns else df
    return rows.select(F.col(key).alias("key"), "chunkId", "subChunkId")


def _matched(df: DataFrame, c1, s1, c2, s2) -> DataFrame:
    """Match rows by the cells of their two sides (null where a side is missing)."""
    both = c1.isNotNull() & c2.isNotNull() & (c1 == c2)
    row = lambda c, s, f: F.struct(c.cast("int").alias("chunkId"), s.cast("int").alias("subChunkId"), F.lit(f).alias("flags"))
    cells = F.when(both, F.array(row(c1, s1, BOTH))).otherwise(F.filter(F.array(row(c1, s1, LEFT), row(c2, s2, RIGHT)), lambda x: x["chunkId"].isNotNull()))
    cells = F.when(c1.isNull() & c2.isNull(), F.raise_error(F.lit("both sides of a match record are missing"))).otherwise(cells)
    keep = [c for c in df.columns if c not in ("chunkId", "subChunkId", "flags", "_c1", "_s1", "_c2", "_s2")]
    return df.withColumn("_cell", F.explode(cells)).select(*keep, "_cell.*")


def matches_by_position(df: DataFrame, chunker: Chunker, pos1: tuple[str, str], pos2: tuple[str, str]) -> DataFrame:
    """One row for each chunk of a match, with flags; an error where the positions are farther apart than the overlap."""
    (x1, y1), (x2, y2) = ((F.col(a), F.col(b)) for a, b in (pos1, pos2))
    c1, s1 = chunker.columns(x1, y1)
    c2, s2 = chunker.columns(x2, y2)
    far = S.ang_sep(x1, y1, x2, y2) > chunker.overlap - _EPSILON / 3600
    c1 = F.when(F.coalesce(far, F.lit(False)), F.raise_error(F.lit("positions in a match record are separated by more than the overlap")).cast("int")).otherwise(c1)
    return _matched(df.withColumns({"_c1": c1, "_s1": s1, "_c2": c2, "_s2": s2}), F.col("_c1"), F.col("_s1"), F.col("_c2"), F.col("_s2"))


def matches_by_index(df: DataFrame, key1: str, index1: DataFrame, key2: str, index2: DataFrame) -> DataFrame:
    """The same by the director indexes of the two keys; keys that an index lacks count as missing."""
    a = index1.select(F.col("key").alias("_k1"), F.col("chunkId").alias("_c1"), F.col("subChunkId").alias("_s1"))
    b = index2.select(F.col("key").alias("_k2"), F.col("chunkId").alias("_c2"), F.col("subChunkId").alias("_s2"))
    joined = df.join(a, F.col(key1) == F.col("_k1"), "left").join(b, F.col(key2) == F.col("_k2"), "left").drop("_k1", "_k2")
    return _matched(joined, F.col("_c1"), F.col("_s1"), F.col("_c2"), F.col("_s2"))


def chunk_stats(df: DataFrame, by_sub_chunk: bool = False) -> DataFrame:
    """Rows, and overlap rows, of each chunk or sub-chunk."""
    keys = ["chunkId", "subChunkId"] if by_sub_chunk else ["chunkId"]
    own = ~F.col("overlap") if "overlap" in df.columns else F.lit(True)
    return df.groupBy(*keys).agg(F.count(F.when(own, 1)).alias("n_rows"), F.count(F.when(~own, 1)).alias("n_overlap"))


def chunk_summary(stats: DataFrame) -> DataFrame:
    """Number, extremes, mean and quartiles of the sizes of chunks or sub-chunks."""
    q = lambda p: F.percentile("n_rows", p)
    return stats.agg(F.count("*").alias("n"), F.min("n_rows").alias("smallest"), F.max("n_rows").alias("largest"), F.avg("n_rows").alias("mean"), F.stddev_pop("n_rows").alias("deviation"), q(0.25).alias("quartile1"), q(0.5).alias("median"), q(0.75).alias("quartile3"))


def layout(spark: SparkSession, chunker: Chunker, by_sub_chunk: bool = False) -> DataFrame:
    """Bounds of all chunks, or of all sub-chunks."""
    if by_sub_chunk:
        rows = [(c, s, *chunker.sub_chunk_bounds(c, s)) for c in chunker.all_chunks for s in chunker.sub_chunks_of(c)]
        return spark.createDataFrame(rows, "chunkId int, subChunkId int, lon_min double, lat_min double, lon_max double, lat_max double")
    return spark.createDataFrame([(c, *chunker.chunk_bounds(c)) for c in chunker.all_chunks], "chunkId int, lon_min double, lat_min double, lon_max double, lat_max double")


def htm_index(df: DataFrame, lon: str, lat: str, level: int = 8) -> DataFrame:
    """Rows of each triangle of the hierarchical mesh."""
    return df.select(S.htm_id(F.col(lon), F.col(lat), level).alias("htm_id")).groupBy("htm_id").agg(F.count("*").alias("n_rows"))
