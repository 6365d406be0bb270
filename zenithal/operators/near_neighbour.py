"""Join of positions within an angular separation.

The sphere is cut into latitude bands at least as high as the radius, and each band into
cells at least as wide as the radius is there. A left row has one cell; a right row is
copied to the cells that its circle can touch (nine at most, mostly fewer). An equi-join
on the cell and the exact separation give each pair once. No cross join; a dense cell is
a skewed key, which adaptive execution splits.

Where a table has several neighbours, as in a chain, the pairs of one edge are kept as
lists beside its rows, so that the separations of an edge are found once and not once for
each pair of the other. These joins deal dense cells out over several tasks themselves, as
a few small rows may make many large ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spherical as S

#: Beyond this radius cells no longer part the sphere, and the condition joins by itself.
LARGEST = 60.0
#: Neighbours in one list, and left rows of a cell that one task takes.
LISTED, DENSE = 64, 512
#: Chords that differ from the radius's by less are decided by the exact separation; far above the rounding of unit vectors.
_UNSURE = 1e-12
_HOME = ("_band", "_cell", "_part")


def _bands(radius: float) -> tuple[int, float]:
    n = max(1, int(math.floor(180 / (1.0001 * max(radius, 1e-3)))))
    return n, 180 / n


def _cells(band: Column, radius: float, height: float) -> tuple[Column, Column]:
    """Number of cells of a band, and the reach of the radius in longitude there."""
    low = F.abs(-90 + band * height)
    high = F.abs(-90 + (band + 1) * height)
    lat = F.greatest(low, high)
    reach = F.when(lat + radius < 89.9, F.degrees(F.asin(F.lit(math.sin(math.radians(radius))) / F.cos(F.radians(lat))))).otherwise(360.0) * 1.0001
    return F.when(reach < 120, F.floor(360 / F.greatest(reach, F.lit(1e-3)))).otherwise(1).cast("long"), reach


def near_join(left: DataFrame, right: DataFrame, left_pos: tuple[Column, Column], right_pos: tuple[Column, Column], radius: float, inclusive: bool = False) -> DataFrame:
    """Pairs of rows within the radius (degrees); the frames share no column names."""
    if radius > LARGEST:
        return left.join(right, _within(left_pos, right_pos, radius, inclusive))
    return _celled(left, right, left_pos, right_pos, radius, inclusive)


def _within(left_pos: tuple[Column, Column], right_pos: tuple[Column, Column], radius: float, inclusive: bool) -> Column:
    sep = S.ang_sep(*left_pos, *right_pos)
    return sep <= radius if inclusive else sep < radius


def _celled(left: DataFrame, right: DataFrame, left_pos: tuple[Column, Column], right_pos: tuple[Column, Column], radius: float, inclusive: bool, dense: DataFrame | None = None) -> DataFrame:
    """The join on cells. With the rows that fill dense cells, these are parted, and the left row's cell and part stay as columns."""
    exact = _within(left_pos, right_pos, radius, inclusive)
    n, height = _bands(radius)
    band = lambda lat: F.greatest(F.lit(0), F.least(F.floor((lat + 90) / height), F.lit(n - 1))).cast("int")
    cell = lambda lon, count: F.least(F.floor(S.reduce_lon(lon) / 360 * count), count - 1)

    def homed(df: DataFrame) -> DataFrame:
        df = df.where(left_pos[0].isNotNull() & left_pos[1].isNotNull()).withColumn("_band", band(left_pos[1]))
        return df.withColumn("_cell", cell(left_pos[0], _cells(F.col("_band"), radius, height)[0]))

    a = homed(left)
    lon, lat = right_pos
    bands = F.sequence(band(lat - radius), band(lat + radius))

    def touched(b: Column) -> Column:
        count, reach = _cells(b, radius, height)
        some = F.when(count == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(cell(lon - reach, count), cell(lon, count), cell(lon + reach, count))))
        return F.transform(some, lambda c: F.struct(b.alias("b"), c.alias("c")))

    b = right.where(lon.isNotNull() & lat.isNotNull()).withColumn("_at", F.explode(F.flatten(F.transform(bands, touched))))
    b = b.withColumn("_rband", F.col("_at.b")).withColumn("_rcell", F.col("_at.c")).drop("_at")
    same = (F.col("_band") == F.col("_rband")) & (F.col("_cell") == F.col("_rcell"))
    if dense is None:
        return a.join(b, same & exact).drop("_band", "_cell", "_rband", "_rcell")
    crowds = homed(dense).groupBy("_band", "_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > DENSE)
    crowds = F.broadcast(crowds.select(F.col("_band").alias("_hband"), F.col("_cell").alias("_hcell"), F.ceil(F.col("_n") / DENSE).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    a = a.join(crowds, (F.col("_band") == F.col("_hband")) & (F.col("_cell") == F.col("_hcell")), "left")
    a = a.withColumn("_part", F.pmod(F.xxhash64(*left_pos), parts).cast("int")).drop("_hband", "_hcell", "_parts")
    b = b.join(crowds, (F.col("_rband") == F.col("_hband")) & (F.col("_rcell") == F.col("_hcell")), "left")
    b = b.withColumn("_rpart", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hband", "_hcell", "_parts")
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    a = _with_vector(a, "_l", *left_pos).repartition(tasks, *_HOME)
    b = _with_vector(b, "_r", lon, lat).hint("merge")  # a small file, but nine copies of each row
    apart = sum(((F.col(f"_l{k}") - F.col(f"_r{k}")) * (F.col(f"_l{k}") - F.col(f"_r{k}")) for k in "yz"), (F.col("_lx") - F.col("_rx")) * (F.col("_lx") - F.col("_rx")))
    chord = 2 * math.sin(math.radians(radius) / 2)
    close = F.when(apart < max(0.0, chord - _UNSURE) ** 2, True).when(apart > (chord + _UNSURE) ** 2, False).otherwise(exact)
    return a.join(b, same & (F.col("_part") == F.col("_rpart")) & close).drop("_rband", "_rcell", "_rpart", *(f"_{s}{k}" for s in "lr" for k in "xyz"))


def _with_vector(df: DataFrame, name: str, lon: Column, lat: Column) -> DataFrame:
    """Unit vectors as columns; null where a longitude is so large that its sine is not exact enough."""
    vector = S.unit_vector(F.when(F.abs(lon) <= 720, lon), lat)
    return df.withColumns({f"{name}{k}": v for k, v in zip("xyz", vector, strict=True)})


def near_lists(left: DataFrame, right: DataFrame, kept: list[str], left_pos: tuple[Column, Column], right_pos: tuple[Column, Column], radius: float, inclusive: bool) -> DataFrame:
    """Left rows that have right rows within the radius, each with lists of these (of a kept column, or of structs of several; `LISTED` at most) as `_near`.

    Equal left rows are one, whose lists hold their neighbours once for each, so that exploded lists are the pairs of `near_join`.
    """
    pairs = _celled(left, right, left_pos, right_pos, radius, inclusive, left)
    lists = pairs.groupBy(*_HOME, *left.columns).agg(F.collect_list(F.struct(*kept) if kept else F.struct(F.lit(1))).alias("_all")).drop(*_HOME)
    if len(kept) == 1:
        lists = lists.withColumn("_all", F.col(f"_all.{kept[0]}"))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(LISTED))
    return lists.select(*left.columns, F.explode(F.transform(starts, lambda k: F.slice("_all", k, F.lit(LISTED)))).alias("_near"))


def near_listed(left: DataFrame, right: DataFrame, left_pos: tuple[Column, Column], right_pos: tuple[Column, Column], radius: float, inclusive: bool, dense: DataFrame) -> DataFrame:
    """`near_join` of left rows that carry lists; dense: the rows from which they come, to count those of a cell."""
    return _celled(left, right, left_pos, right_pos, radius, inclusive, dense).drop(*_HOME)
