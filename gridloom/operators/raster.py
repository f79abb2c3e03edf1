"""Rasters in pixel form: one row per pixel (y, x, v), 0-based, plus any key columns.

Every function takes and returns DataFrames. No-data is NULL inside the library: it counts in no
statistic or mean, maps to NULL, and an empty raster gives no rows (a row of NULLs where the result is one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_arrays(rows: DataFrame, y: str, values: str) -> DataFrame:
    """One pixel per array element: y from column ``y``, x from the position."""
    return rows.select(F.col(y).cast("long").alias("y"), F.posexplode(values).alias("x", "v")).select("y", "x", F.col("v").cast("double").alias("v"))


def to_arrays(px: DataFrame) -> DataFrame:
    """Row form: y and the row's values in order of x."""
    return px.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("p")).select("y", F.col("p.v").alias("values"))


def statistics(px: DataFrame, *by: str) -> DataFrame:
    """Count, minimum, maximum, mean, population variance and deviation of the pixels with data."""
    return px.groupBy(*by).agg(
        F.count("v").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.var_pop("v").alias("v_var"), F.stddev_pop("v").alias("v_std")
    )


def minmax_stretch(px: DataFrame, top: float = 255.0) -> DataFrame:
    """Values to 0..top; NULL everywhere on a flat raster."""
    ends = px.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return px.crossJoin(F.broadcast(ends)).select("y", "x", (F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * top).alias("v"))


def luma(bands: DataFrame) -> DataFrame:
    """Grey value of columns r, g, b."""
    return bands.select("y", "x", (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("v"))


def bands_to_columns(px: DataFrame, names: list[str]) -> DataFrame:
    """Band-sequential pixels (column band) to one row per pixel with a column per band."""
    return px.groupBy("y", "x").agg(*[F.max(F.when(F.col("band") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def columns_to_bands(px: DataFrame, names: list[str]) -> DataFrame:
    """The reverse of :func:`bands_to_columns`."""
    return px.select("y", "x", F.posexplode(F.array(*names)).alias("band", "v"))


def rgb_bands(px: DataFrame) -> DataFrame:
    return px.filter(F.col("band") < 3)


def pyramid_level(px: DataFrame, step: int) -> DataFrame:
    """Mean of each step x step cell."""
    cell = [F.floor(F.col(c) / step).cast("long").alias(c) for c in ("y", "x")]
    return px.groupBy(*cell).agg(F.avg("v").alias("v"))


def pyramid(px: DataFrame, levels: int, step: int = 2) -> DataFrame:
    """All levels in one pass: level 0 is the input, level k has cells of step**k."""
    at = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    size = F.pow(F.lit(step), F.col("level"))
    return px.select("y", "x", "v", at.alias("level")).groupBy("level", F.floor(F.col("y") / size).cast("long").alias("y"), F.floor(F.col("x") / size).cast("long").alias("x")).agg(F.avg("v").alias("v"))


def unique(px: DataFrame) -> DataFrame:
    """Each pixel once: the largest value of those that repeat it."""
    return px.groupBy("y", "x").agg(F.max("v").alias("v"))


def deal(px: DataFrame, tile: int, halo: int, tile_y: int | None = None) -> DataFrame:
    """Every pixel once for each tile (ty, tx) whose rectangle with halo has it; ``tile_y`` rows high if not square."""
    near = lambda c, size: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)).cast("array<long>"))
    return px.withColumn("ty", near("y", tile_y or tile)).withColumn("tx", near("x", tile))


def crop(px: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """The window at (y0, x0), moved to the origin; the range predicate reaches the scan."""
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return px.filter(inside).select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def restore_nodata(filtered: DataFrame, original: DataFrame, nodata: float = 0.0) -> DataFrame:
    """Filtered values, but the no-data value where the original has it."""
    was = original.select("y", "x", F.col("v").alias("was"))
    return filtered.join(was, ["y", "x"], "left").select("y", "x", F.when(F.col("was") == nodata, F.lit(nodata)).otherwise(F.col("v")).alias("v"))


def sample_points(points: DataFrame, px: DataFrame) -> DataFrame:
    """Value under each point (y, x); NULL outside."""
    return points.join(px, ["y", "x"], "left")


def to_geo(col: Column, row: Column, t: list[float]) -> tuple[Column, Column]:
    return t[0] + t[1] * col + t[2] * row, t[3] + t[4] * col + t[5] * row


def invert_transform(t: list[float]) -> list[float]:
    """The transform that takes geographic to pixel coordinates."""
    det = t[1] * t[5] - t[2] * t[4]
    if det == 0:
        raise ValueError("the transform has no inverse")
    return [(t[2] * t[3] - t[0] * t[5]) / det, t[5] / det, -t[2] / det, (t[0] * t[4] - t[1] * t[3]) / det, -t[4] / det, t[1] / det]


def mosaic(tiles: DataFrame, overlap: int, tile: int) -> DataFrame:
    """Feathered union of overlapping tiles (columns ty, tx, y, x, v): weights fall towards a tile's rim."""
    def rim(c: str, t: str) -> Column:
        own = F.col(c) - F.col(t) * (tile - overlap)
        return F.least(own + 1, tile - own)

    w = (rim("y", "ty") * rim("x", "tx")).cast("double")
    return tiles.withColumn("w", w).groupBy("y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def cut_tiles(px: DataFrame, overlap: int, tile: int) -> DataFrame:
    """Each pixel once for every tile (ty, tx) that covers it, counting the overlap."""
    step = tile - overlap
    covers = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - tile + 1) / step)).cast("long"), F.floor(F.col(c) / step).cast("long"))
    return px.withColumn("ty", F.explode(covers("y"))).withColumn("tx", F.explode(covers("x")))
