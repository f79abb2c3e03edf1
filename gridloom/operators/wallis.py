"""Wallis contrast enhancement: a grid of local linear maps, interpolated at every pixel.

Zeros are no-data and stay zero; NULL values stay NULL and count as zero in a cell's sums. Rasters have a
pixel once (:func:`raster.unique`); an empty raster is below the least size and raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import restore_nodata

STEP, SIZE = 16, 31
MEAN, SIGMA, C, B = 1000.0, 1000.0, 0.95, 0.9


def _cells(c: str, n: int) -> Column:
    """The few cells that can cover the pixel: those around it and the last ones."""
    count = n // STEP + 1
    here = F.floor(F.col(c) / STEP).cast("int")
    some = F.array_distinct(F.array(*[F.least(F.greatest(here + d, F.lit(0)), F.lit(count - 1)) for d in (-2, -1, 0, 1)], *[F.lit(max(0, count - 1 - k)) for k in (0, 1, 2)]))
    start = lambda i: F.least(i * STEP, F.lit(n - SIZE))
    return F.filter(some, lambda i: (start(i) <= F.col(c)) & (F.col(c) < start(i) + SIZE))


def grid(px: DataFrame, height: int, width: int, mean: float = MEAN, sigma: float = SIGMA, c: float = C, b: float = B) -> DataFrame:
    """gy, gx, r0, r1 of each grid cell; needs at least 31 rows and columns."""
    if min(height, width) < SIZE:
        raise ValueError(f"at least {SIZE} rows and columns are needed")
    at = px.withColumn("gy", F.explode(_cells("y", height))).withColumn("gx", F.explode(_cells("x", width)))
    n = float(SIZE * SIZE)
    s = at.groupBy("gy", "gx").agg((F.sum("v") / n).alias("m"), (F.sum(F.col("v") * F.col("v")) / n).alias("q"))
    var = F.col("q") - F.col("m") * F.col("m")
    r1 = F.when(var > 0, c * sigma / (c * F.sqrt(F.greatest(var, F.lit(0.0))) + (1 - c) * sigma)).otherwise(1.0)
    return s.select("gy", "gx", (b * mean + (1 - b - r1) * F.col("m")).alias("r0"), r1.alias("r1"))


def _place(c: str, n: int) -> tuple[Column, Column]:
    """Lower grid index and fraction: negative goes to 0, past the end to the last cell's far side."""
    cells = n // STEP + 1
    at = F.greatest((F.col(c) - SIZE // 2) / STEP, F.lit(0.0))
    low = F.floor(at).cast("int")
    far = low >= cells - 1
    return F.when(far, cells - 2).otherwise(low), F.when(far, 0.999).otherwise(at - low)


def enhance(px: DataFrame, height: int, width: int, **parameters: float) -> DataFrame:
    """Wallis-filtered 16-bit pixels; zeros (no data) stay zero."""
    cells = grid(px, height, width, **parameters)
    (iy, fy), (ix, fx) = _place("y", height), _place("x", width)
    at = px.select("y", "x", "v", iy.alias("iy"), fy.alias("fy"), ix.alias("ix"), fx.alias("fx"))
    corner = F.explode(F.array(*[F.struct((F.col("iy") + j).alias("gy"), (F.col("ix") + i).alias("gx"), ((F.col("fy") if j else 1 - F.col("fy")) * (F.col("fx") if i else 1 - F.col("fx"))).alias("w")) for j in (0, 1) for i in (0, 1)]))
    got = at.select("y", "x", "v", corner.alias("t")).select("y", "x", "v", "t.*").join(cells, ["gy", "gx"])
    mapped = got.groupBy("y", "x", "v").agg(F.sum(F.col("w") * F.col("r0")).alias("r0"), F.sum(F.col("w") * F.col("r1")).alias("r1"))
    val = F.round(F.col("v") * F.col("r1") + F.col("r0"), 6)
    out = mapped.select("y", "x", F.when(val > 32768, 65535).when(val < 0, 0).otherwise(F.floor(val)).cast("double").alias("v"))
    return restore_nodata(out, px)
