"""Neighbourhood operators on pixels.

For the few cells of a 3 x 3 square, a pixel is scattered to the cells that need it and the cells are
grouped: an equi-shuffle with map-side partial aggregates, whatever the raster's size or shape, without
range joins. Larger neighbourhoods (boxes, rings) are worked out on tiles with a rim, so that a pixel
is shuffled about once and no task holds more than a tile, however long a row or column is.

Rasters may have holes; a pixel without a value (NULL) counts as zero in :func:`convolve` and
:func:`gradient` and as missing elsewhere. A raster has a pixel once: where a source may repeat pixels, take
:func:`raster.unique` first, as :func:`convolve` would add them up. An empty raster gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import deal

TILE = 256

LAPLACE = {(dy, dx): (-3.0 if (dy, dx) == (0, 0) else 0.25 if dy and dx else 0.5) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
RING8 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
SQUARE9 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _scatter(px: DataFrame, items: list[tuple[int, int, Column]], *more: str) -> DataFrame:
    """A row for each offset (dy, dx): the pixel as seen from the cell that has it there."""
    to = F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k"), w.alias("w")) for k, (dy, dx, w) in enumerate(items)]))
    return px.select(*more, "v", to.alias("t")).select(*more, "t.*", "v")


def convolve(px: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Correlation with a kernel by offset; outside the raster counts as zero."""
    kernel = {(0, 0): 0.0} | kernel
    items = [(dy, dx, F.lit(float(w))) for (dy, dx), w in kernel.items()]
    own = list(kernel).index((0, 0))
    s = _scatter(px, items)
    grouped = s.groupBy("y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.max((F.col("k") == own).cast("int")).alias("own"))
    return grouped.filter("own = 1").select("y", "x", "v")


def laplacian(px: DataFrame) -> DataFrame:
    return convolve(px, LAPLACE)


def gather(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """y, x, v and the value at each offset as n0, n1, ...; NULL outside the raster."""
    items = [(dy, dx, F.lit(0)) for dy, dx in [(0, 0), *offsets]]
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    g = _scatter(px, items).groupBy("y", "x").agg(F.max((F.col("k") == 0).cast("int")).alias("own"), at(0).alias("v"), *[at(k + 1).alias(f"n{k}") for k in range(len(offsets))])
    return g.filter("own = 1").drop("own")


def gradient(px: DataFrame) -> DataFrame:
    """Central differences gx, gy; outside counts as zero."""
    n = lambda i: F.coalesce(F.col(f"n{i}"), F.lit(0.0))
    return gather(px, [(0, 1), (0, -1), (1, 0), (-1, 0)]).select("y", "x", ((n(0) - n(1)) / 2).alias("gx"), ((n(2) - n(3)) / 2).alias("gy"))


def bilinear(points: DataFrame, px: DataFrame) -> DataFrame:
    """``points`` (columns py, px) with the interpolated value ``v``.

    Coordinates are truncated towards zero, so between -1 and 0 the first row or column is
    extrapolated; pixels outside the raster count as zero.
    """
    trunc = lambda c: F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
    cols = points.columns
    base = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_y", trunc("py")).withColumn("_x", trunc("px"))
    fy, fx = F.col("py") - F.col("_y"), F.col("px") - F.col("_x")
    corner = F.explode(F.array(*[F.struct((F.col("_y") + j).alias("y"), (F.col("_x") + i).alias("x"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("w")) for j in (0, 1) for i in (0, 1)]))
    got = base.select("_id", *cols, corner.alias("c")).select("_id", *cols, "c.*").join(px, ["y", "x"], "left")
    return got.groupBy("_id", *cols).agg(F.sum(F.col("w") * F.coalesce(F.col("v"), F.lit(0.0))).alias("v")).drop("_id")


def on_tiles(px: DataFrame, reach: int, names: list[str], kinds: str, run, tile: int = TILE) -> DataFrame:
    """``run`` over the arrays of each tile with a rim of ``reach``: a pixel is shuffled once, but for the rims.

    ``run`` gets the columns ``names`` as arrays (NaN where there is no pixel or no value) and whether there
    is a pixel, and returns an array for each column of ``kinds``; NaN becomes NULL. One row comes
    for each pixel; of repeated pixels the one with the largest values counts.
    """
    out = [k.split()[0] for k in kinds.split(", ")]
    size = tile + 2 * reach

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = (pdf[c].to_numpy(np.int64) - k * tile + reach for c, k in zip("yx", key))
        at, values = y * size + x, [pdf[n].to_numpy(float) for n in names]
        order = np.lexsort(values[::-1]) if len(np.unique(at)) < len(at) else slice(None)
        here = np.zeros((size, size), bool)
        here.ravel()[at] = True
        arrays = [np.full((size, size), np.nan) for _ in names]
        for a, v in zip(arrays, values):
            a.ravel()[at[order]] = v[order]
        inner = np.s_[reach : reach + tile, reach : reach + tile]
        y, x = np.nonzero(here[inner])
        found = {n: a[inner][y, x] for n, a in zip(out, run(*arrays, here))}
        return pd.DataFrame({"y": y + key[0] * tile, "x": x + key[1] * tile} | found)

    return deal(px.select("y", "x", *names), tile, reach).groupBy("ty", "tx").applyInPandas(one, f"y {_kind(px, 'y')}, x {_kind(px, 'x')}, {kinds}")


def _kind(px: DataFrame, name: str) -> str:
    return px.schema[name].dataType.simpleString()


def square_sum(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square of the radius, cut at the rim."""
    for axis in (0, 1):
        p = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)])
        n = a.shape[axis]
        a = sum(np.take(p, range(k, k + n), axis) for k in range(2 * radius + 1))
    return a


def box_sum(px: DataFrame, radius: int, *names: str) -> DataFrame:
    """Sums of the named columns over the square of the radius, cut at the rim, and as n the pixels in
    it for which all of them have a value. A square without any value has sums of 0."""

    def run(*arrays):
        known = ~np.isnan(np.stack(arrays[:-1])).any(axis=0)
        return [*(square_sum(np.where(known, a, 0), radius) for a in arrays[:-1]), square_sum(known.astype(np.int64), radius)]

    return on_tiles(px, radius, list(names), ", ".join([*[f"{n} double" for n in names], "n long"]), run)


def box_mean(px: DataFrame, radius: int) -> DataFrame:
    """Mean over the square; NULL where no pixel of it has a value."""
    return box_sum(px, radius, "v").select("y", "x", F.try_divide("v", "n").alias("v"))


def guided(px: DataFrame, guide: DataFrame, radius: int, eps: float) -> DataFrame:
    """Guided image filter: local linear model of the input in the guide, coefficients box-averaged.

    Pixels without a guide pixel are left out; pixels without a value get NULL and count nowhere."""
    both = px.select("y", "x", F.col("v").alias("p")).join(guide.select("y", "x", F.col("v").alias("i")), ["y", "x"])

    def run(p, i, here):
        known = ~np.isnan(p) & ~np.isnan(i)
        n = np.where(known, square_sum(known.astype(float), radius), np.nan)
        mean = lambda a: square_sum(np.where(known, a, 0), radius) / n
        mp, mi = mean(p), mean(i)
        a = (mean(i * p) - mi * mp) / (mean(i * i) - mi * mi + eps)
        return [mean(a) * i + mean(mp - a * mi)]

    return on_tiles(both, 2 * radius, ["p", "i"], "v double", run)


def bilateral(px: DataFrame, guide: DataFrame, sigma_c: float, sigma_d: float, sigma_z: float, radius: int = 1) -> DataFrame:
    """Joint bilateral filter over a small square; weights from guide, distance and height."""
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    both = px.join(guide.select("y", "x", F.col("v").alias("c")), ["y", "x"])
    packed = both.select("y", "x", F.struct("v", "c").alias("v"))
    g = gather(packed, offsets)
    z, c = F.col("v.v"), F.col("v.c")
    sq = lambda e: e * e

    def weight(k: int) -> Column:
        dy, dx = offsets[k]
        e = -sq(F.col(f"n{k}.c") - c) / (2 * sigma_c**2) - F.lit(float(dy * dy + dx * dx)) / (2 * sigma_d**2) - sq(F.col(f"n{k}.v") - z) / (2 * sigma_z**2)
        return F.coalesce(F.exp(e), F.lit(0.0))

    top = sum((weight(k) * F.coalesce(F.col(f"n{k}.v"), F.lit(0.0)) for k in range(1, len(offsets))), weight(0) * F.coalesce(F.col("n0.v"), F.lit(0.0)))
    low = sum((weight(k) for k in range(1, len(offsets))), weight(0))
    return g.select("y", "x", (top / low).alias("v"))


def weighted_median(px: DataFrame, guide: DataFrame, sigma_c: float, offsets: list[tuple[int, int]] = SQUARE9) -> DataFrame:
    """Smallest neighbour value at which half of the guide weights is reached; ties by value. Neighbours
    without a value or guide don't count; NULL where none is left or the pixel has no guide."""
    packed = px.join(guide.select("y", "x", F.col("v").alias("c")), ["y", "x"]).select("y", "x", F.struct("v", "c").alias("v"))
    near = gather(packed, offsets).select("y", "x", F.col("v.c").alias("c"), F.filter(F.array(*[f"n{k}" for k in range(len(offsets))]), lambda e: e["v"].isNotNull() & e["c"].isNotNull()).alias("a"))
    weight = lambda e: F.round(F.exp(-((e["c"] - F.col("c")) * (e["c"] - F.col("c"))) / (2 * sigma_c**2)), 9)
    near = near.select("y", "x", F.array_sort(F.transform("a", lambda e: F.struct(e["v"].alias("v"), weight(e).alias("w")))).alias("a"))
    near = near.withColumn("total", F.aggregate("a", F.lit(0.0), lambda t, e: t + e["w"]))
    run = F.aggregate("a", F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m")), lambda acc, e: F.struct((acc["s"] + e["w"]).alias("s"), F.when(acc["m"].isNull() & (acc["s"] + e["w"] >= F.col("total") / 2 - 1e-9), e["v"]).otherwise(acc["m"]).alias("m")))
    return near.select("y", "x", run["m"].alias("v"))


def suppress(corners: DataFrame) -> DataFrame:
    """Corners (y, x, score) without an 8-neighbour of the same or a higher score.

    A corner is scattered to its neighbours; equal neighbours remove each other.
    """
    to = F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(dy == 0 and dx == 0).alias("own")) for dy, dx in SQUARE9]))
    s = corners.select("score", to.alias("t")).select("t.*", "score")
    g = s.groupBy("y", "x").agg(F.max(F.when(F.col("own"), F.col("score"))).alias("score"), F.max(F.when(~F.col("own"), F.col("score"))).alias("near"))
    return g.filter("score is not null and (near is null or near < score)").select("y", "x", "score")


def census(px: DataFrame) -> DataFrame:
    """8-bit census code: a bit for each 8-neighbour below the centre; outside counts as not below."""
    g = gather(px, RING8)
    code = sum((F.coalesce((F.col(f"n{k}") < F.col("v")).cast("int"), F.lit(0)) * (1 << k) for k in range(1, 8)), F.coalesce((F.col("n0") < F.col("v")).cast("int"), F.lit(0)))
    return g.select("y", "x", code.alias("code"))


def harris(px: DataFrame, radius: int = 1, k: float = 0.04) -> DataFrame:
    """Harris response: det - k trace^2 of the gradient products summed over the square.

    Outside the raster, and where there is no value, counts as zero for the gradients."""

    def run(v, here):
        p = np.pad(np.nan_to_num(v), 1)
        gx, gy = (np.where(here, g, 0) for g in ((p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2))
        a, b, c = (square_sum(x, radius) for x in (gx * gx, gy * gy, gx * gy))
        return [a * b - c * c - k * (a + b) * (a + b)]

    return on_tiles(px, radius + 1, ["v"], "v double", run)


def gaussian_weight(distance: Column, sigma: float) -> Column:
    return F.exp(-(distance * distance) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
