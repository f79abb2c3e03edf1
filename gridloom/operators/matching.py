"""Radiometric matching, feature selection, least-squares matching and tie-point tables.

Pixels without a value (NULL) count in no mean, score or histogram and count as zero in gradients and patches; windows
that leave the raster are rejected. Ties go to the first in row order or to the lowest id, as each function
says. Groups without values give NULL scores; empty tables give no rows (one of NULLs for coefficients).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import save
from .focal import SQUARE9, gather, gradient, laplacian
from .linalg import inverse2

METRES = 111_320.0  # of a degree of latitude, and of longitude on the equator


def intensity_coefficients(one: DataFrame, two: DataFrame) -> DataFrame:
    """a, b that give image two the mean and deviation of image one; population variances."""
    s1 = one.agg(F.avg("v").alias("m1"), F.var_pop("v").alias("q1"))
    s2 = two.agg(F.avg("v").alias("m2"), F.var_pop("v").alias("q2"))
    a = F.sqrt(F.try_divide("q1", "q2"))
    return s1.crossJoin(s2).select(a.alias("a"), (F.col("m1") - a * F.col("m2")).alias("b"))


def match_intensity(one: DataFrame, two: DataFrame) -> DataFrame:
    return two.crossJoin(F.broadcast(intensity_coefficients(one, two))).select("y", "x", (F.col("a") * F.col("v") + F.col("b")).alias("v"))


def strongest_per_tile(px: DataFrame, height: int, width: int, grid: int) -> DataFrame:
    """The pixel of the largest |v| in each tile; of equals the first in row order.

    Tiles start at row and column 1 in steps of ``grid`` while below size - grid, so the rim and
    trailing parts have none; a raster smaller than a tile has none. In a tile of zeros the origin wins.
    """
    tile = lambda c, n: F.floor((F.col(c) - 1) / grid).cast("long")
    starts = lambda n: max(0, -(-(n - grid - 1) // grid))
    inside = F.col("y").between(1, starts(height) * grid) & F.col("x").between(1, starts(width) * grid)
    best = F.min(F.struct((-F.abs("v")).alias("s"), F.col("y"), F.col("x")))
    return px.filter(inside).groupBy(tile("y", height).alias("ty"), tile("x", width).alias("tx")).agg(best.alias("b")).select("ty", "tx", F.col("b.y").alias("fy"), F.col("b.x").alias("fx"), (-F.col("b.s")).alias("strength"))


def features(px: DataFrame, height: int, width: int, grid: int) -> DataFrame:
    return strongest_per_tile(laplacian(px), height, width, grid)


def _windows(feats: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """All window pixels of the features whose window lies in the raster."""
    ok = (F.col("fy") - half >= 0) & (F.col("fx") - half >= 0) & (F.col("fy") + half < height) & (F.col("fx") + half < width)
    steps = F.sequence(F.lit(-half), F.lit(half))
    return feats.filter(ok).select("fy", "fx", F.explode(steps).alias("oy")).select("fy", "fx", "oy", F.explode(steps).alias("ox")).select("fy", "fx", (F.col("fy") + F.col("oy")).alias("y"), (F.col("fx") + F.col("ox")).alias("x"))


def one_step(one: DataFrame, gradient_two: DataFrame, two: DataFrame, feats: DataFrame, half: int, height: int, width: int) -> DataFrame:
    """First Gauss-Newton shift (dx, dy) of each feature from zero; NULL where singular."""
    w = _windows(feats, half, height, width).join(one.withColumnRenamed("v", "i1"), ["y", "x"]).join(two.withColumnRenamed("v", "i2"), ["y", "x"]).join(gradient_two, ["y", "x"])
    gx, gy, l = F.col("gx"), F.col("gy"), F.col("i1") - F.col("i2")
    s = w.groupBy("fy", "fx").agg(F.sum(gx * gx).alias("a"), F.sum(gx * gy).alias("b"), F.sum(gy * gy).alias("d"), F.sum(gx * l).alias("p"), F.sum(gy * l).alias("q"))
    i = inverse2(F.col("a"), F.col("b"), F.col("b"), F.col("d"))
    return s.select("fy", "fx", (i[0] * F.col("p") + i[1] * F.col("q")).alias("dx"), (i[2] * F.col("p") + i[3] * F.col("q")).alias("dy"))


def plausible(shifts: DataFrame, limit: float = 2.0) -> DataFrame:
    """Finite shifts of at most ``limit`` pixels."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit)
    return shifts.filter(ok("dx") & ok("dy"))


def sample(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples; coordinates truncate towards zero, outside counts as zero."""
    iy, ix = np.trunc(y).astype(int), np.trunc(x).astype(int)
    out = np.zeros(y.shape)
    for j in (0, 1):
        for i in (0, 1):
            inside = (iy + j >= 0) & (iy + j < img.shape[0]) & (ix + i >= 0) & (ix + i < img.shape[1])
            v = np.where(inside, img[(iy + j).clip(0, img.shape[0] - 1), (ix + i).clip(0, img.shape[1] - 1)], 0)
            out += v * ((y - iy) if j else 1 - (y - iy)) * ((x - ix) if i else 1 - (x - ix))
    return out


def shift_of(one: np.ndarray, two: np.ndarray, half: int, rounds: int = 10, stop: float = 1e-5) -> tuple[float, float]:
    """Gauss-Newton shift between a window and a patch with the same centre."""
    my, mx = two.shape[0] // 2, two.shape[1] // 2
    oy, ox = (g.astype(float) for g in np.mgrid[-half : half + 1, -half : half + 1])
    dx = dy = 0.0
    for _ in range(rounds):
        y, x = my + oy + dy, mx + ox + dx
        gx = (sample(two, y, x + 1) - sample(two, y, x - 1)) / 2
        gy = (sample(two, y + 1, x) - sample(two, y - 1, x)) / 2
        diff = one - sample(two, y, x)
        a = np.array([[(gx * gx).sum(), (gx * gy).sum()], [(gx * gy).sum(), (gy * gy).sum()]])
        det = a[0, 0] * a[1, 1] - a[0, 1] ** 2
        if not np.isfinite(det) or det == 0:
            return float("nan"), float("nan")
        p, q = (gx * diff).sum(), (gy * diff).sum()
        sx, sy = (a[1, 1] * p - a[0, 1] * q) / det, (a[0, 0] * q - a[0, 1] * p) / det
        dx, dy = dx + sx, dy + sy
        if not abs(dx) < 1e3 or not abs(dy) < 1e3:
            return float("nan"), float("nan")
        if abs(sx) <= stop and abs(sy) <= stop:
            break
    return dx, dy


def least_squares_match(one: DataFrame, two: DataFrame, feats: DataFrame, half: int, height: int, width: int, margin: int = 6) -> DataFrame:
    """Shift (dx, dy) of each feature whose window lies in the raster: match = feature + shift.

    Each feature's patches (a window of one, a window plus ``margin`` of two) are gathered by
    a join and solved in Arrow batches of features; a search beyond the margin reads zeros.
    """
    r = half + margin
    kept = _windows(feats, half, height, width).select("fy", "fx").distinct()
    steps = F.sequence(F.lit(-r), F.lit(r))
    cells = kept.select("fy", "fx", F.explode(steps).alias("oy")).select("fy", "fx", "oy", F.explode(steps).alias("ox"))
    cells = cells.withColumn("y", F.col("fy") + F.col("oy")).withColumn("x", F.col("fx") + F.col("ox"))
    both = one.withColumnRenamed("v", "i1").join(two.withColumnRenamed("v", "i2"), ["y", "x"])
    got = cells.join(both, ["y", "x"]).groupBy("fy", "fx").agg(F.collect_list(F.struct("oy", "ox", "i1", "i2")).alias("c"))  # one window each
    got = got.select("fy", "fx", *[F.col(f"c.{n}").alias(n) for n in ("oy", "ox", "i1", "i2")])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for fy, fx, oy, ox, i1, i2 in zip(*(pdf[c] for c in ("fy", "fx", "oy", "ox", "i1", "i2"))):
                a, b = np.zeros((2 * r + 1, 2 * r + 1)), np.zeros((2 * r + 1, 2 * r + 1))
                a[oy + r, ox + r], b[oy + r, ox + r] = np.nan_to_num(i1), np.nan_to_num(i2)
                out.append((fy, fx, *shift_of(a[margin : margin + 2 * half + 1, margin : margin + 2 * half + 1], b, half)))
            yield pd.DataFrame(out, columns=["fy", "fx", "dx", "dy"])

    return got.mapInPandas(run, "fy long, fx long, dx double, dy double")


def system_bias(one: DataFrame, two: DataFrame, height: int, width: int, grid: int = 100, window: int = 15) -> DataFrame:
    """The whole chain: match intensities, pick features, match them, drop implausible shifts."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    return plausible(least_squares_match(one, match_intensity(one, two), features(one, height, width, grid), window // 2, height, width))


def zncc(pairs: DataFrame, *by: str) -> DataFrame:
    """Zero-mean normalised cross-correlation of columns v1 and v2 per group."""
    return pairs.groupBy(*by).agg(F.corr("v1", "v2").alias("zncc"))


def census_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def modified_census(px: DataFrame) -> DataFrame:
    """9-bit code: a bit for each pixel of the 3 x 3 square below the square's mean; only whole squares."""
    g = gather(px, SQUARE9)
    cells = [F.col(f"n{k}") for k in range(9)]
    mean = sum(cells[1:], cells[0]) / 9
    code = sum(((c < mean).cast("int") * (1 << k) for k, c in enumerate(cells[1:], 1)), (cells[0] < mean).cast("int"))
    return g.select("y", "x", code.alias("code")).dropna()


def orientation_histogram(px: DataFrame, window: int, bins: int = 9) -> DataFrame:
    """Gradient magnitudes by orientation (bin 0 begins at 0 degrees of 180) in each window x window cell
    (wy, wx), over the cell's norm; cells without any gradient have no rows."""
    g = gradient(px)
    size = F.hypot("gx", "gy")
    turn = F.pmod(F.atan2("gy", "gx"), F.lit(math.pi))
    cell = [F.floor(F.col(c) / window).alias(f"w{c}") for c in ("y", "x")]
    sums = g.filter(size > 0).groupBy(*cell, F.least(F.floor(turn / (math.pi / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum(size).alias("weight"))
    norms = sums.groupBy("wy", "wx").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return sums.join(norms, ["wy", "wx"]).select("wy", "wx", "bin", (F.col("weight") / F.col("norm")).alias("weight"))


def orientation_score(one: DataFrame, two: DataFrame, window: int, bins: int = 9) -> DataFrame:
    """Cosine of the orientation histograms of two rasters per cell; 0 where they share no bin."""
    a, b = (orientation_histogram(px, window, bins) for px in (one, two))
    both = a.withColumnRenamed("weight", "p").join(b.withColumnRenamed("weight", "q"), ["wy", "wx", "bin"], "full_outer")
    return both.groupBy("wy", "wx").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("score"))


WINDOW_SCORES = ("zncc", "census", "census_zncc")


def window_score(pairs: DataFrame, method: str, *by: str) -> DataFrame:
    """Score of two windows per group; ``pairs`` has a row a pixel with v1, v2 (values) and c1, c2 (census codes).

    zncc: correlation of the values; census: share of equal bits of 8-bit codes; census_zncc: mean of both, with the correlation
    brought to 0..1. Windows without variance have no correlation (NULL). Other methods raise ValueError.
    """
    if method not in WINDOW_SCORES:
        raise ValueError(f"unsupported score {method!r}; one of {', '.join(WINDOW_SCORES)}")
    corr, bits = F.corr("v1", "v2"), 1 - F.avg(census_distance(F.col("c1"), F.col("c2"))) / 8
    return pairs.groupBy(*by).agg({"zncc": corr, "census": bits, "census_zncc": ((corr + 1) / 2 + bits) / 2}[method].alias("score"))


def pair_match(candidates: DataFrame, left: DataFrame, right: DataFrame, left_px: DataFrame, right_px: DataFrame, half: int, ratio: float, least: float) -> DataFrame:
    """Matches (id, candidate, score) of candidate pairs (id, candidate) of features (id, y, x): the best by correlation of
    the windows around them, if it is at least ``least`` and the runner-up has at most ``ratio`` of it."""
    steps = F.sequence(F.lit(-half), F.lit(half))

    def window(features: DataFrame, px: DataFrame, key: str, v: str) -> DataFrame:
        cells = features.select(F.col("id").alias(key), "y", "x", F.explode(steps).alias("oy")).select("*", F.explode(steps).alias("ox"))
        return cells.select(key, "oy", "ox", (F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x")).join(px, ["y", "x"]).select(key, "oy", "ox", F.col("v").alias(v))

    pairs = candidates.select("id", "candidate").join(window(left, left_px, "id", "v1"), "id").join(window(right, right_px, "candidate", "v2"), ["candidate", "oy", "ox"])
    scored = zncc(pairs, "id", "candidate").select("id", "candidate", F.col("zncc").alias("score")).filter(F.col("score") > 0)
    return best_with_ratio(scored, ratio, "id").filter(F.col("score") >= least)


def transposed_descriptor(d: Column) -> Column:
    """A descriptor of 4 x 4 cells of 8 orientation bins, flipped: rows of cells in reverse order, bin 0 in
    place and bins 1 to 7 in reverse. NULL unless it has 128 numbers."""
    at = [1 + 32 * (3 - k // 32) + 8 * (k // 8 % 4) + (8 - k % 8) % 8 for k in range(128)]
    return F.when(F.size(d) == 128, F.transform(F.array(*[F.lit(k) for k in at]), lambda k: F.get(d, k - 1)))


def scaled_descriptor(d: Column, factor: float = 512.0) -> Column:
    return F.transform(d, lambda v: v * factor)


def image_angle(theta: Column) -> Column:
    """Orientation against the other axis: a quarter turn less theta."""
    return math.pi / 2 - theta


def median_of(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median (mean of the middle two for even numbers) and number of values per group; NULLs don't count."""
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def weighted_centre(rows: DataFrame, values: dict[str, tuple[Column, Column]], sigma: dict[str, float], *by: str) -> DataFrame:
    """Per group and name: the mean of a value, weighted by a Gaussian of another column's distance from 0 there.

    ``values``: name -> (value, distance). One, or three for points in space."""
    weight = lambda n: F.exp(-(values[n][1] * values[n][1]) / (2 * sigma[n] ** 2))
    return rows.groupBy(*by).agg(*[F.try_divide(F.sum(weight(n) * values[n][0]), F.sum(F.when(values[n][0].isNotNull(), weight(n)))).alias(n) for n in values])


def repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Keys that come more than once, and how often; NULL keys are a key."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def best_with_ratio(candidates: DataFrame, ratio: float, *by: str) -> DataFrame:
    """The candidate of the highest score per group, if the runner-up has at most ``ratio`` of it."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "candidate")
    top = candidates.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    g = top.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.col("candidate"))).alias("candidate"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return g.filter(F.col("second").isNull() | (F.col("second") <= ratio * F.col("score"))).select(*by, "candidate", "score")


def median_outliers(points: DataFrame, value: str, k: float, *by: str) -> DataFrame:
    """``points`` with column inlier: within k median absolute deviations of the group's median."""
    m = points.groupBy(*by).agg(F.median(value).alias("_m"))
    d = points.join(m, list(by)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    s = d.groupBy(*by).agg(F.median("_d").alias("_s"))
    return d.join(s, list(by)).withColumn("inlier", F.col("_d") <= k * F.col("_s")).drop("_m", "_d", "_s")


def place_outliers(points: DataFrame, k: float, *by: str) -> DataFrame:
    """``points`` (lat, lon, height and keys) with column inlier: no farther, in metres, from the group's median place than k times
    the median of those distances. Longitudes are taken from the group's westernmost one, so a group may lie across the date line;
    a NULL coordinate makes inlier NULL."""
    west = points.groupBy(*by).agg(F.min("lon").alias("_w"))
    at = points.join(west, list(by)).withColumn("_e", F.pmod(F.col("lon") - F.col("_w") + 180.0, F.lit(360.0)) - 180.0)
    m = at.groupBy(*by).agg(F.median("lat").alias("_ml"), F.median("_e").alias("_me"), F.median("height").alias("_mh"))
    north, east = (F.col("lat") - F.col("_ml")) * METRES, (F.col("_e") - F.col("_me")) * METRES * F.cos(F.radians("_ml"))
    up = F.col("height") - F.col("_mh")
    d = at.join(m, list(by)).withColumn("_d", F.sqrt(north * north + east * east + up * up))
    s = d.groupBy(*by).agg(F.median("_d").alias("_s"))
    return d.join(s, list(by)).withColumn("inlier", F.col("_d") <= k * F.col("_s")).drop("_w", "_e", "_ml", "_me", "_mh", "_d", "_s")


def in_quad(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a convex quadrilateral, rim included."""
    signs = []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        signs.append((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))
    return (F.least(*signs) >= 0) | (F.greatest(*signs) <= 0)


def tracks(edges: DataFrame) -> DataFrame:
    """node, track: the smallest node that links (a, b) connect it with.

    Alternating star steps, each of which halves paths. A step groups twice, joins twice and takes
    distinct rows twice, over the links that are left, and writes four tables to the shared folder. Links with
    a NULL end and links of a node to itself join nothing; a node of such a link is a track of its own.
    """
    state = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "tracks")
    nodes = save(edges.select("a").union(edges.select("b")).dropna().distinct().withColumnRenamed("a", "node"), "track-nodes")
    before = None
    while (mark := state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and mark[0]:
        before = mark
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "track-minima")  # stored, so that a hub's join can be split
        large = save(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "tracks")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "track-minima")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        state = save(small.filter("u <> v").distinct(), "tracks")
    return nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("track")), "node", "left").select("node", F.coalesce("track", "node").alias("track"))
