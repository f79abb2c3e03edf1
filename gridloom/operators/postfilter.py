"""Elevation post-filters guided by an image, run tile by tile with a halo.

Pixels are dealt to tiles that overlap by the reach of all iterations, so that a tile's inner
part is the same as without tiles; numpy works on one tile at a time. ``MLPA`` has no published
definition under that name and is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import treefilter
from .raster import deal

STRIP_CELLS = 1 << 22
METHODS = ("bilateral", "guided_image", "guided_median", "local_patch", "tree_filter")
ALIASES = {"patch_filtering": "local_patch"}


def shifts(a: np.ndarray, r: int):
    """Each offset in the square of radius r with the array moved by it (NaN outside)."""
    p = np.pad(a, r, constant_values=np.nan)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            yield dy, dx, p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]]


def bilateral(z: np.ndarray, c: np.ndarray, r: int, sc: float, sd: float, sz: float) -> np.ndarray:
    top, low = np.zeros(z.shape), np.zeros(z.shape)
    for (dy, dx, zz), (_, _, cc) in zip(shifts(z, r), shifts(c, r)):
        w = np.exp(-((cc - c) ** 2) / (2 * sc**2) - (dy * dy + dx * dx) / (2 * sd**2) - (zz - z) ** 2 / (2 * sz**2))
        w = np.where(np.isnan(w), 0, w)
        top += w * np.nan_to_num(zz)
        low += w
    return np.where(low > 0, top / np.where(low > 0, low, 1), z)


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over the square cut at the rim."""
    def total(v: np.ndarray) -> np.ndarray:
        s = np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0)))
        y, x = np.arange(v.shape[0])[:, None], np.arange(v.shape[1])[None]
        y0, y1, x0, x1 = (y - r).clip(0), (y + r + 1).clip(max=v.shape[0]), (x - r).clip(0), (x + r + 1).clip(max=v.shape[1])
        return s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]

    known = ~np.isnan(a)
    n = total(known.astype(float))
    return total(np.nan_to_num(a)) / np.where(n > 0, n, 1)


def guided_image(z: np.ndarray, c: np.ndarray, r: int, eps: float) -> np.ndarray:
    mi, mp = box(c, r), box(z, r)
    a = (box(c * z, r) - mi * mp) / (box(c * c, r) - mi * mi + eps)
    b = mp - a * mi
    return box(a, r) * c + box(b, r)


def guided_median(z: np.ndarray, c: np.ndarray, r: int, sc: float) -> np.ndarray:
    """Weighted medians, a strip of rows at a time, so that no more than ``STRIP_CELLS`` neighbours are held."""
    h, width = z.shape
    pz, pc, side = np.pad(z, r, constant_values=np.nan), np.pad(c, r, constant_values=np.nan), 2 * r + 1
    out, rows = np.empty_like(z), max(1, STRIP_CELLS // (side * side * width))
    for y in range(0, h, rows):
        n = min(rows, h - y)
        at = [np.s_[y + dy : y + dy + n, dx : dx + width] for dy in range(side) for dx in range(side)]
        v = np.stack([pz[k] for k in at])
        w = np.stack([np.nan_to_num(np.exp(-((pc[k] - c[y : y + n]) ** 2) / (2 * sc**2))) for k in at]) * ~np.isnan(v)
        order = np.argsort(v, axis=0, kind="stable")
        run = np.cumsum(np.take_along_axis(w, order, 0), axis=0)
        half = (run >= run[-1] / 2 - 1e-12).argmax(axis=0)
        found = np.take_along_axis(np.take_along_axis(v, order, 0), half[None], 0)[0]
        out[y : y + n] = np.where(run[-1] > 0, found, z[y : y + n])
    return out


def local_patch(z: np.ndarray, c: np.ndarray, r: int, wc: float, wd: float, wz: float, sc: float, sd: float, sz: float) -> np.ndarray:
    """Height at the centre of a plane fitted to the neighbourhood, weighted by colour, distance and height."""
    m = np.zeros((3, 3, *z.shape))
    q = np.zeros((3, *z.shape))
    for (dy, dx, zz), (_, _, cc) in zip(shifts(z, r), shifts(c, r)):
        w = np.exp(-wc * np.abs(cc - c) / sc - wd * np.hypot(dy, dx) / sd - wz * np.abs(zz - z) / sz)
        w = np.where(np.isnan(w), 0, w)
        for i, a in enumerate((1.0, dy, dx)):
            q[i] += w * a * np.nan_to_num(zz)
            for j, b in enumerate((1.0, dy, dx)):
                m[i, j] += w * a * b
    m = np.moveaxis(m, (0, 1), (-2, -1)) + np.eye(3) * 1e-9
    return np.linalg.solve(m, np.moveaxis(q, 0, -1)[..., None])[..., 0, 0]


def apply(dsm: DataFrame, guide: DataFrame, method: str, radius: int = 12, iterations: int = 5, tile: int = 1000, tile_y: int | None = None, sigma_c: float = 10.0, sigma_d: float = 5.0, sigma_z: float = 1.0, weights: tuple[float, float, float] = (0.3, 0.3, 0.6), eps: float = 1e-2) -> DataFrame:
    """Filtered DSM (y, x, v); ``guide`` has a value for the same pixels. Holes get no value.

    The tree filter has an operator of its own, as its tree covers the whole raster.
    """
    method = ALIASES.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}; one of {', '.join(METHODS)}")
    steps = {
        "bilateral": lambda z, c: bilateral(z, c, radius, sigma_c, sigma_d, sigma_z),
        "guided_image": lambda z, c: guided_image(z, c, radius, eps),
        "guided_median": lambda z, c: guided_median(z, c, radius, sigma_c),
        "local_patch": lambda z, c: local_patch(z, c, radius, *weights, sigma_c, sigma_d, sigma_z),
    }
    if method == "tree_filter":
        return treefilter.tree_filter(dsm, guide, sigma_c, iterations, tile)
    step, halo = steps[method], iterations * radius * (2 if method == "guided_image" else 1)
    both = dsm.filter("v is not null").join(guide.select("y", "x", F.col("v").alias("c")), ["y", "x"])

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        y, x = (pdf[k].to_numpy() - pdf[k].min() for k in ("y", "x"))
        z, c = np.full((y.max() + 1, x.max() + 1), np.nan), np.full((y.max() + 1, x.max() + 1), np.nan)
        z[y, x], c[y, x] = pdf["v"], pdf["c"]
        hole = np.isnan(z)
        for _ in range(iterations):
            z = np.where(hole, np.nan, step(z, c))
        own = (pdf["y"] // (tile_y or tile) == ty) & (pdf["x"] // tile == tx)
        return pd.DataFrame({"y": pdf["y"], "x": pdf["x"], "v": z[y, x]})[own]

    return deal(both, tile, halo, tile_y).groupBy("ty", "tx").applyInPandas(one, "y long, x long, v double")
