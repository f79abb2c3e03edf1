"""Segment-test corners in closed form.

A pixel's strength is the largest t such that some N contiguous pixels of its 16-pixel ring
all differ from it by at least t in the same direction. It is a corner for threshold b
if that is over b; its score is the largest threshold that still passes, at least b.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import on_tiles, suppress

#: (dy, dx) of the radius-3 circle, in order around it; fixed values
RING16 = [(3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3), (0, -3), (1, -3), (2, -2), (3, -1)]


def strength(px: DataFrame, n: int) -> DataFrame:
    """y, x, m for pixels whose whole ring lies in the raster and has values.

    Worked out on tiles with a rim of 3: least and largest differences of all arcs by doubling their
    length. An empty raster gives no rows; of repeated pixels the largest value counts.
    """

    def run(v, here):
        p = np.pad(v, 3, constant_values=np.nan)
        h, w = v.shape
        d = np.stack([p[3 + dy : 3 + dy + h, 3 + dx : 3 + dx + w] for dy, dx in RING16]) - v
        low, high, length = d, d, 1
        while length < n:
            by = min(length, n - length)
            low, high, length = np.minimum(low, np.roll(low, -by, 0)), np.maximum(high, np.roll(high, -by, 0)), length + by
        return [np.maximum(low.max(axis=0), (-high).max(axis=0))]  # NaN if any of the ring is missing

    return on_tiles(px, 3, ["v"], "m double", run).filter("m is not null")


def scores(px: DataFrame, n: int, b: int) -> DataFrame:
    """y, x, score of every corner."""
    return strength(px, n).filter(F.col("m") > b).select("y", "x", F.greatest(F.lit(b), F.col("m") - 1).cast("int").alias("score"))


def detect(px: DataFrame, n: int, b: int) -> DataFrame:
    return scores(px, n, b).select("y", "x")


def detect_nms(px: DataFrame, n: int, b: int) -> DataFrame:
    return suppress(scores(px, n, b))
