"""Largest singular triples of large sparse matrices (i, j, v) by a randomised range finder with subspace iterations.

A block of a few dozen vectors is a table with one row for each matrix row (or column) and the vectors' entries as its columns, so a
product with the matrix is one join and one grouped sum with map-side partial sums. Blocks are made orthonormal by the R of
:func:`gridloom.operators.linalg.thin_r`, the only thing that comes to the driver: as many rows and columns as the block has vectors.
No matrix of the size of rows or columns squared is ever formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import save
from .linalg import from_triplets, thin_r, transpose


def _names(width: int) -> list[str]:
    return [f"c{t}" for t in range(width)]


def _start(m: DataFrame, width: int) -> DataFrame:
    """m times random vectors, whose entries are hashes of the column."""
    entry = lambda t: F.xxhash64("j", F.lit(t)) / float(2**63)
    return m.groupBy("i").agg(*[F.sum(F.col("v") * entry(t)).alias(n) for t, n in enumerate(_names(width))])


def _times(m: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """m times ``block``, which has a row (j, c0..) for each column of m."""
    return m.join(block, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(n)).alias(n) for n in _names(width)])


def _combined(block: DataFrame, key: str, w: np.ndarray) -> DataFrame:
    """``block`` times the small matrix ``w``."""
    column = lambda t: sum((F.col(n) * float(w[k, t]) for k, n in enumerate(_names(len(w)))), F.lit(0.0))
    return block.select(key, *[column(t).alias(n) for t, n in enumerate(_names(w.shape[1]))])


def _r(block: DataFrame, width: int) -> np.ndarray:
    """R of the block's thin QR; its rows come in no order, so the leading zeros tell their places."""
    rows = np.array(thin_r(block, _names(width)).collect(), float).reshape(-1, width)
    return np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))


def _orthonormal(block: DataFrame, key: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """(orthonormal block, R); directions that the block lacks give vectors of 0."""
    r = _r(block, width)
    return save(_combined(block, key, np.linalg.pinv(r, rcond=1e-12)), "orthonormal"), r


def singular_triples(m: DataFrame, k: int, extra: int = 10, rounds: int = 4) -> tuple[list[float], DataFrame, DataFrame]:
    """The k largest singular values, and their left (i, rank, v) and right (j, rank, v) vectors, ranks from 0.

    ``extra`` more vectors than asked for and ``rounds`` products with m and its transpose make the values exact to about
    (s[k + extra] / s[k]) ** (2 * rounds + 1). Entries of one place add up, NULL ones count in nothing; a vector's largest entry on the
    right is positive; rows and columns without entries have none. Fewer values come back if m's rank is smaller.
    """
    width = k + extra
    a = save(from_triplets(m.select("i", "j", "v").dropna()), "matrix")
    back = transpose(a)
    block = save(_start(a, width), "block")
    if block.isEmpty():
        return [], *(block.select(F.col("i").alias(n), F.lit(0).alias("rank"), F.lit(0.0).alias("v")) for n in ("i", "j"))
    other = lambda b: b.withColumnRenamed("i", "j")
    q, _ = _orthonormal(block, "i", width)
    for _ in range(rounds):
        p, _ = _orthonormal(save(_times(back, other(q), width), "block"), "i", width)
        q, _ = _orthonormal(save(_times(a, other(p), width), "block"), "i", width)
    z = save(_times(back, other(q), width), "block")  # the transpose of Q'm
    p, r = _orthonormal(z, "i", width)
    u, s, v = np.linalg.svd(r.T, full_matrices=False)
    found = int((s[:k] > 1e-12 * max(s[0], 1e-300)).sum())
    left, right = _combined(q, "i", u[:, :found]), save(_combined(p, "i", v.T[:, :found]), "right")
    signs = right.agg(*[F.max_by(F.col(n), F.abs(F.col(n))).alias(n) for n in _names(found)]).first()
    turned = lambda b, key: b.select(F.col("i").alias(key), F.posexplode(F.array(*[F.col(n) * float(np.sign(signs[n]) or 1) for n in _names(found)])).alias("rank", "v"))
    return [float(x) for x in s[:found]], turned(left, "i"), turned(right, "j")


def low_rank(left: DataFrame, right: DataFrame, values: list[float], i: Column, j: Column, places: DataFrame) -> DataFrame:
    """``places`` with ``fit``: the entry at (i, j) of the matrix that the triples make up."""
    s = F.array(*[F.lit(x) for x in values])
    u, v = (side.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "v")))["v"].alias(f"_{key}v")) for side, key in ((left, "i"), (right, "j")))
    at = places.withColumns({"_i": i, "_j": j}).join(u.withColumnRenamed("i", "_i"), "_i").join(v.withColumnRenamed("j", "_j"), "_j")
    total = F.aggregate(F.zip_with(F.zip_with("_iv", "_jv", lambda x, y: x * y), s, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return at.select(*places.columns, total.alias("fit"))
