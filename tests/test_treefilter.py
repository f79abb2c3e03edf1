"""The tree filter in tiles against the definition on small rasters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import treefilter as T


def kruskal(c):
    """Edges of the minimum spanning forest of a grid with holes (NaN)."""
    h, w = c.shape
    edges = []
    for y in range(h):
        for x in range(w):
            for y2, x2 in ((y, x + 1), (y + 1, x)):
                if y2 < h and x2 < w and not np.isnan(c[y, x] + c[y2, x2]):
                    edges.append((abs(c[y, x] - c[y2, x2]), y * T.WIDE + x, y2 * T.WIDE + x2))
    name, tree = {}, []

    def root(k):
        while name.setdefault(k, k) != k:
            k = name[k]
        return k

    for d, a, b in sorted(edges):
        if root(a) != root(b):
            name[root(a)] = root(b)
            tree.append((a, b, d))
    return tree


def dense(z, c, sigma):
    """Means over all paths, one source at a time."""
    near = {}
    for a, b, d in kruskal(c):
        near.setdefault(a, []).append((b, d))
        near.setdefault(b, []).append((a, d))
    out = {}
    for y, x in np.argwhere(~np.isnan(z + c)):
        todo, top, low = [(y * T.WIDE + x, None, 0.0)], 0.0, 0.0
        while todo:
            k, back, far = todo.pop()
            s = np.exp(-far / sigma)
            top, low = top + s * z[k // T.WIDE, k % T.WIDE], low + s
            todo += [(j, k, far + d) for j, d in near.get(k, []) if j != back]
        out[int(y), int(x)] = top / low
    return out


def frame(spark, a):
    return spark.createDataFrame([(int(y), int(x), None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(a)], "y long, x long, v double")


def made(seed, h, w, levels, holes):
    rng = np.random.default_rng(seed)
    z, c = rng.normal(10, 3, (h, w)), rng.integers(0, levels, (h, w)).astype(float)
    z[rng.random((h, w)) < holes] = np.nan
    c[np.isnan(z)] = np.nan
    return z, c


@pytest.mark.parametrize("seed, h, w, levels, holes, tile, merge", [(1, 17, 23, 4, 0.0, 3, 2), (2, 20, 20, 1000, 0.0, 4, 2), (3, 25, 13, 3, 0.35, 2, 3), (4, 9, 40, 1, 0.0, 5, 2), (5, 6, 6, 5, 0.1, 100, 4), (6, 1, 30, 9, 0.0, 4, 4)])
def test_any_tiling_is_the_definition(spark, seed, h, w, levels, holes, tile, merge):
    z, c = made(seed, h, w, levels, holes)
    tree = sorted(tuple(r) for r in T.spanning_tree(frame(spark, c), tile, merge).collect())
    assert tree == sorted(kruskal(c))
    got = {(r.y, r.x): r.v for r in T.tree_filter(frame(spark, z), frame(spark, c), 2.0, 1, tile, merge).collect()}
    want = dense(z, c, 2.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_iterations_and_odd_rows(spark):
    z, c = made(7, 8, 9, 4, 0.0)
    once = np.array([dense(z, c, 3.0)[k] for k in np.ndindex(z.shape)]).reshape(z.shape)
    got = {(r.y, r.x): r.v for r in T.tree_filter(frame(spark, z).withColumn("C", F.lit(1)), frame(spark, c), 3.0, 2, 3, 2).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in dense(once, c, 3.0).items())
    assert T.tree_filter(frame(spark, z).limit(0), frame(spark, c), 3.0).count() == 0
    twice = frame(spark, z).union(frame(spark, z - 1)).union(frame(spark, np.full((1, 1), np.nan)))
    assert {(r.y, r.x): r.v for r in T.tree_filter(twice, frame(spark, c), 3.0, 1, 4).collect()} == pytest.approx(dense(z, c, 3.0))
    (one,) = T.tree_filter(frame(spark, z).filter("y = 0 and x = 0"), frame(spark, c), 3.0).collect()
    assert abs(one.v - z[0, 0]) < 1e-12


def test_rounds_on_a_long_chain():
    n = 20_000
    keep = np.zeros(n, bool)
    keep[[0, n // 2]] = True
    r = T.Rounds(n, np.arange(n - 1), np.arange(1, n), keep)
    assert len(r.alive) == 1 and r.left.sum() == 2 and len(r.steps) < 80


def test_order_of_rows_changes_no_region():
    """The skeleton's edges are found again when the rows of a region come in another order."""
    z, c = made(1, 40, 40, 50, 0.0)
    key, size, rows = (1, 1), 16, []
    inside = lambda k: (k // T.WIDE // size, k % T.WIDE // size) == key
    for y, x in np.argwhere(~np.isnan(z)):
        if inside(y * T.WIDE + x):
            rows.append(T._rows(kind=T.NODE, u=np.array([y * T.WIDE + x]), p=z[y, x], q=1.0))
    for a, b, d in kruskal(c):
        for u, v in ((a, b), (b, a)):
            if inside(u) and (u < v or not inside(v)):
                rows.append(T._rows(kind=T.EDGE if inside(v) else T.STUB, u=np.array([u]), v=np.array([v]), w=np.exp(-d / 10)))
    pdf = pd.concat(rows, ignore_index=True)
    up = T.Region(key, size, pdf).skeleton()
    known = up[up["kind"].isin([T.NODE, T.EDGE])]
    assert (known["kind"] == T.EDGE).sum() > 10
    want = T.Region(key, size, pdf).solve(known)[0]
    for seed in range(10):
        region = T.Region(key, size, pdf.sample(frac=1, random_state=seed))
        assert np.allclose(region.solve(known)[0], want)
