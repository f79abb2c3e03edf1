"""Operators on tiles against whole arrays: tall rasters, holes, missing values, repeated pixels, empty rasters."""

import numpy as np
import pytest

from gridloom.operators import corners, focal, linalg, postfilter, raster
from gridloom.plans import views


def frame(spark, a, more=()):
    rows = [(int(y), int(x), None if np.isnan(a[y, x]) else float(a[y, x])) for y, x in np.argwhere(~np.isinf(a))]
    return spark.createDataFrame(rows + list(more), "y long, x int, v double")


def back(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r.v is None else r.v
    return out


def holes(shape, seed=3):
    """Values, pixels without a value (NaN) and places without a pixel (inf)."""
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 100, shape)
    kind = rng.random(shape)
    a[kind < 0.08] = np.nan
    a[kind > 0.92] = np.inf
    return a


def means(a, r):
    out = np.full(a.shape, np.nan)
    for y, x in np.argwhere(~np.isinf(a)):
        part = a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
        part = part[np.isfinite(part)]
        out[y, x] = part.mean() if len(part) else np.nan
    return out


@pytest.mark.parametrize("shape, radius", [((40, 30), 2), ((700, 3), 5), ((3, 600), 1), ((20, 20), 30)])
def test_box_mean(spark, shape, radius):
    a = holes(shape)
    px = frame(spark, a)
    got = focal.box_mean(px, radius)
    assert got.count() == px.count() and got.columns == ["y", "x", "v"]
    assert np.allclose(back(got, shape), means(a, radius), equal_nan=True)


def test_box_sums_are_dealt_by_blocks(spark):
    """One key a block in both directions, whatever the raster's shape, and each pixel once but for the rims."""
    px = spark.range(4000).selectExpr("id div 4 as y", "cast(id % 4 as int) as x", "double(id) as v")
    dealt = focal.deal(px, focal.TILE, 5)
    assert dealt.select("ty", "tx").distinct().count() >= 4 and dealt.filter("y between 20 and 200").groupBy("ty", "tx", "y").count().select("ty").distinct().count() == 1
    plan = focal.box_sum(px, 5, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(ty" in plan


def test_rings_on_a_tall_raster(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (600, 9)).astype(float)
    a[300, 4] = np.nan
    got = {(r.y, r.x): r.m for r in corners.strength(frame(spark, a), 9).collect()}
    want = {}
    for y in range(3, 597):
        for x in range(3, 6):
            d = np.array([a[y + dy, x + dx] - a[y, x] for dy, dx in corners.RING16])
            if np.isfinite(d).all():
                runs = [np.take(d, range(k, k + 9), mode="wrap") for k in range(16)]
                want[y, x] = max(max(q.min(), (-q).min()) for q in runs)
    assert got == want


def test_repeated_pixels_take_the_largest(spark):
    a = np.arange(49, dtype=float).reshape(7, 7)
    twice = [(3, 3, 5.0), (3, 3, 24.0), (0, 0, -9.0)]
    once = frame(spark, a)
    for op in (lambda p: focal.box_mean(p, 1), focal.harris, lambda p: corners.strength(p, 9).withColumnRenamed("m", "v"), raster.unique):
        assert np.allclose(back(op(frame(spark, a, twice)), (7, 7)), back(op(once), (7, 7)), equal_nan=True)


def test_empty_rasters(spark):
    none = spark.createDataFrame([], "y long, x int, v double")
    for op in (lambda p: focal.box_mean(p, 2), focal.harris, lambda p: corners.scores(p, 9, 20), focal.laplacian, focal.gradient, focal.census, lambda p: focal.weighted_median(p, p, 3.0), lambda p: focal.guided(p, p, 2, 1.0), lambda p: focal.bilateral(p, p, 1.0, 1.0, 1.0), raster.unique):
        assert op(none).collect() == []
    assert views.size(none) == (0, 0) and views.size(spark.createDataFrame([(0, 0, 1.0)], "y long, x int, v double")) == (1, 1)


def test_weighted_median_of_holes(spark):
    a = holes((12, 11), 5)
    got = back(focal.weighted_median(frame(spark, a), frame(spark, np.where(np.isinf(a), np.inf, 7.0)), 5.0), a.shape)
    for y, x in np.argwhere(~np.isinf(a)):
        part = a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        part = np.sort(part[np.isfinite(part)])
        want = part[(len(part) - 1) // 2] if len(part) else np.nan
        assert np.isclose(got[y, x], want, equal_nan=True)


def test_strips_do_not_matter(monkeypatch):
    rng = np.random.default_rng(0)
    z, c = rng.uniform(0, 9, (23, 17)), rng.uniform(0, 99, (23, 17))
    z[4, 5] = np.nan
    whole = postfilter.guided_median(z, c, 3, 10.0)
    monkeypatch.setattr(postfilter, "STRIP_CELLS", 2000)
    assert np.array_equal(postfilter.guided_median(z, c, 3, 10.0), whole, equal_nan=True)


# systems


def system(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.argwhere(a != 0)], "i long, j long, v double")


def vector(spark, b):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(b) if v], "i long, v double")


@pytest.mark.parametrize("solver", [linalg.conjugate_gradient, linalg.bicgstab])
def test_missing_diagonals_are_named(spark, solver):
    a = np.array([[2.0, 1.0], [1.0, 0.0]])
    with pytest.raises(ValueError, match="row 1 "):
        solver(system(spark, a), vector(spark, [1.0, 1.0]))
    stored = system(spark, a).union(spark.createDataFrame([(1, 1, 0.0)], "i long, j long, v double"))
    with pytest.raises(ValueError, match="row 1 "):
        solver(stored, vector(spark, [1.0, 1.0]))
    assert solver(system(spark, np.zeros((0, 0))), vector(spark, [])).collect() == []


def test_solvers_against_dense(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.4) + 8 * np.eye(12)
    b = np.where(np.arange(12) % 4 == 0, 0, rng.normal(size=12))  # rows without a right side
    solution = lambda df, key="i": np.array([r.v for r in df.orderBy(key).collect()])
    got = linalg.bicgstab(system(spark, a), vector(spark, b))
    assert np.allclose(solution(got), np.linalg.solve(a, b), atol=1e-7) and got.first().residual < 1e-8
    s = a @ a.T
    got = linalg.conjugate_gradient(system(spark, s), vector(spark, b), steps=40)
    assert np.allclose(solution(got), np.linalg.solve(s, b), atol=1e-6) and got.first().residual < 1e-8
    assert linalg.conjugate_gradient(system(spark, s), vector(spark, b), steps=1).first().residual > 1e-3
    tall = rng.normal(size=(9, 4)) + 1
    got = linalg.least_squares_cg(system(spark, tall), vector(spark, b[:9]), steps=12)
    assert np.allclose(solution(got, "j"), np.linalg.lstsq(tall, b[:9], rcond=None)[0], atol=1e-6)


@pytest.mark.parametrize("lower", [True, False])
def test_triangles(spark, lower):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(9, 9)) * (rng.random((9, 9)) < 0.5)
    np.fill_diagonal(a, 3.0)
    b = rng.normal(size=9)
    got = [r.v for r in linalg.triangular_solve(system(spark, a), vector(spark, b), lower).orderBy("i").collect()]
    assert np.allclose(got, np.linalg.solve(np.tril(a) if lower else np.triu(a), b))
    with pytest.raises(ValueError, match="longer"):
        linalg.triangular_solve(system(spark, np.tril(np.ones((4, 4)))), vector(spark, [1.0] * 4), steps=2)


def test_inverse_of_groups(spark):
    rows = [("a", 0, 0, 4.0), ("a", 0, 1, 7.0), ("a", 1, 0, 2.0), ("a", 1, 1, 6.0), ("b", 0, 0, 1.0), ("b", 0, 1, 2.0), ("b", 1, 0, 2.0), ("b", 1, 1, 4.0), ("c", 0, 0, 1.0), ("c", 0, 1, 1.0)]
    got = linalg.inverse(spark.createDataFrame(rows, "k string, i long, j long, v double"), "k").collect()
    assert {(r.i, r.j): round(r.v, 9) for r in got if r.k == "a"} == {(0, 0): 0.6, (0, 1): -0.7, (1, 0): -0.2, (1, 1): 0.4}
    assert sorted((r.k, r.i, r.v) for r in got if r.k != "a") == [("b", None, None), ("c", None, None)]


def test_random_numbers(spark):
    rows = spark.range(20_000).select(linalg.uniform("id", 3).alias("u"), linalg.random_index("id", 7, 4).alias("k"), linalg.uniform("id", 3).alias("again")).toPandas()
    assert ((rows.u >= 0) & (rows.u < 1)).all() and (rows.u == rows.again).all() and abs(rows.u.mean() - 0.5) < 0.01 and abs(rows.u.var() - 1 / 12) < 0.003
    assert set(rows.k) == set(range(7)) and rows.k.value_counts().min() > 2600


def test_orientation_of_points_in_one_place(spark):
    rows = [("one", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)] * 3 + [("none", None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = linalg.absolute_orientation(spark.createDataFrame(rows, "k string, x double, y double, z double, u double, v double, w double"), "k").collect()
    assert [(r.k, r.scale) for r in got] == [("one", None)]


def test_inverse_of_many_groups_in_batches(spark):
    """No Python call a group; odd groups among others of several sizes."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for k in range(300):
        n = 1 + k % 4
        a = rng.normal(size=(n, n)) + 3 * np.eye(n)
        rows += [(k, 10 * i, 7 - j, float(a[i, j])) for i in range(n) for j in range(n)]
        inv = np.linalg.inv(a)
        want |= {(k, 7 - j, 10 * i): inv[j, i] for i in range(n) for j in range(n)}
    rows += [(301, 0, 0, float("nan")), (302, 0, 0, None), (303, 0, 0, 0.0), (304, 0, 0, 1.0), (304, 0, 0, 3.0), (None, 1, 1, 2.0), (305, 0, 1, 1.0), (305, 1, 0, 1.0)]
    want |= {(304, 0, 0): 0.25, (None, 1, 1): 0.5, (305, 0, 0): 0.0, (305, 0, 1): 1.0, (305, 1, 0): 1.0, (305, 1, 1): 0.0}
    out = linalg.inverse(spark.createDataFrame(rows, "k long, i long, j long, v double"), "k")
    got = {(r.k, r.i, r.j): r.v for r in out.collect()}
    assert {k for k in got if k[1] is None} == {(k, None, None) for k in (301, 302, 303)} and len(got) == len(want) + 3
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
