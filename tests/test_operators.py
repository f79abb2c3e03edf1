"""Hand-computed cases and invariants of the raster, matrix and geodesy operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import geodesy, xmltext
from gridloom.operators import corners, focal, linalg, matching, postfilter, raster, sensor, wallis
from gridloom.sources import files


def pixels(spark, rows):
    return spark.createDataFrame([(y, x, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "y long, x int, v double")


def as_dict(df):
    return {(r["y"], r["x"]): r["v"] for r in df.collect()}


def grid(df, h, w):
    out = np.full((h, w), np.nan)
    for (y, x), v in as_dict(df).items():
        out[y, x] = v
    return out


def test_laplacian_of_a_point_and_of_a_constant(spark):
    point = [[0.0] * 5 for _ in range(5)]
    point[2][2] = 1.0
    got = grid(focal.laplacian(pixels(spark, point)), 5, 5)
    want = np.zeros((5, 5))
    want[1:4, 1:4] = [[0.25, 0.5, 0.25], [0.5, -3, 0.5], [0.25, 0.5, 0.25]]
    assert np.allclose(got, want)
    flat = grid(focal.laplacian(pixels(spark, [[2.0] * 5] * 5)), 5, 5)
    assert flat[2, 2] == 0 and flat[0, 2] == -2 and flat[0, 0] == -3.5


def test_bilinear_truncates_towards_zero(spark):
    px = pixels(spark, [[0, 10], [20, 30]])
    at = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 1.5), (3, 0.0, -0.5)], "id int, py double, px double")
    assert {r["id"]: r["v"] for r in focal.bilinear(at, px).collect()} == {1: 15, 2: 5, 3: -5}


def test_tile_features_start_at_one(spark):
    assert [(r.fy, r.fx) for r in matching.strongest_per_tile(pixels(spark, [[0.0] * 5] * 5), 5, 5, 2).collect()] == [(1, 1)]
    assert matching.strongest_per_tile(pixels(spark, [[1.0] * 2] * 2), 2, 2, 4).count() == 0


def test_intensity_match(spark):
    got = matching.match_intensity(pixels(spark, [[0, 10]]), pixels(spark, [[0, 2]]))
    assert sorted(as_dict(got).values()) == [0, 10]


@pytest.mark.parametrize("n", [9, 10, 11, 12])
def test_corner_score(spark, n):
    rows = [[100.0] * 7 for _ in range(7)]
    for dy, dx in corners.RING16:
        rows[3 + dy][3 + dx] = 150.0
    got = [r for r in corners.scores(pixels(spark, rows), n, 20).collect() if (r.y, r.x) == (3, 3)]
    assert got[0].score == 49
    for dy, dx in corners.RING16[9:]:
        rows[3 + dy][3 + dx] = 100.0
    got = [r for r in corners.scores(pixels(spark, rows), n, 20).collect() if (r.y, r.x) == (3, 3)]
    assert bool(got) == (n == 9)


def test_suppression(spark):
    run = lambda c: sorted((r.y, r.x) for r in focal.suppress(spark.createDataFrame(c, "y long, x int, score int")).collect())
    assert run([(0, 5, 10), (0, 6, 10)]) == []
    assert run([(5, 5, 10), (5, 6, 9)]) == [(5, 5)]
    assert run([(5, 5, 10), (6, 6, 11)]) == [(6, 6)]
    assert run([]) == []


def test_wallis_constant_and_nodata(spark):
    rows = [[500.0] * 33 for _ in range(33)]
    g = wallis.grid(pixels(spark, rows), 33, 33).first()
    assert (g.r1, round(g.r0, 9)) == (1.0, 450.0)
    rows[4][4] = 0.0
    out = as_dict(wallis.enhance(pixels(spark, rows), 33, 33))
    assert out[4, 4] == 0 and out[0, 0] > 900
    with pytest.raises(ValueError):
        wallis.grid(pixels(spark, [[1.0]]), 1, 1)


def test_least_squares(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "a double, y double")
    assert linalg.ols(rows, ["a"], "y").first().beta == [2.0]
    r = linalg.ridge(rows, ["a"], "y", [1.0]).first()
    assert (r.alpha, round(r.beta[0], 12)) == (2.5, round(4 / 3, 12))
    with pytest.raises(ValueError):
        linalg.ridge(rows, ["a"], "y", [0.0])
    assert linalg.ols(rows.withColumn("b", F.col("a")), ["a", "b"], "y").first().beta is None


def test_thin_r_and_gram_agree(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((500, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double").repartition(7)
    r = np.array(sorted((tuple(x) for x in linalg.thin_r(df, ["a", "b", "c"]).collect()), key=lambda t: [v == 0 for v in t]))
    assert np.allclose(r.T @ r, a.T @ a)
    got = [x.singular_value for x in linalg.gram_eigen(df, ["a", "b", "c"]).orderBy("rank").collect()]
    assert np.allclose(got, np.linalg.svd(a, compute_uv=False))


def test_conjugate_gradient(spark):
    m = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 5]])
    md = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]], "i long, j long, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, v double")
    got = {r.i: r.v for r in linalg.conjugate_gradient(md, b).collect()}
    assert np.allclose([got[i] for i in range(3)], np.linalg.solve(m, [1, 2, 3]))


def test_inverse2(spark):
    r = spark.range(1).select(*linalg.inverse2(F.lit(4.0), F.lit(7.0), F.lit(2.0), F.lit(6.0))).first()
    assert np.allclose(r, [0.6, -0.7, -0.2, 0.4])
    assert list(spark.range(1).select(*linalg.inverse2(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(4.0))).first()) == [None] * 4


def test_geodesy_fixtures(spark):
    rows = [(0.0, 3.0), (45.0, 3.0), (40.0, -83.0), (-33.9, 151.2), (60.0, 4.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    got = [tuple(r) for r in df.select(*geodesy.utm_forward(F.col("lat"), F.col("lon")).values()).collect()]
    assert [g[0] for g in got] == [31, 31, 17, 56, 32]
    want = [(500000.0, 0.0), (500000.0, 4982950.400), (329274.506, 4429672.973), (333568.941, 6247473.337)]
    assert all(math.isclose(a, b, abs_tol=1e-3) for g, w in zip(got, want) for a, b in zip(g[1:], w))
    back = df.limit(4).select("lat", "lon", *[c.alias(n) for n, c in geodesy.utm_forward(F.col("lat"), F.col("lon")).items()])
    inv = geodesy.utm_inverse(F.col("easting"), F.col("northing"), F.col("zone"), F.col("lat") >= 0)
    for r in back.select("lat", "lon", *[c.alias(f"b_{n}") for n, c in inv.items()]).collect():
        assert abs(r.lat - r.b_lat) < 1e-6 and abs(r.lon - r.b_lon) < 1e-6
    letters = spark.createDataFrame([(84.5,), (-80.5,), (0.0,), (-8.0,), (84.0,)], "l double").select(geodesy.zone_letter(F.col("l")), geodesy.zone_letter_open(F.col("l"))).collect()
    assert [tuple(r) for r in letters] == [("Z", "X"), ("Z", "C"), ("N", "N"), ("M", "M"), ("X", "X")]
    assert [r[0] for r in spark.createDataFrame([(190.0,), (-190.0,), (180.0,)], "l double").select(geodesy.wrap_longitude(F.col("l"))).collect()] == [-170, -190, -180]
    z = spark.createDataFrame([("60 X",), ("17N",), ("5C",), ("x",)], "z string").select(geodesy.zone_prefix(F.col("z")), geodesy.is_north(F.col("z"))).collect()
    assert [tuple(r) for r in z][:3] == [(60, True), (17, True), (5, False)] and z[3][0] is None


def test_xml_text(spark):
    cases = ["a&lt;b &amp;amp; &#65;&#x42;", "&unknown; &", "&amp;lt;", "&#233;&#x20AC;&#x1F600;", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(xmltext.decode(F.col("t"))).collect()]
    assert got == ["a<b &amp; AB", "&unknown; &", "&lt;", "é€😀", "", None]
    back = spark.createDataFrame([("<a b='c'>&\"",)], "t string").select(xmltext.decode(xmltext.encode(F.col("t")))).first()[0]
    assert back == "<a b='c'>&\""
    r = spark.createDataFrame([("25abc", "1abc"), ("x", "maybe")], "a string, b string").select(xmltext.int_attribute(F.col("a")), xmltext.bool_attribute(F.col("b"))).collect()
    assert [tuple(x) for x in r] == [(25, True), (None, None)]


def test_project_file(spark, tmp_path):
    p = tmp_path / "project.xml"
    p.write_text("""<Main_prj_file><Output_Folder>o</Output_Folder><DSM_path>d.tif</DSM_path><Ortho_path>r.tif</Ortho_path>
      <Filtering_parameters><window_size>25</window_size><iteration_times>5</iteration_times><tile_size tile_x_size="1000" tile_y_size="1000" overlap_size="100" />
      <filtering_methods>patch_filtering</filtering_methods><common_paras Std_color="-1" Std_distance="-1" Std_disparity="-1" />
      <patch_filter_paras color_weight="0.3" distance_weight="0.3" disparity_weight="0.6" /></Filtering_parameters></Main_prj_file>""")
    r = files.read_project(spark, str(p)).first()
    assert (r.window_size, r.iterations, r.tile_x, r.overlap, r.method, r.disparity_weight) == (25, 5, 1000, 100, "local_patch", 0.6)


def test_small_files(spark, tmp_path):
    (tmp_path / "w.tfw").write_text("0.5\n0\n0\n-0.5\n10\n20\n")
    assert list(files.read_world_file(spark, str(tmp_path / "w.tfw")).drop("path").first()) == [0.5, 0, 0, -0.5, 10, 20]
    (tmp_path / "a.kml").write_text("<kml><coordinates>1,2,3 4,5,6</coordinates></kml>")
    r = files.read_kml_boxes(spark, str(tmp_path / "a.kml")).first()
    assert (r.points, r.min_lon, r.max_lat, r.height) == (2, 1.0, 5.0, 4.5)
    (tmp_path / "p.txt").write_text("1 2\n3,4\n\n")
    assert sorted(tuple(x) for x in files.read_points(spark, str(tmp_path / "p.txt")).collect()) == [(1, 2), (3, 4)]
    assert files.list_files(spark, str(tmp_path), "*.kml").first()["name"] == "a.kml"
    model = spark.createDataFrame([tuple([1.5] * 10 + [[0.25] * 20] * 4)], ", ".join([f"{n} double" for n in files.RPC_SCALARS] + [f"{n} array<double>" for n in files.RPC_ARRAYS]))
    files.write_rpc_text(model, str(tmp_path / "rpc"))
    back = files.read_rpc_text(spark, str(tmp_path / "rpc") + "/*.txt").first()
    assert back.line_off == 1.5 and back.samp_den == [0.25] * 20


def test_least_squares_matching_finds_a_shift(spark):
    y, x = np.mgrid[0:40, 0:40]
    img = lambda dx, dy: 100 + 20 * np.sin((x + dx) / 4.0) * np.cos((y + dy) / 5.0)
    feats = spark.createDataFrame([(20, 20), (18, 22)], "fy long, fx long")
    for r in matching.least_squares_match(pixels(spark, img(0.4, -0.3)), pixels(spark, img(0, 0)), feats, 5, 40, 40).collect():
        assert abs(r.dx - 0.4) < 0.05 and abs(r.dy + 0.3) < 0.05
    assert matching.plausible(spark.createDataFrame([(1.0, float("nan")), (0.5, 0.5), (3.0, 0.0), (None, 0.0)], "dx double, dy double")).count() == 1


@pytest.mark.parametrize("method", ["bilateral", "guided_image", "guided_median", "local_patch"])
def test_tiles_do_not_show(spark, method):
    rng = np.random.default_rng(5)
    z, c = rng.standard_normal((24, 20)), rng.uniform(0, 255, (24, 20))
    run = lambda tile: grid(postfilter.apply(pixels(spark, z), pixels(spark, c), method, radius=1, iterations=2, tile=tile), 24, 20)
    assert np.allclose(run(7), run(1000))


def test_filter_names(spark):
    px = pixels(spark, [[1.0, 2.0], [3.0, 4.0]])
    for bad in ("MLPA", "other"):
        with pytest.raises(ValueError):
            postfilter.apply(px, px, bad)
    assert postfilter.apply(px, px, "patch_filtering", radius=1, iterations=1).count() == 4


def test_tree_filter_is_a_weighted_mean(spark):
    z, c = pixels(spark, [[1.0, 5.0]]), pixels(spark, [[0.0, 2.0]])
    w = math.exp(-2)
    assert np.allclose(grid(postfilter.apply(z, c, "tree_filter", iterations=1, sigma_c=1.0), 1, 2), [[(1 + 5 * w) / (1 + w), (5 + w) / (1 + w)]])


def test_box_sum_of_sparse_pixels(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0), (9, 0, 4.0)], "y long, x int, v double")
    assert as_dict(focal.box_mean(px, 1)) == {(0, 0): 1.0, (0, 5): 2.0, (9, 0): 4.0}


def test_tracks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (5, 5), (9, 8)], "a long, b long")
    assert {r.node: r.track for r in matching.tracks(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5}


def test_mosaic_restores(spark):
    px = pixels(spark, np.arange(80).reshape(8, 10).tolist())
    got = raster.mosaic(raster.cut_tiles(px, 2, 5), 2, 5)
    assert np.allclose(grid(got, 8, 10), np.arange(80).reshape(8, 10))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=6, max_size=6).filter(lambda t: abs(t[1] * t[5] - t[2] * t[4]) > 1e-2))
def test_transform_round_trip(t):
    i = raster.invert_transform(t)
    c, r = 3.0, 7.0
    gx, gy = t[0] + t[1] * c + t[2] * r, t[3] + t[4] * c + t[5] * r
    scale = 1 + max(map(abs, i))
    assert abs(i[0] + i[1] * gx + i[2] * gy - c) < 1e-6 * scale and abs(i[3] + i[4] * gx + i[5] * gy - r) < 1e-6 * scale


def test_sensor_shift(spark):
    f = {n: 1.0 for n in files.RPC_SCALARS}
    m = F.struct(*[F.lit(v).alias(n) for n, v in f.items()], *[F.array(*[F.lit(float(i == k)) for i in range(20)]).alias(n) for n, k in zip(files.RPC_ARRAYS, (1, 0, 2, 0))])
    df = spark.range(1).withColumn("m", m)
    line, samp = sensor.project(F.col("m"), F.lit(3.0), F.lit(5.0), F.lit(1.0))
    assert tuple(df.select(line, samp).first()) == (5.0, 3.0)
    line, samp = sensor.project(sensor.shift(F.col("m"), F.lit(2.0), F.lit(1.0)), F.lit(3.0), F.lit(5.0), F.lit(1.0))
    assert tuple(df.select(line, samp).first()) == (3.0, 2.0)


def test_product_in_squares(spark):
    """Places of several squares, negative ones too; NULL values make no sum, NULL places meet nothing; no partial product is grouped."""
    rng = np.random.default_rng(11)
    cells = lambda: [(int(i), int(k), float(v)) for i, k, v in zip(rng.integers(-3000, 6000, 400), rng.integers(0, 30, 400), rng.integers(-3, 4, 400))]
    a, b = cells(), [(k, j, v) for j, k, v in cells()]
    a += [(1, 5, None), (9000, 50, None), (2, None, 4.0), (-2048, 51, 2.0), (None, 51, 5.0)]
    b += [(50, 7, 3.0), (None, 3, 1.0), (51, -1, 3.0), (51, -1, 4.0)]
    want = {}
    for i, k, v in a:
        for k2, j, w in b:
            if k is not None and k == k2:
                want.setdefault((i, j), []).append(None if v is None or w is None else v * w)
    frame = lambda rows: spark.createDataFrame(rows, "i long, j long, v double")
    out = linalg.multiply(frame(a), frame(b))
    got = {(r.i, r.j): r.v for r in out.collect()}
    assert got == {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
    assert "sum(" not in out._jdf.queryExecution().optimizedPlan().toString()
