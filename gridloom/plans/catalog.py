"""Registry of the named queries over the test tables and of their SQL twins.

Each query applies one operator to a whole table. Doubles are rounded so that summation order
doesn't show. The twins use other formulations than the operators: joins on coordinates
where those scatter and group, window frames where those aggregate, and so on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy, xmltext
from ..operators import corners, focal, linalg, matching, postfilter, raster, sensor, wallis
from ..sources import files
from ..sources.storage import save
from . import views as V
from .registry import QUERIES, Query, query, rounded
from .twins import TWINS

# pixels, statistics, element-wise maps


@query
def pixels_from_arrays(s, d):
    return V.dsm(s, d)


@query
def raster_stats(s, d):
    return rounded(raster.statistics(V.dsm(s, d)))


@query
def intensity_match(s, d):
    return rounded(matching.match_intensity(V.dsm(s, d), V.dsm2(s, d)))


@query
def minmax_stretch(s, d):
    return rounded(raster.minmax_stretch(V.dsm(s, d)))


@query
def gray_luma(s, d):
    g = V.gray(s, d)
    return rounded(raster.luma(g.select("y", "x", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), (F.col("v") / 2).alias("b"))))


@query
def bands_interleave(s, d):
    g = V.gray(s, d)
    bands = raster.columns_to_bands(g.select("y", "x", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), (F.col("v") / 2).alias("b")), ["r", "g", "b"])
    return rounded(raster.bands_to_columns(raster.rgb_bands(bands), ["r", "g", "b"]))


@query
def pyramid_avg(s, d):
    return rounded(raster.pyramid(V.dsm(s, d), 3))


@query
def aoi_crop(s, d):
    return raster.crop(V.dsm(s, d), 100, 10, 50, 20)


@query
def nodata_restore(s, d):
    px = V.u16(s, d)
    return raster.restore_nodata(px.select("y", "x", (F.col("v") + 1).alias("v")), px)


@query
def pixel_to_geo(s, d):
    x, y = raster.to_geo(F.col("x"), F.col("y"), TRANSFORM)
    return rounded(V.dsm(s, d).select("y", "x", x.alias("geo_x"), y.alias("geo_y")))


@query
def geo_to_pixel(s, d):
    col, row = raster.to_geo(F.col("lon"), F.col("lat"), raster.invert_transform(TRANSFORM))
    return rounded(V.points(s, d).select("id", col.alias("col"), row.alias("row")))


TRANSFORM = [500000.0, 0.5, 0.01, 4100000.0, 0.02, -0.5]


@query
def point_values(s, d):
    at = V.points(s, d).select("id", F.pmod(F.col("id") * 37, F.lit(600)).alias("y"), F.pmod(F.col("id") * 11, F.lit(70)).cast("int").alias("x"))
    return raster.sample_points(at, V.dsm(s, d)).select("id", "y", "x", "v")


@query
def tile_mosaic(s, d):
    """Overlapping tiles that differ by a constant each, feathered into one raster."""
    tiles = raster.cut_tiles(V.dsm(s, d), 4, 20)
    return rounded(raster.mosaic(tiles.withColumn("v", F.col("v") + F.pmod(F.col("ty") + 2 * F.col("tx"), F.lit(3)) * 10), 4, 20))


# neighbourhoods


@query
def laplacian3x3(s, d):
    return rounded(focal.laplacian(V.dsm(s, d)))


@query
def gradient_xy(s, d):
    return rounded(focal.gradient(V.dsm(s, d)))


@query
def bilinear_sample(s, d):
    at = V.points(s, d).select("id", (F.pmod(F.col("id") * 37, F.lit(600)) - 0.75).alias("py"), (F.pmod(F.col("id") * 11, F.lit(70)) - 0.5).alias("px"))
    return rounded(focal.bilinear(at, V.dsm(s, d)))


@query
def box_mean(s, d):
    return rounded(focal.box_mean(V.dsm(s, d), 2))


@query
def bilateral3x3(s, d):
    return rounded(focal.bilateral(V.dsm(s, d), V.gray(s, d), 30.0, 2.0, 0.2))


@query
def guided_filter(s, d):
    return rounded(focal.guided(V.dsm(s, d), V.gray(s, d), 2, 10.0))


@query
def weighted_median3x3(s, d):
    return rounded(focal.weighted_median(V.dsm(s, d), V.gray(s, d), 30.0))


@query
def census3x3(s, d):
    return focal.census(V.gray(s, d))


@query
def harris_response(s, d):
    return rounded(focal.harris(V.dsm(s, d)))


# features


@query
def tile_top1_features(s, d):
    px = V.dsm(s, d)
    return rounded(matching.features(px, *V.size(px), 16))


def _fast(n: int) -> None:
    def scored(s, d):
        return corners.scores(V.gray(s, d), n, 20)

    scored.__name__ = f"fast{n}_score"
    query(scored)


for _n in (9, 10, 11, 12):
    _fast(_n)


@query
def fast9_detect(s, d):
    return corners.detect(V.gray(s, d), 9, 20)


@query
def nms_8neighbour(s, d):
    return focal.suppress(V.gray(s, d).filter("v > 100").select("y", "x", F.col("v").cast("int").alias("score")))


@query
def fast9_detect_nms(s, d):
    return corners.detect_nms(V.gray(s, d), 9, 20)


# radiometry


@query
def wallis_grid(s, d):
    px = V.u16(s, d)
    return rounded(wallis.grid(px, *V.size(px)))


@query
def wallis_apply(s, d):
    px = V.u16(s, d)
    return wallis.enhance(px, *V.size(px))


# matching


@query
def lsm_one_step(s, d):
    one, two = V.dsm(s, d), V.dsm2(s, d)
    size = V.size(one)
    feats = matching.strongest_per_tile(one, *size, 16)
    return rounded(matching.one_step(one, focal.gradient(two), two, feats, 3, *size))


@query
def lsm_iterative(s, d):
    one = V.dsm(s, d)
    return rounded(matching.system_bias(one, V.dsm2(s, d), *V.size(one), 16, 7))


@query
def zncc(s, d):
    a, b = V.dsm(s, d), V.gray(s, d)
    pairs = a.withColumnRenamed("v", "v1").join(b.withColumnRenamed("v", "v2"), ["y", "x"])
    return rounded(matching.zncc(pairs, "y"))


@query
def census_match(s, d):
    code = focal.census(V.gray(s, d))
    right = code.select("y", (F.col("x") - 1).alias("x"), F.col("code").alias("other"))
    return code.join(right, ["y", "x"]).select("y", "x", matching.census_distance(F.col("code"), F.col("other")).alias("distance"))


@query
def median_center(s, d):
    return rounded(matching.median_of(V.table(s, d, "events"), "value", "event_type"))


@query
def weighted_center(s, d):
    return rounded(matching.weighted_centre(V.table(s, d, "lineitem"), {"center": (F.col("l_quantity"), F.col("l_discount") - 0.05)}, {"center": 0.02}, "l_returnflag"))


@query
def ratio_test(s, d):
    cand = V.table(s, d, "orders").select(F.col("o_custkey").alias("feature"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("score"))
    return matching.best_with_ratio(cand, 0.8, "feature")


@query
def intersection_outliers(s, d):
    li = V.table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return matching.median_outliers(li, "o_totalprice", 2.0, "o_orderpriority").select("o_orderkey", "inlier")


@query
def repeated_features(s, d):
    return matching.repeated(V.coo(s, d), "i", "j")


@query
def point_in_quad(s, d):
    quad = [(-100.0, -50.0), (90.0, -60.0), (120.0, 55.0), (-80.0, 40.0)]
    return V.points(s, d).filter(matching.in_quad(F.col("lon"), F.col("lat"), quad)).select("id")


@query
def connected_tracks(s, d):
    """Every eleventh order: few enough links for the recursive SQL twin."""
    return matching.tracks(V.links(s, d).filter("o_orderkey % 11 = 0").select("a", "b"))


@query
def connected_tracks_all(s, d):
    return matching.tracks(V.links(s, d).select("a", "b"))


# linear algebra


@query
def normal_equations(s, d):
    return rounded(linalg.normal_equations(V.regression(s, d), ["x0", "x1", "x2"], "y", "g"), 3)


@query
def ols_fit(s, d):
    fit = linalg.ols(V.regression(s, d), ["x0", "x1"], "y", "g")
    return rounded(fit.select("g", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope")), 4)


@query
def ridge_fit(s, d):
    fit = linalg.ridge(V.regression(s, d), ["x0", "x1"], "y", [100.0, 1000.0], "g")
    return rounded(fit.select("g", "alpha", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope")), 4)


@query
def gram_svd(s, d):
    return rounded(linalg.gram_eigen(V.regression(s, d), ["x1", "x2", "x3"], "g"), 4)


@query
def thin_qr(s, d):
    return rounded(linalg.thin_r(V.regression(s, d), ["x0", "x1", "x2"]), 4)


@query
def conjugate_gradient(s, d):
    """All suppliers over all parts; the solution is about 1e-7, so 14 digits."""
    a = linalg.from_triplets(V.coo(s, d))
    g = linalg.multiply(a, linalg.transpose(a))
    m = save(g.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") * 2).otherwise(F.col("v")).alias("v")), "cg-matrix")  # every step reads it
    return rounded(linalg.conjugate_gradient(m, m.filter("i = j").select("i", F.lit(1.0).alias("v")), steps=60).select("i", "v"), 14)


@query
def matmul_coo(s, d):
    """Parts up to 50: few enough rows to compare with the SQL twin."""
    a = linalg.from_triplets(V.coo(s, d))
    return rounded(linalg.multiply(linalg.transpose(a).filter("i <= 50"), a.filter("j <= 50")), 4)


@query
def matmul_coo_all(s, d):
    a = linalg.from_triplets(V.coo(s, d))
    return rounded(linalg.multiply(linalg.transpose(a), a), 4)


@query
def mat_add(s, d):
    return rounded(linalg.add(V.coo(s, d), V.coo2(s, d)), 4)


@query
def mat_transpose(s, d):
    return rounded(linalg.transpose(linalg.from_triplets(V.coo(s, d))), 4)


@query
def triplets_sum(s, d):
    return rounded(linalg.from_triplets(V.coo(s, d)), 4)


@query
def sparse_union_sub(s, d):
    a, b = linalg.from_triplets(V.coo(s, d)), linalg.from_triplets(V.coo2(s, d))
    return rounded(linalg.combine(a, b, lambda x, y: x - y), 4)


@query
def sparse_hadamard(s, d):
    return rounded(linalg.hadamard(linalg.from_triplets(V.coo(s, d)), linalg.from_triplets(V.coo2(s, d))), 4)


@query
def sparse_dot(s, d):
    return rounded(linalg.dot(linalg.from_triplets(V.coo(s, d)), linalg.from_triplets(V.coo2(s, d))), 3)


@query
def matrix_reductions(s, d):
    return rounded(linalg.whole(V.coo(s, d)), 3)


@query
def argmax_cell(s, d):
    return linalg.arg_extremes(linalg.from_triplets(V.coo(s, d)))


@query
def row_norms(s, d):
    return rounded(linalg.by_line(V.coo(s, d), "i").drop("product"), 4)


@query
def bool_reductions(s, d):
    return linalg.truths(V.coo(s, d), F.col("v") > 10)


@query
def inverse2x2(s, d):
    o = V.table(s, d, "lineitem")
    i = linalg.inverse2(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.lit(1.0))
    return rounded(o.select("l_orderkey", "l_linenumber", *[e.alias(n) for e, n in zip(i, ("a", "b", "c", "d"))]))


@query
def bbox_merge(s, d):
    p = V.points(s, d)
    k = F.col("id") % 10
    boxes = p.select(k.alias("k"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 30).alias("x1"), (F.col("lat") + 20).alias("y1"))
    return rounded(linalg.box_merge(boxes, "k"))


@query
def elementwise_maths(s, d):
    v = F.col("l_quantity")
    return rounded(V.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(v - 25).alias("absolute"), (v * v).alias("squared"), F.exp(-v / 10).alias("exponential"), F.log(v).alias("logarithm"), F.log1p(v).alias("log_plus"), F.log10(v).alias("decadic"),
        F.sqrt(v).alias("root"), (1 / F.sqrt(v)).alias("inverse_root"), F.signum(v - 25).alias("sign"), F.cos(v).alias("cosine"), F.sin(v).alias("sine"), F.atan(v).alias("arc_tangent"), F.tanh(v / 50).alias("hyperbolic"),
        F.pow(v, F.lit(3)).alias("cube"), F.floor(v / 3).cast("double").alias("lower"), F.ceil(v / 3).cast("double").alias("upper"), F.greatest(v, F.lit(25.0)).alias("larger"), F.when(v > 25, v).otherwise(-v).alias("chosen"),
    ))


# geodesy


@query
def utm_forward(s, d):
    p = V.points(s, d)
    return rounded(p.select("id", *[c.alias(n) for n, c in geodesy.utm_forward(F.col("lat"), F.col("lon")).items()]), 4)


@query
def utm_inverse(s, d):
    p = V.points(s, d).select("id", (F.lit(300000.0) + F.col("id") % 1000 * 400).alias("e"), (F.col("id") % 900 * 10000.0).alias("n"), (F.col("id") % 60 + 1).alias("z"), (F.col("id") % 2 == 0).alias("north"))
    return rounded(p.select("id", *[c.alias(n) for n, c in geodesy.utm_inverse(F.col("e"), F.col("n"), F.col("z"), F.col("north")).items()]))


@query
def utm_zone(s, d):
    lat, lon = F.col("lat"), F.col("lon")
    return V.points(s, d).select("id", geodesy.zone_raw(lon).alias("raw_zone"), geodesy.zone_number(lat, lon).alias("zone"))


@query
def zone_letter_a(s, d):
    return V.points(s, d).select("id", geodesy.zone_letter(F.col("lat") * 1.1).alias("letter"))


@query
def zone_letter_b(s, d):
    return V.points(s, d).select("id", geodesy.zone_letter_open(F.col("lat") * 1.1).alias("letter"))


@query
def lon_wrap(s, d):
    return rounded(V.points(s, d).select("id", geodesy.wrap_longitude(F.col("lon") * 3).alias("lon")))


@query
def ellipsoid_lookup(s, d):
    k = V.points(s, d).select(F.col("id").alias("point"), (F.col("id") % 23 + 1).cast("int").alias("id"))
    return k.join(F.broadcast(geodesy.ellipsoids(s)), "id").select("point", "name", "radius", "ecc2")


@query
def rpc_project(s, d):
    return rounded(_rpc_lines(s, d))


def _rpc_lines(s, d):
    p = V.points(s, d)
    num = lambda k: F.array(*[F.lit(1.0 / (i + k)) for i in range(20)])
    den = F.array(F.lit(1.0), *[F.lit(0.001)] * 19)
    scal = {"line_off": 500.0, "samp_off": 400.0, "lat_off": 0.0, "long_off": 0.0, "height_off": 100.0, "line_scale": 500.0, "samp_scale": 400.0, "lat_scale": 90.0, "long_scale": 180.0, "height_scale": 300.0}
    m = F.struct(*[F.lit(v).alias(n) for n, v in scal.items()], num(1).alias("line_num"), den.alias("line_den"), num(2).alias("samp_num"), den.alias("samp_den"))
    line, samp = sensor.project(F.col("m"), F.col("lat"), F.col("lon"), F.lit(150.0))
    return p.withColumn("m", m).select("id", line.alias("line"), samp.alias("samp"))


@query
def footprint_area(s, d):
    x, y = F.col("lon"), F.col("lat")
    return rounded(V.points(s, d).select("id", sensor.quad_area([x, x + 2, x + 3, x], [y, y + 0.5, y + 2, y + 1]).alias("area")))


# text of markup


@query
def xml_entities(s, d):
    return V.table(s, d, "pages").select("page_id", xmltext.decode(F.col("html")).alias("decoded"))


@query
def xml_encode(s, d):
    return V.table(s, d, "pages").select("page_id", xmltext.encode(F.col("html")).alias("encoded"))


@query
def xml_condense(s, d):
    return V.table(s, d, "documents").select("doc_id", xmltext.condense(F.col("text")).alias("condensed"))


@query
def typed_attributes(s, d):
    t = F.concat(F.col("p_size").cast("string"), F.lit("abc"))
    b = F.element_at(F.array(*[F.lit(x) for x in ("true", "Yes", "1abc", "false", "NO", "0", "maybe")]), (F.col("p_size") % 7 + 1).cast("int"))
    return V.table(s, d, "part").select("p_partkey", xmltext.int_attribute(t).alias("whole"), xmltext.double_attribute(F.concat(t, F.lit("1.5"))).alias("number"), xmltext.bool_attribute(b).alias("truth"))


@query
def file_names(s, d):
    path = F.concat(F.lit("C:\\data/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(".tif"))
    return V.table(s, d, "part").select("p_partkey", files.file_name(path).alias("name"), files.folder_name(path).alias("folder"))


# post-filters


def _post(name: str, **parameters) -> None:
    def run(s, d):
        return rounded(postfilter.apply(V.dsm(s, d), V.gray(s, d), name, tile=64, **parameters))

    run.__name__ = f"post_{name}"
    query(run)


_post("bilateral", radius=2, iterations=2)
_post("guided_image", radius=2, iterations=2)
_post("guided_median", radius=2, iterations=2)
_post("local_patch", radius=2, iterations=2)
_post("tree_filter", radius=2, iterations=1)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)


from . import algebra, filters, photogrammetry, terrain  # noqa: E402, F401  # they add their queries and twins
