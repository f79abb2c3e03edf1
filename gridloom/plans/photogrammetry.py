"""Queries over sensor models, points and image pairs, with their SQL twins.

Where an operator inverts another one, the twin is the input itself: what is projected and traced back, or seen by
several images and intersected, must come out where it was.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal, matching, raster, sensor
from . import views as V
from .registry import query, rounded
from .twins import GRAD, OFFSETS, r, twin


@query
def rpc_image_to_ground(s, d):
    """Points to image places and back at their height."""
    obs = V.observations(s, d).join(V.ground(s, d).select("point", "height"), "point")
    g = sensor.image_to_ground(F.col("model"), F.col("line"), F.col("samp"), F.col("height"))
    return rounded(obs.withColumn("g", g).select("point", "image", "g.lat", "g.lon"))


twin("rpc_image_to_ground", "ground seen", f"SELECT point, image, {r('lat', 'lat')}, {r('lon', 'lon')} FROM ground JOIN seen USING (point)")


@query
def rpc_derivatives(s, d):
    """The 20 terms' derivatives by latitude at a point."""
    p, l, h = F.col("lat") / 90, F.col("lon") / 180, F.col("height") / 300
    every = F.array(*[F.round(sensor.monomial_derivative(k, "p", p, l, h), 9) + 0.0 for k in range(20)])
    return V.ground(s, d).select("point", F.posexplode(every).alias("term", "value"))


_D = ["0", "0", "1", "0", "l", "0", "h", "0", "2 * p", "0", "l * h", "0", "2 * l * p", "0", "l * l", "3 * p * p", "h * h", "0", "2 * p * h", "0"]
twin("rpc_derivatives", "ground", "SELECT point, (i - 1)::INT AS term, round(v[i], 9) + 0.0 AS value FROM (SELECT point, [" + ", ".join(f"({x})::DOUBLE" for x in _D) + "] AS v FROM (SELECT point, lat / 90 AS p, lon / 180 AS l, height / 300 AS h FROM ground)), unnest(range(1, 21)) AS u(i)")


@query
def forward_intersection(s, d):
    found = sensor.forward_intersection(V.observations(s, d))
    return rounded(found.select("point", "lat", "lon", "height", "images"), 5)


twin("forward_intersection", "ground seen", f"SELECT point, {r('lat', 'lat', 5)}, {r('lon', 'lon', 5)}, {r('height', 'height', 5)}, images FROM ground JOIN (SELECT point, count(*) AS images FROM seen GROUP BY point) USING (point)")


@query
def control_bias(s, d):
    """Biases of images that were seen moved by their number."""
    moved = V.observations(s, d).withColumn("line", F.col("line") + F.col("image") * 0.5).withColumn("samp", F.col("samp") - F.col("image") * 0.25)
    return rounded(sensor.bias_from_control(moved, V.ground(s, d)).select("image", "drow", "dcol", "n"))


twin("control_bias", "seen", f"SELECT image, {r('0.5::DOUBLE * image', 'drow')}, {r('0 - 0.25::DOUBLE * image', 'dcol')}, count(*) AS n FROM seen GROUP BY image")


@query
def bias_equations(s, d):
    moved = V.observations(s, d).withColumn("line", F.col("line") + F.col("image") * 0.5)
    return rounded(sensor.bias_equations(moved, V.ground(s, d)).select("image", "n", "l_row", "l_col"), 4)


twin("bias_equations", "seen", f"SELECT image, count(*) AS n, {r('0.5::DOUBLE * image * count(*)', 'l_row', 4)}, 0.0::DOUBLE AS l_col FROM seen GROUP BY image")


@query
def bundle_adjustment(s, d):
    """All images but number 0 were moved; adjustment relative to it. No twin: tests hold it against the moves."""
    moved = V.observations(s, d).withColumn("line", F.col("line") + F.col("image") % 3 * 0.5)
    return rounded(sensor.bundle_adjust(moved, F.col("image") % 5 == 0), 3)


@query
def image_corners(s, d):
    """Corners on the ground, projected back into the image."""
    c = sensor.corners(V.images(s, d)).join(V.images(s, d).select("image", "model"), "image")
    line, samp = sensor.project(F.col("model"), F.col("lat"), F.col("lon"), F.col("model")["height_off"])
    return rounded(c.select("image", "corner", line.alias("line"), samp.alias("samp")), 4)


twin("image_corners", "", "SELECT n_nationkey AS image, corner::INT AS corner, CASE WHEN corner >= 2 THEN 9999.0::DOUBLE ELSE 0.0::DOUBLE END AS line, CASE WHEN corner IN (1, 2) THEN 7999.0::DOUBLE ELSE 0.0::DOUBLE END AS samp FROM nation, (SELECT unnest(range(4)) AS corner)")


@query
def ground_sampling(s, d):
    """No twin: tests hold it against a camera of known size."""
    small = V.images(s, d).withColumn("rows", F.lit(11)).withColumn("cols", F.lit(11))
    m = F.col("model").withField("line_off", F.lit(5.0)).withField("samp_off", F.lit(5.0)).withField("lat_scale", F.lit(0.01)).withField("long_scale", F.lit(0.01)).withField("line_scale", F.lit(5.0)).withField("samp_scale", F.lit(5.0)).withField("lat_off", F.lit(45.0)).withField("long_off", F.lit(3.0))
    return rounded(sensor.ground_sampling(small.withColumn("model", m)), 4)


@query
def mean_height(s, d):
    return rounded(sensor.mean_height(V.images(s, d)))


twin("mean_height", "", "SELECT avg(100.0::DOUBLE) AS height FROM nation")


@query
def footprint_overlap(s, d):
    p = V.points(s, d)
    side = (F.col("id") % 5) * 3 + 4
    return rounded(sensor.overlaps(p.select("id", F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + side).alias("x1"), (F.col("lat") + side / 2).alias("y1")), 12.0))


twin(
    "footprint_overlap", "pts",
    f"SELECT a, b, {r('dx * dy', 'area')}, {r('dx * dy / least(sa, sb)', 'share')} FROM (SELECT p.id AS a, q.id AS b, least(p.x1, q.x1) - greatest(p.x0, q.x0) AS dx, least(p.y1, q.y1) - greatest(p.y0, q.y0) AS dy, "
    "(p.x1 - p.x0) * (p.y1 - p.y0) AS sa, (q.x1 - q.x0) * (q.y1 - q.y0) AS sb FROM boxes p JOIN boxes q ON p.id < q.id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1)",
    "boxes AS (SELECT id, lon AS x0, lat AS y0, lon + id % 5 * 3 + 4 AS x1, lat + (id % 5 * 3 + 4) / 2.0::DOUBLE AS y1 FROM pts)",
)


@query
def images_seen(s, d):
    return sensor.images_of(V.sightings(s, d))


twin("images_seen", "seen", "SELECT count(DISTINCT image) AS images FROM seen")


def _strips(s, d):
    return V.sightings(s, d).select("point", F.concat((F.col("image") % 4).cast("string"), F.lit("_"), F.floor(F.col("image") / 4).cast("string")).alias("image"))


@query
def best_patches(s, d):
    return sensor.best_patches(_strips(s, d), 1)


twin(
    "best_patches", "seen", "SELECT own, strip, patch, points FROM (SELECT *, row_number() OVER (PARTITION BY own, strip ORDER BY points DESC, patch) AS k FROM shared) WHERE k = 1",
    "part AS (SELECT DISTINCT point, image % 4 AS strip, image // 4 AS patch FROM seen), shared AS (SELECT a.patch AS own, b.strip, b.patch, count(*) AS points FROM part a JOIN part b USING (point) WHERE a.strip = 1 AND b.strip <> 1 GROUP BY ALL)",
)


@query
def strip_patches(s, d):
    """Patches of four strips in order, each against the one before. No twin: tests hold it against shifted models."""
    k = F.col("image")
    at = V.images(s, d).select((k % 4).alias("strip"), F.floor(k / 4).cast("int").alias("patch"), F.col("model").withField("lat_off", 10.0 - 3.0 * F.floor(k / 4)).alias("model"), "rows", "cols")
    return rounded(sensor.translations(at), 3)


@query
def rectified_places(s, d):
    """Places of a rectified raster to an image and back."""
    t, at = [-180.0, 0.5, 0.001, 80.0, 0.002, -0.5], V.points(s, d).select("id", (F.col("id") % 600 + 60.25).alias("x"), (F.col("id") % 250 + 40.5).alias("y"))
    at = at.withColumn("model", V.model(F.col("id") % 25))
    line, samp = sensor.to_original(t, F.col("model"), F.lit(150.0), F.col("x"), F.col("y"))
    back = sensor.to_rectified(t, F.col("model"), F.lit(150.0), F.col("line"), F.col("samp"))
    return rounded(at.withColumn("line", line).withColumn("samp", samp).withColumn("b", back).select("id", "b.x", "b.y"), 4)


twin("rectified_places", "pts", f"SELECT id, {r('id % 600 + 60.25::DOUBLE', 'x', 4)}, {r('id % 250 + 40.5::DOUBLE', 'y', 4)} FROM pts")

#: an affine camera over the test raster: line = 2 y + 0.25 x + 3, samp = 0.5 x + 0.125 y + 1 at y = -lat, x = lon
_AFFINE = {"line_num": {0: 3.0, 1: 0.25, 2: -2.0}, "samp_num": {0: 1.0, 1: 0.5, 2: -0.125}}


def _affine():
    one = {"line_off": 0.0, "samp_off": 0.0, "lat_off": 0.0, "long_off": 0.0, "height_off": 0.0, "line_scale": 1.0, "samp_scale": 1.0, "lat_scale": 1.0, "long_scale": 1.0, "height_scale": 1.0}
    row = lambda at: F.array(*[F.lit(at.get(k, 0.0)) for k in range(20)])
    return F.struct(*[F.lit(v).alias(n) for n, v in one.items()], *[row(_AFFINE.get(n, {0: 1.0})).alias(n) for n in ("line_num", "line_den", "samp_num", "samp_den")])


@query
def rectified_plane(s, d):
    px = V.dsm(s, d)
    return rounded(sensor.rectify(px.select("y", "x"), [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], _affine(), F.lit(0.0), px))


twin(
    "rectified_plane", "dsm",
    f"SELECT a.y, a.x::INT AS x, {r('sum((CASE WHEN j = 1 THEN py - iy ELSE 1 - (py - iy) END) * (CASE WHEN i = 1 THEN px - ix ELSE 1 - (px - ix) END) * coalesce(dsm.v, 0))', 'v')} FROM a, (VALUES (0), (1)) b(j), (VALUES (0), (1)) c(i) LEFT JOIN dsm ON dsm.y = iy + j AND dsm.x = ix + i GROUP BY a.y, a.x",
    "a AS (SELECT *, trunc(py)::BIGINT AS iy, trunc(px)::BIGINT AS ix FROM (SELECT y, x, 2.0::DOUBLE * y + 0.25::DOUBLE * x + 3 AS py, 0.5::DOUBLE * x + 0.125::DOUBLE * y + 1 AS px FROM dsm))",
)


@query
def epipolar_candidates(s, d):
    """Features of two images, seen by affine cameras whose lines differ by twice the height.

    The left feature at (l, s) may be at (l + 2 h, s) for heights 0 to 8; the right features are the left ones elsewhere."""
    at = V.points(s, d).select("id", F.pmod(F.col("id") * 37, F.lit(600)).cast("double").alias("line"), F.pmod(F.col("id") * 11, F.lit(700)).cast("double").alias("samp"))
    camera = lambda h: _affine().withField("line_num", F.array(*[F.lit({2: 1.0, 3: h}.get(k, 0.0)) for k in range(20)])).withField("samp_num", F.array(*[F.lit({1: 1.0}.get(k, 0.0)) for k in range(20)]))
    right = at.select((F.col("id") + 1_000_000).alias("id"), (F.col("line") + F.col("id") % 7).alias("line"), (F.col("samp") + F.col("id") % 3).alias("samp"))
    return rounded(sensor.epipolar_candidates(at, right, camera(0.0), camera(2.0), 0.0, 8.0, 1.0, 2.5))


twin(
    "epipolar_candidates", "", f"SELECT a.id, b.id + 1000000 AS candidate, {r('min(sqrt((a.line + 2 * h - b.line - b.id % 7) ** 2 + (a.samp - b.samp - b.id % 3) ** 2))', 'distance')} FROM f a, (SELECT unnest(range(9)) AS h) JOIN f b ON abs(a.samp - b.samp - b.id % 3) <= 2.5 AND abs(a.line + 2 * h - b.line - b.id % 7) <= 2.5 "
    "AND (a.line + 2 * h - b.line - b.id % 7) ** 2 + (a.samp - b.samp - b.id % 3) ** 2 <= 6.25 GROUP BY a.id, b.id",
    "f AS (SELECT c_custkey AS id, ((c_custkey * 37) % 600)::DOUBLE AS line, ((c_custkey * 11) % 700)::DOUBLE AS samp FROM customer)",
)


@query
def near_samples(s, d):
    line = [(k * 7.0 - 60, k * 13.0 - 120) for k in range(20)]
    xs, ys = (F.array(*[F.lit(p[i]) for p in line]) for i in (1, 0))
    return V.points(s, d).filter(sensor.near_samples(F.col("lon"), F.col("lat"), xs, ys, F.lit(5.0))).select("id")


twin("near_samples", "pts", "SELECT DISTINCT id FROM pts, (SELECT unnest(range(20)) AS k) WHERE (lat - (k * 7 - 60)) ** 2 + (lon - (k * 13 - 120)) ** 2 <= 25")


@query
def pair_match(s, d):
    """Features of a raster against the same raster one column further right."""
    one, two = V.dsm(s, d), V.dsm2(s, d)
    left = matching.strongest_per_tile(one, *V.size(one), 16).select((F.col("fy") * 64 + F.col("fx")).alias("id"), F.col("fy").alias("y"), F.col("fx").alias("x"))
    right = left.withColumn("x", F.col("x") - 1)
    near = left.join(right.select(F.col("id").alias("candidate"), "y"), "y").select("id", "candidate")  # those of the same row
    return rounded(matching.pair_match(near, left, right, one, two, 3, 0.8, 0.9))


TOP = "top AS (SELECT y, x FROM (SELECT y, x, row_number() OVER (PARTITION BY (y - 1) // 16, (x - 1) // 16 ORDER BY abs(v) DESC, y, x) AS k FROM dsm, dims WHERE y >= 1 AND x >= 1 AND 1 + (y - 1) // 16 * 16 < h - 16 AND 1 + (x - 1) // 16 * 16 < w - 16) WHERE k = 1)"
twin(
    "pair_match", "dsm dsm2 dims", f"SELECT id, candidate, {r('score', 'score')} FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY id ORDER BY score DESC, candidate)) WHERE k = 1 AND (second IS NULL OR second <= 0.8 * score) AND score >= 0.9",
    f"{TOP}, c AS (SELECT a.y * 64 + a.x AS id, b.y * 64 + b.x AS candidate, a.y AS ay, a.x AS ax, b.y AS \"by\", b.x - 1 AS bx FROM top a JOIN top b USING (y)), wide AS (SELECT a.oy, b.ox FROM (SELECT unnest(range(-3, 4)) AS oy) a, (SELECT unnest(range(-3, 4)) AS ox) b), "
    "scored AS (SELECT id, candidate, corr(p.v, q.v) AS score FROM c, wide JOIN dsm p ON p.y = ay + oy AND p.x = ax + ox JOIN dsm2 q ON q.y = \"by\" + oy AND q.x = bx + ox GROUP BY id, candidate)",
)


@query
def modified_census(s, d):
    return matching.modified_census(V.gray(s, d))


_NINE = "CASE WHEN true THEN (dy + 1) * 3 + dx + 1 END"
twin(
    "modified_census", "dsm gray", f"SELECT y, x::INT AS x, sum(CASE WHEN v * 9 < total THEN 1 << ({_NINE}) ELSE 0 END)::INT AS code FROM (SELECT p.y, p.x, dy, dx, q.v, sum(q.v) OVER (PARTITION BY p.y, p.x) AS total, count(*) OVER (PARTITION BY p.y, p.x) AS c FROM gray p, off JOIN gray q ON q.y = p.y + dy AND q.x = p.x + dx) WHERE c = 9 GROUP BY y, x",
    OFFSETS,
)


@query
def orientation_score(s, d):
    return rounded(matching.orientation_score(V.dsm(s, d), V.gray(s, d), 16))


def _hog(t: str) -> str:
    g = GRAD.format(t=t).replace("grad AS", f"grad_{t} AS")
    return (
        f"{g}, bin_{t} AS (SELECT y // 16 AS wy, (x // 16)::BIGINT AS wx, least(floor((CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() WHEN atan2(gy, gx) >= pi() THEN 0 ELSE atan2(gy, gx) END) / (pi() / 9)), 8) AS bin, sum(sqrt(gx * gx + gy * gy)) AS w FROM grad_{t} WHERE gx <> 0 OR gy <> 0 GROUP BY ALL), "
        f"hist_{t} AS (SELECT wy, wx, bin, w / sqrt(sum(w * w) OVER (PARTITION BY wy, wx)) AS w FROM bin_{t})"
    )


twin("orientation_score", "dsm gray", f"SELECT wy, wx, {r('coalesce(sum(a.w * b.w), 0)', 'score')} FROM hist_dsm a FULL JOIN hist_gray b USING (wy, wx, bin) GROUP BY wy, wx", f"{_hog('dsm')}, {_hog('gray')}")


def _window_pairs(s, d):
    a, b = (px.join(focal.census(px), ["y", "x"]) for px in (V.gray(s, d), raster.unique(V.gray(s, d)).select("y", (F.col("x") - 1).alias("x"), "v")))
    both = a.select("y", "x", F.col("v").alias("v1"), F.col("code").alias("c1")).join(b.select("y", "x", F.col("v").alias("v2"), F.col("code").alias("c2")), ["y", "x"])
    return both.withColumn("wy", F.floor(F.col("y") / 8)).withColumn("wx", F.floor(F.col("x") / 8))


def _score(method: str) -> None:
    def scored(s, d):
        return rounded(matching.window_score(_window_pairs(s, d), method, "wy", "wx"))

    scored.__name__ = f"window_score_{method}"
    query(scored)
    bits = "1 - avg(bit_count(xor(a.code, b.code))) / 8.0::DOUBLE"
    score = {"zncc": "corr(a.v, b.v)", "census": bits, "census_zncc": f"((corr(a.v, b.v) + 1) / 2 + {bits}) / 2"}[method]
    code = "CASE WHEN dy = -1 THEN dx + 1 WHEN dy = 0 THEN CASE WHEN dx < 0 THEN 3 ELSE 4 END ELSE dx + 6 END"
    census = "{n} AS (SELECT p.y, p.x, any_value(p.v) AS v, sum(CASE WHEN q.v < p.v AND (dy <> 0 OR dx <> 0) THEN 1 << (" + code + ") ELSE 0 END)::INT AS code FROM {t} p, off JOIN {t} q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x)"
    twin(
        f"window_score_{method}", "dsm gray", f"SELECT a.y // 8 AS wy, (a.x // 8)::BIGINT AS wx, {r(score, 'score')} FROM one a JOIN two b ON b.y = a.y AND b.x = a.x GROUP BY ALL",
        f"{OFFSETS}, moved AS (SELECT y, x - 1 AS x, v FROM gray), {census.format(n='one', t='gray')}, {census.format(n='two', t='moved')}",
    )


for _m in matching.WINDOW_SCORES:
    _score(_m)


@query
def descriptor_flip(s, d):
    """Descriptors of 128 numbers from the embeddings, twice each."""
    e = V.table(s, d, "embeddings").select("vec_id", F.slice(F.concat("embedding", "embedding", "embedding", "embedding"), 1, 128).alias("d"))
    flat = e.select("vec_id", F.posexplode(matching.scaled_descriptor(matching.transposed_descriptor("d"))).alias("k", "v"))
    return flat.select("vec_id", "k", F.round(F.col("v").cast("double"), 4).alias("v"))


twin(
    "descriptor_flip", "", "SELECT vec_id, (32 * (3 - j) + 8 * i + (8 - t) % 8)::INT AS k, round((512 * d[1 + 32 * j + 8 * i + t])::DOUBLE, 4) AS v FROM (SELECT vec_id, list_concat(list_concat(embedding, embedding), list_concat(embedding, embedding))[1:128] AS d FROM embeddings), "
    "(SELECT unnest(range(4)) AS j), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(8)) AS t)",
)


@query
def image_angles(s, d):
    return rounded(V.points(s, d).select("id", matching.image_angle(F.radians("lon")).alias("angle")))


twin("image_angles", "pts", f"SELECT id, {r('pi() / 2 - radians(lon)', 'angle')} FROM pts")


@query
def centre_in_space(s, d):
    """Gaussian-weighted centre of three coordinates."""
    li = V.table(s, d, "lineitem")
    values = {"x": (F.col("l_quantity"), F.col("l_discount") - 0.05), "y": (F.col("l_extendedprice"), F.col("l_tax") - 0.04), "z": (F.col("l_tax"), F.col("l_discount") - 0.03)}
    return rounded(matching.weighted_centre(li, values, {"x": 0.02, "y": 0.03, "z": 0.01}, "l_returnflag"), 4)


def _centre(v: str, at: str, sigma: float) -> str:
    w = f"exp(0 - ({at}) * ({at}) / (2 * {sigma * sigma}::DOUBLE))"
    return f"sum({w} * {v}) / sum({w})"


twin("centre_in_space", "", f"SELECT l_returnflag, {r(_centre('l_quantity', 'l_discount - 0.05', 0.02), 'x', 4)}, {r(_centre('l_extendedprice', 'l_tax - 0.04', 0.03), 'y', 4)}, {r(_centre('l_tax', 'l_discount - 0.03', 0.01), 'z', 4)} FROM lineitem GROUP BY l_returnflag")
