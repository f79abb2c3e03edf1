"""Rational-function sensor models: projection both ways, intersection, adjustment, footprints.

The order of the 20 cubic terms is that of the public RPC00B form. A model is a struct column
with the scalar fields and the four coefficient arrays of :mod:`gridloom.sources.files`.

Images observe ground points: rows (point, image, model, line, samp). Sums over the images of a point, or the points
of an image, are grouped with map-side partial sums; nothing is collected. A NULL model, place or height gives NULL
coordinates; rows with NULL coordinates count in no sum; repeated observations count again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import utm_forward, zone_number
from ..sources.files import RPC_ARRAYS
from ..sources.storage import save
from .focal import bilinear

#: exponents of longitude l, latitude p and height h in the 20 terms; fixed values
EXPONENTS = (
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
    (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3),
)
NEWTON_STEPS = 8


def monomial(k: int, p: Column, l: Column, h: Column) -> Column:
    """Term k (from 0) at latitude p, longitude l, height h."""
    factors = [x for x, n in zip((l, p, h), EXPONENTS[k]) for _ in range(n)]
    out = F.lit(1.0)
    for f in factors:
        out = out * f
    return out


def monomial_derivative(k: int, by: str, p: Column, l: Column, h: Column) -> Column:
    """Derivative of term k by "p", "l" or "h"."""
    at = "lph".index(by)
    n = EXPONENTS[k][at]
    if not n:
        return F.lit(0.0)
    less = tuple(e - (j == at) for j, e in enumerate(EXPONENTS[k]))
    return n * monomial(EXPONENTS.index(less), p, l, h)


def terms(p: Column, l: Column, h: Column) -> Column:
    """The 20 monomials of latitude p, longitude l and height h."""
    return F.array(*[monomial(k, p, l, h) for k in range(20)])


def _poly(coefficients: Column, monomials: Column) -> Column:
    return F.aggregate(F.zip_with(coefficients, monomials, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def project(model: Column, lat: Column, lon: Column, height: Column) -> tuple[Column, Column]:
    """(line, sample) of a ground point. Sums are written out, as compiled code is many times as fast as functions of arrays."""
    m = lambda n: model[n]
    at = (lat - m("lat_off")) / m("lat_scale"), (lon - m("long_off")) / m("long_scale"), (height - m("height_off")) / m("height_scale")
    poly = lambda n: sum((F.get(m(n), F.lit(k)) * monomial(k, *at) for k in range(1, 20)), F.get(m(n), F.lit(0)))
    line = F.try_divide(poly("line_num"), poly("line_den")) * m("line_scale") + m("line_off")
    samp = F.try_divide(poly("samp_num"), poly("samp_den")) * m("samp_scale") + m("samp_off")
    return line, samp


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ratio(num: Column, den: Column, t: Column, derivatives: list[Column]) -> Column:
    """Value of num/den and its derivatives, from terms and the terms' derivatives; as an array."""
    parts = F.struct(_poly(num, t).alias("n"), _poly(den, t).alias("d"), *[_poly(c, x).alias(f"{name}{k}") for k, x in enumerate(derivatives) for name, c in (("n", num), ("d", den))])
    slope = lambda s, k: F.try_divide(s[f"n{k}"] - F.try_divide(s["n"], s["d"]) * s[f"d{k}"], s["d"])
    return _let(parts, lambda s: F.array(F.try_divide(s["n"], s["d"]), *[slope(s, k) for k in range(len(derivatives))]))


def _linearised(model: Column, p: Column, l: Column, h: Column, by: str) -> Column:
    """struct(line, samp): each an array of the normalised coordinate and its derivatives by the letters of ``by``."""
    vectors = F.struct(terms(p, l, h).alias("t"), *[F.array(*[monomial_derivative(k, c, p, l, h) for k in range(20)]).alias(c) for c in by])
    each = lambda v, n: _ratio(model[f"{n}_num"], model[f"{n}_den"], v["t"], [v[c] for c in by])
    return _let(vectors, lambda v: F.struct(each(v, "line").alias("line"), each(v, "samp").alias("samp")))


def image_to_ground(model: Column, line: Column, samp: Column, height: Column, steps: int = NEWTON_STEPS) -> Column:
    """struct(lat, lon) of an image place at a height: Newton steps from the model's centre, in Arrow batches. NULL where the
    model doesn't tell places apart. Convergence isn't tested: project the result to see how far it is off."""

    @F.arrow_udf("lat double, lon double")
    def run(model: pa.Array, line: pa.Array, samp: pa.Array, height: pa.Array) -> pa.Array:
        m, none = model_arrays(model)
        for v in (line, samp, height):
            none |= v.is_null().to_numpy(zero_copy_only=False)
        lat, lon, lost = grounded(m, *(v.to_numpy(zero_copy_only=False) for v in (line, samp, height)), steps)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=none | lost) for v in (lat, lon)], ["lat", "lon"])

    return run(model, *[c.cast("double") for c in (line, samp, height)])


def model_arrays(model: pa.StructArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of an array of models, and which of them lack one or have a list of other than 20 numbers."""
    none, m = model.is_null().to_numpy(zero_copy_only=False).copy(), {}
    for n in (f"{f}_{x}" for x in ("off", "scale") for f in ("lat", "long", "height", "line", "samp")):
        field = pc.struct_field(model, n)
        none |= field.is_null().to_numpy(zero_copy_only=False)
        m[n] = field.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for n in RPC_ARRAYS:
        field = pc.struct_field(model, n)
        short = pc.fill_null(pc.not_equal(pc.list_value_length(field), 20), True).to_numpy(zero_copy_only=False)
        flat = pc.if_else(pa.array(~short), field, pa.scalar([np.nan] * 20, field.type)).flatten() if short.any() else field.flatten()
        m[n] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(field), 20)
        none |= short
        if flat.null_count:
            none |= flat.is_null().to_numpy(zero_copy_only=False).reshape(len(field), 20).any(axis=1)
    return m, none


def design(p: np.ndarray, l: np.ndarray, h: np.ndarray, by: str | None = None) -> np.ndarray:
    """The 20 terms of each point, or their derivatives by "p", "l" or "h"."""
    powers = [np.stack([v**k for k in range(4)]) for v in (l, p, h)]
    if by:
        own = powers["lph".index(by)]
        own[1:] = own[:-1] * np.arange(1, 4)[:, None]
        own[0] = 0
    return np.stack([powers[0][i] * powers[1][j] * powers[2][k] for i, j, k in EXPONENTS], axis=1)


def grounded(m: dict[str, np.ndarray], line: np.ndarray, samp: np.ndarray, height: np.ndarray, steps: int = NEWTON_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lat and lon of places, each with a model of its own, and where that doesn't tell places apart."""
    unit = lambda v, n: (v - m[f"{n}_off"]) / m[f"{n}_scale"]
    with np.errstate(all="ignore"):
        r, c, h = unit(line, "line"), unit(samp, "samp"), unit(height, "height")
        p, l, lost = np.zeros_like(h), np.zeros_like(h), np.zeros(len(h), bool)
        for _ in range(steps):
            by, found = [design(p, l, h), design(p, l, h, "p"), design(p, l, h, "l")], []
            for name, want in (("line", r), ("samp", c)):
                (n, np_, nl), (d, dp, dl) = ([np.einsum("ij,ij->i", m[f"{name}_{part}"], t) for t in by] for part in ("num", "den"))
                lost |= d == 0
                found.append((n / d - want, (np_ - n / d * dp) / d, (nl - n / d * dl) / d))
            (f, a, b), (g, d, e) = found
            det = a * e - b * d
            lost |= det == 0
            p, l = p - (f * e - b * g) / det, l - (a * g - f * d) / det
        return p * m["lat_scale"] + m["lat_off"], l * m["long_scale"] + m["long_off"], lost


def shift(model: Column, row0: Column, col0: Column) -> Column:
    """The model of a crop that begins at (row0, col0)."""
    return model.withField("line_off", model["line_off"] - row0).withField("samp_off", model["samp_off"] - col0)


def correct_bias(model: Column, drow: Column, dcol: Column) -> Column:
    return model.withField("line_off", model["line_off"] + drow).withField("samp_off", model["samp_off"] + dcol)


def quad_area(xs: list[Column], ys: list[Column]) -> Column:
    """Area of a polygon by its vertices."""
    n = len(xs)
    cross = [xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i] for i in range(n)]
    return F.abs(sum(cross[1:], cross[0])) / 2


def observed(points: DataFrame, images: DataFrame, seen: DataFrame) -> DataFrame:
    """Observations (point, image, model, line, samp) of points (point, lat, lon, height) by images (image,
    model) as the pairs (point, image) of ``seen`` tell; places are those that the models project to."""
    rows = seen.join(points, "point").join(images, "image")
    line, samp = project(F.col("model"), F.col("lat"), F.col("lon"), F.col("height"))
    return rows.select("point", "image", "model", line.alias("line"), samp.alias("samp"))


def forward_intersection(obs: DataFrame, steps: int = 5, start: DataFrame | None = None) -> DataFrame:
    """Ground points (point, lat, lon, height, images, rms) that fit their observations best, in pixels.

    Gauss-Newton: a step sums 3 x 3 normal equations per point and solves them in closed form. A point that fewer than
    two images see, or whose rays are parallel, has NULL coordinates. ``start``: first estimates (point, lat, lon,
    height), else the mean offsets of a point's models.
    """
    m = F.col("model")
    rows = save(obs.filter("line is not null and samp is not null and model is not null").repartition("point"), "observations")
    middle = rows.groupBy("point").agg(F.avg(m["lat_off"]).alias("lat"), F.avg(m["long_off"]).alias("lon"), F.avg(m["height_off"]).alias("height"))
    state = middle if start is None else start.select("point", "lat", "lon", "height")
    for k in range(steps + 1):
        at = rows.join(state, "point")
        unit = [m["lat_scale"], m["long_scale"], m["height_scale"]]  # unknowns are moved in these units
        p, l, h = ((F.col(c) - m[o]) / u for c, o, u in zip(("lat", "lon", "height"), ("lat_off", "long_off", "height_off"), unit))
        at = at.withColumn("s", _linearised(m, p, l, h, "plh"))
        sums = []
        for n in ("line", "samp"):
            rest = F.col(n) - (F.col("s")[n][0] * m[f"{n}_scale"] + m[f"{n}_off"])
            sums.append((rest, [F.col("s")[n][i] * m[f"{n}_scale"] for i in (1, 2, 3)]))
        total = lambda f: F.sum(sum((f(r, j) for r, j in sums[1:]), f(*sums[0])))  # noqa: E731, B023
        grouped = at.groupBy("point").agg(
            F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("height").alias("height"), *[F.first(u).alias(f"u{i}") for i, u in enumerate(unit)], F.count("*").alias("images"),
            total(lambda r, j: r * r).alias("rr"), *[total(lambda r, j, a=a, b=b: j[a] * j[b]).alias(f"a{a}{b}") for a in range(3) for b in range(a, 3)], *[total(lambda r, j, a=a: j[a] * r).alias(f"b{a}") for a in range(3)],
        )
        if k == steps:
            return grouped.select("point", *[F.when(F.col("images") > 1, F.col(c)).alias(c) for c in ("lat", "lon", "height")], "images", F.sqrt(F.col("rr") / (2 * F.col("images"))).alias("rms"))
        a = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")
        x = solve3([[a(i, j) for j in range(3)] for i in range(3)], [F.col(f"b{i}") for i in range(3)])
        state = save(grouped.select("point", *[(F.col(c) + d * F.col(f"u{i}")).alias(c) for i, (c, d) in enumerate(zip(("lat", "lon", "height"), x))]), "intersection")


def solve3(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Solution of a 3 x 3 system by Cramer's rule; NULL where singular (to 1e-12 of the diagonal's product)."""
    minor = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    det = minor(a)
    det = F.when(F.abs(det) > 1e-12 * F.abs(a[0][0] * a[1][1] * a[2][2]), det)
    return [minor([[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)]) / det for k in range(3)]


def residuals(obs: DataFrame, points: DataFrame) -> DataFrame:
    """Observations with drow, dcol: what is missing from the projection of their point (point, lat, lon, height)."""
    at = obs.join(points.select("point", "lat", "lon", "height"), "point")
    line, samp = project(F.col("model"), F.col("lat"), F.col("lon"), F.col("height"))
    return at.select(*obs.columns, (F.col("line") - line).alias("drow"), (F.col("samp") - samp).alias("dcol"))


def bias_equations(obs: DataFrame, points: DataFrame) -> DataFrame:
    """Normal equations of a constant bias per image, points fixed: n, and the right sides l_row, l_col."""
    return residuals(obs, points).dropna(subset=["drow", "dcol"]).groupBy("image").agg(F.count("*").alias("n"), F.sum("drow").alias("l_row"), F.sum("dcol").alias("l_col"), F.sum(F.col("drow") * F.col("drow") + F.col("dcol") * F.col("dcol")).alias("rr"))


def bias_from_control(obs: DataFrame, points: DataFrame) -> DataFrame:
    """drow, dcol that correct each image best on its control points, and the error that is left, in pixels."""
    n = F.col("n")
    left = F.greatest(F.col("rr") / n - (F.col("l_row") / n) ** 2 - (F.col("l_col") / n) ** 2, F.lit(0.0))
    return bias_equations(obs, points).select("image", (F.col("l_row") / n).alias("drow"), (F.col("l_col") / n).alias("dcol"), F.sqrt(left).alias("error"), "n")


def _linear(obs: DataFrame, points: DataFrame) -> DataFrame:
    """Observations with their residuals r0, r1, slopes a00..a12 by the point's coordinates and, per point, the
    inverse i00..i22 of the slopes' 3 x 3 normal equations."""
    m = F.col("model")
    at = obs.join(points.select("point", "lat", "lon", "height"), "point")
    p, l, h = ((F.col(c) - m[o]) / m[u] for c, o, u in (("lat", "lat_off", "lat_scale"), ("lon", "long_off", "long_scale"), ("height", "height_off", "height_scale")))
    at = at.withColumn("s", _linearised(m, p, l, h, "plh")).withColumn("u", F.array(m["lat_scale"], m["long_scale"], m["height_scale"]))
    first = F.first("u").over(Window.partitionBy("point").orderBy("image"))  # one unit for all images of a point
    at = at.withColumn("u0", first)
    out = []
    for i, n in enumerate(("line", "samp")):
        scale = m[f"{n}_scale"]
        out += [(F.col(n) - (F.col("s")[n][0] * scale + m[f"{n}_off"])).alias(f"r{i}"), *[(F.col("s")[n][k + 1] * scale * F.col("u0")[k] / F.col("u")[k]).alias(f"a{i}{k}") for k in range(3)]]
    lin = save(at.select("point", "image", "basis", *out), "linear")
    sums = lin.groupBy("point").agg(*[F.sum(F.col(f"a0{j}") * F.col(f"a0{k}") + F.col(f"a1{j}") * F.col(f"a1{k}")).alias(f"n{j}{k}") for j in range(3) for k in range(j, 3)])
    n = [[F.col(f"n{min(j, k)}{max(j, k)}") for k in range(3)] for j in range(3)]
    columns = [solve3(n, [F.lit(float(j == k)) for j in range(3)]) for k in range(3)]
    inverse = sums.select("point", *[columns[k][j].alias(f"i{j}{k}") for j in range(3) for k in range(3)]).dropna()
    return save(lin.join(inverse, "point"), "linear")


def _reduced(lin: DataFrame, v0: Column, v1: Column) -> DataFrame:
    """Per image that isn't basis: sums y0, y1 of the values v0, v1 less what moving the points takes away."""
    rows = lin.withColumn("v0", v0).withColumn("v1", v1)
    t = rows.groupBy("point").agg(*[F.sum(F.col(f"a0{k}") * F.col("v0") + F.col(f"a1{k}") * F.col("v1")).alias(f"t{k}") for k in range(3)])
    rows = rows.join(t, "point")
    u = [sum((F.col(f"i{j}{k}") * F.col(f"t{k}") for k in (1, 2)), F.col(f"i{j}0") * F.col("t0")) for j in range(3)]
    rest = lambda i: F.col(f"v{i}") - sum((F.col(f"a{i}{k}") * u[k] for k in (1, 2)), F.col(f"a{i}0") * u[0])
    return rows.filter(~F.col("basis")).groupBy("image").agg(F.sum(rest(0)).alias("y0"), F.sum(rest(1)).alias("y1"))


def _bias_step(lin: DataFrame, steps: int, tolerance: float) -> DataFrame:
    """Biases (image, x0, x1) that solve the equations left when the points are eliminated, by conjugate gradients
    that apply those equations to a vector and never write them out."""
    start = _reduced(lin, F.col("r0"), F.col("r1"))
    state = save(start.select("image", F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), F.col("y0").alias("g0"), F.col("y1").alias("g1"), F.col("y0").alias("p0"), F.col("y1").alias("p1")), "bias-step")
    dot = lambda df, a, b: df.agg(F.sum(F.col(f"{a}0") * F.col(f"{b}0") + F.col(f"{a}1") * F.col(f"{b}1"))).first()[0] or 0.0
    first = gg = dot(state, "g", "g")
    for _ in range(steps):
        if not gg or gg <= tolerance * tolerance * first:
            break
        at = lin.join(state.select("image", "p0", "p1"), "image", "left")
        q = save(state.join(_reduced(at, F.coalesce("p0", F.lit(0.0)), F.coalesce("p1", F.lit(0.0))), "image"), "bias-step")
        curve = dot(q, "p", "y")
        if curve <= 0:
            break  # what is left is no image's own: the points can take it up
        alpha = gg / curve
        moved = q.select("image", *[(F.col(f"x{i}") + alpha * F.col(f"p{i}")).alias(f"x{i}") for i in (0, 1)], *[(F.col(f"g{i}") - alpha * F.col(f"y{i}")).alias(f"g{i}") for i in (0, 1)], "p0", "p1")
        new = dot(moved, "g", "g")
        state = save(moved.select("image", "x0", "x1", "g0", "g1", *[(F.col(f"g{i}") + new / gg * F.col(f"p{i}")).alias(f"p{i}") for i in (0, 1)]), "bias-step")
        gg = new
    return state.select("image", "x0", "x1")


def bundle_adjust(obs: DataFrame, basis: Column, rounds: int = 3, steps: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """Constant biases (image, drow, dcol) of all images but those of ``basis`` (a condition), adjusted together with
    all points.

    A round intersects the points, linearises, eliminates each point's coordinates and solves for the biases; rounds end
    when no bias moves by more than ``tolerance`` pixels. A few scalars a step come to the driver. With two images,
    one of them basis, this is relative orientation. Images that no point ties to others keep 0.
    """
    bias, points = save(obs.select("image", basis.alias("basis")).distinct().select("image", "basis", F.lit(0.0).alias("drow"), F.lit(0.0).alias("dcol")), "bias"), None
    for _ in range(rounds):
        moved = obs.join(bias.select("image", "basis", F.col("drow").alias("_r"), F.col("dcol").alias("_c")), "image").withColumn("model", correct_bias(F.col("model"), F.col("_r"), F.col("_c"))).drop("_r", "_c")
        moved = save(moved.filter("line is not null and samp is not null"), "corrected")
        found = forward_intersection(moved) if points is None else forward_intersection(moved, 2, points)
        points = save(found.filter("lat is not null"), "points")
        step = _bias_step(_linear(moved, points), steps, tolerance / 10)
        new = save(bias.join(step, "image", "left").select("image", "basis", (F.col("drow") + F.coalesce("x0", F.lit(0.0))).alias("drow"), (F.col("dcol") + F.coalesce("x1", F.lit(0.0))).alias("dcol"), F.greatest(F.abs("x0"), F.abs("x1")).alias("move")), "bias")
        bias = new.drop("move")
        if (new.agg(F.max("move")).first()[0] or 0.0) <= tolerance:
            break
    return bias.select("image", "drow", "dcol")


def corners(images: DataFrame, height: Column | None = None) -> DataFrame:
    """The four corners (image, corner, line, samp, lat, lon) of images (image, model, rows, cols) on the ground."""
    r, c = (F.col("rows") - 1).cast("double"), (F.col("cols") - 1).cast("double")
    zero = F.lit(0.0)
    at = images.select("*", F.posexplode(F.array(F.struct(zero.alias("line"), zero.alias("samp")), F.struct(zero.alias("line"), c.alias("samp")), F.struct(r.alias("line"), c.alias("samp")), F.struct(r.alias("line"), zero.alias("samp")))).alias("corner", "at")).select("*", "at.line", "at.samp")
    ground = image_to_ground(F.col("model"), F.col("line"), F.col("samp"), F.col("model")["height_off"] if height is None else height)
    return at.withColumn("ground", ground).select("image", "corner", "line", "samp", "ground.lat", "ground.lon")


def ground_sampling(images: DataFrame) -> DataFrame:
    """gsd (metres a pixel: mean of the four sides over their pixels), height and zone of each image, at the mean
    height of its model, in the zone of its first corner."""
    c = corners(images)
    zone = F.first(zone_number(F.col("lat"), F.col("lon"))).over(Window.partitionBy("image").orderBy("corner"))
    c = c.withColumn("zone", zone)
    utm = utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    signed = F.when(F.col("lat") < 0, utm["northing"] - 10000000.0).otherwise(utm["northing"])  # an image may lie over the equator
    c = c.withColumn("e", utm["easting"]).withColumn("n", signed)
    one = lambda k, n: F.max(F.when(F.col("corner") == k, F.col(n)))
    g = c.groupBy("image").agg(F.first("zone").alias("zone"), *[one(k, n).alias(f"{n}{k}") for k in range(4) for n in ("e", "n")])
    side = lambda a, b: F.hypot(F.col(f"e{a}") - F.col(f"e{b}"), F.col(f"n{a}") - F.col(f"n{b}"))
    across, down = F.nullif(F.col("cols") - 1, F.lit(0)), F.nullif(F.col("rows") - 1, F.lit(0))
    size = images.select("image", "rows", "cols", F.col("model")["height_off"].alias("height"))
    return g.join(size, "image").select("image", ((side(0, 1) + side(2, 3)) / across / 4 + (side(1, 2) + side(3, 0)) / down / 4).alias("gsd"), "height", "zone")


def mean_height(images: DataFrame) -> DataFrame:
    return images.agg(F.avg(F.col("model")["height_off"]).alias("height"))


def overlaps(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs a < b of boxes (id, x0, y0, x1, y1) that share an area, with it and its share of the smaller box.

    Boxes meet in grid cells of the size ``cell`` (take about a box's side: a box is copied to every cell it covers), and a
    pair is emitted by the cell of the lower corner of its intersection only, so no pair comes twice.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    ok = boxes.filter("x1 > x0 and y1 > y0").select("id", "x0", "y0", "x1", "y1")
    tiled = ok.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    a, b = (tiled.select("cx", "cy", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "x0", "y0", "x1", "y1")]) for k in "ab")
    x0, y0, x1, y1 = (f(F.col(f"a_{c}"), F.col(f"b_{c}")) for f, c in ((F.greatest, "x0"), (F.greatest, "y0"), (F.least, "x1"), (F.least, "y1")))
    pairs = a.join(b, ["cx", "cy"]).filter((F.col("a_id") < F.col("b_id")) & (x1 > x0) & (y1 > y0) & (F.col("cx") == F.floor(x0 / cell)) & (F.col("cy") == F.floor(y0 / cell)))
    size = lambda k: (F.col(f"{k}_x1") - F.col(f"{k}_x0")) * (F.col(f"{k}_y1") - F.col(f"{k}_y0"))
    shared = (x1 - x0) * (y1 - y0)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), shared.alias("area"), (shared / F.least(size("a"), size("b"))).alias("share"))


def images_of(obs: DataFrame) -> DataFrame:
    """Number of different images in a point list."""
    return obs.agg(F.count_distinct("image").alias("images"))


def strip_patch(image: Column) -> tuple[Column, Column]:
    """Strip and patch number of an image id "strip_patch"; NULL where it has no such form."""
    part = lambda k: F.nullif(F.regexp_extract(image, r"^\s*([0-9]+)_([0-9]+)\s*$", k), F.lit("")).try_cast("int")
    return part(1), part(2)


def best_patches(obs: DataFrame, strip: int) -> DataFrame:
    """For each patch of ``strip`` and each other strip, the patch there with which it shares most points; ties to the lower number."""
    s, p = strip_patch(F.col("image"))
    rows = obs.select("point", s.alias("strip"), p.alias("patch")).dropna().distinct()
    own = rows.filter(F.col("strip") == strip).select("point", F.col("patch").alias("own"))
    shared = own.join(rows.filter(F.col("strip") != strip), "point").groupBy("own", "strip", "patch").agg(F.count("*").alias("points"))
    best = F.max_by(F.struct("patch", "points"), F.struct(F.col("points"), -F.col("patch")))
    return shared.groupBy("own", "strip").agg(best.alias("b")).select("own", "strip", F.col("b.patch").alias("patch"), F.col("b.points").alias("points"))


def translations(images: DataFrame) -> DataFrame:
    """Order of the patches in each strip and the shift (tx, ty), in pixels, of each against the patch before it.

    Images have columns strip, patch, model, rows, cols. Order is that of the centres' latitude, from north to south, then of
    the patch; the shift is where the centre of a patch lies in the image before it, less that image's centre.
    """
    centre = image_to_ground(F.col("model"), (F.col("rows") - 1) / 2.0, (F.col("cols") - 1) / 2.0, F.col("model")["height_off"])
    at = images.withColumn("g", centre)
    w = Window.partitionBy("strip").orderBy(F.desc("g.lat"), "patch")
    at = at.select("*", F.row_number().over(w).alias("rank"), *[F.lag(c).over(w).alias(f"_{c}") for c in ("model", "rows", "cols")])
    line, samp = project(F.col("_model"), F.col("g.lat"), F.col("g.lon"), F.col("model")["height_off"])
    return at.select("strip", "patch", "rank", (samp - (F.col("_cols") - 1) / 2.0).alias("tx"), (line - (F.col("_rows") - 1) / 2.0).alias("ty"))


def to_original(t: list[float], model: Column, height: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(line, samp) in the image of a place in a rectified raster with the transform t to longitude and latitude."""
    lon, lat = t[0] + t[1] * x + t[2] * y, t[3] + t[4] * x + t[5] * y
    return project(model, lat, lon, height)


def to_rectified(t: list[float], model: Column, height: Column, line: Column, samp: Column) -> Column:
    """struct(x, y): the reverse of :func:`to_original`."""
    det = t[1] * t[5] - t[2] * t[4]
    at = lambda g: F.struct(((t[5] * (g["lon"] - t[0]) - t[2] * (g["lat"] - t[3])) / det).alias("x"), ((t[1] * (g["lat"] - t[3]) - t[4] * (g["lon"] - t[0])) / det).alias("y"))
    return _let(image_to_ground(model, line, samp, height), at)


def rectify(grid: DataFrame, t: list[float], model: Column, height: Column, px: DataFrame) -> DataFrame:
    """The image ``px`` seen on the cells (y, x) of a rectified raster with the transform ``t``, on a plane of one height."""
    line, samp = to_original(t, F.col("m"), F.col("h"), F.col("x").cast("double"), F.col("y").cast("double"))
    at = grid.select("y", "x", model.alias("m"), height.alias("h")).select("y", "x", line.alias("py"), samp.alias("px"))
    return bilinear(at.withColumnsRenamed({"y": "gy", "x": "gx"}), px).select(F.col("gy").alias("y"), F.col("gx").alias("x"), "v")


def epipolar_candidates(left: DataFrame, right: DataFrame, left_model: Column, right_model: Column, low: float, high: float, step: float, search: float) -> DataFrame:
    """Pairs (id, candidate, distance) of features (id, line, samp) of two images: the right one lies within
    ``search`` pixels of the curve that the left one's ray makes between two heights, sampled each ``step``.

    Samples and features meet in square cells of the side ``search``; a feature goes to the nine cells around its own. Features of one
    place (and model) have the same curve and distances: these are worked out once for places, and only the pairs that come out
    are those of features, which no shuffle groups again, unless an id has several places.
    """
    heights = [low + k * step for k in range(int((high - low) / step) + 1)]
    place, other = ["line", "samp", "mk"], ["rl", "rs"]
    own = left.dropna(subset=["line", "samp"]).select("id", "line", "samp", left_model.alias("m1"), right_model.alias("m2")).withColumn("mk", F.xxhash64("m1", "m2"))
    theirs = right.dropna(subset=["line", "samp"]).select(F.col("id").alias("candidate"), F.col("line").alias("rl"), F.col("samp").alias("rs")).distinct()
    rays = own.groupBy(*place).agg(F.first("m1").alias("m1"), F.first("m2").alias("m2")).select("*", F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("h"))
    rays = rays.withColumn("g", image_to_ground(F.col("m1"), F.col("line"), F.col("samp"), F.col("h")))
    line, samp = project(F.col("m2"), F.col("g.lat"), F.col("g.lon"), F.col("h"))
    cell = lambda c: F.floor(F.col(c) / float(search))
    curve = save(rays.select(*place, line.alias("y"), samp.alias("x")), "rays")  # stored, so that no filter traces a ray again
    curve = curve.dropna().withColumn("cy", cell("y")).withColumn("cx", cell("x"))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    near = theirs.select(*other).distinct().withColumn("cy", around("rl")).withColumn("cx", around("rs"))
    distance = F.hypot(F.col("y") - F.col("rl"), F.col("x") - F.col("rs"))
    met = curve.join(near, ["cy", "cx"]).withColumn("distance", distance).filter(F.col("distance") <= search).groupBy(*place, *other).agg(F.min("distance").alias("distance"))
    own = own.select("id", *place).distinct()
    pairs = save(met, "epipolar-places").join(own, place).join(theirs, other).select("id", "candidate", "distance")
    if all(df.groupBy(key).count().filter("count > 1").isEmpty() for df, key in ((own, "id"), (theirs, "candidate"))):
        return pairs
    return pairs.groupBy("id", "candidate").agg(F.min("distance").alias("distance"))


def near_samples(x: Column, y: Column, xs: Column, ys: Column, reach: Column) -> Column:
    """Whether a point lies within ``reach`` of any of the sampled places of a line (arrays of equal length)."""
    return F.exists(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda e: F.hypot(e["x"] - x, e["y"] - y) <= reach)
