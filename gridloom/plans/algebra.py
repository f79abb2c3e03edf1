"""Queries over functions, generators, slices, small systems, geometry and text rules, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy, geometry, special, xmltext
from ..operators import corners, linalg, raster, sensor, spectral
from ..sources import files
from . import views as V
from .registry import query, rounded
from .twins import NMS, OFFSETS, RING, fast, r, twin

_X = "l_quantity / 7.0::DOUBLE - 3.05::DOUBLE"


def _lines(s, d, *columns):
    return V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *columns)


# special functions


@query
def log_gamma(s, d):
    x = F.col("l_quantity") * 1.5 + F.col("l_tax")
    return rounded(_lines(s, d, special.lgamma(x).alias("v")), 8)


twin("log_gamma", "", f"SELECT l_orderkey, l_linenumber, {r('lgamma(l_quantity * 1.5::DOUBLE + l_tax)', 'v', 8)} FROM lineitem")


@query
def digamma(s, d):
    return rounded(_lines(s, d, special.digamma(F.col("l_quantity") * 0.5 + 1.25).alias("v")), 8)


#: by its series of differences: digamma(x) = digamma(x + 40) less the reciprocals, and the expansion of the logarithm
twin(
    "digamma", "", f"SELECT l_orderkey, l_linenumber, {r('ln(x + 40) - 1 / (2 * (x + 40)) - 1 / (12 * (x + 40) * (x + 40)) + 1 / (120 * (x + 40) ** 4) - 1 / (252 * (x + 40) ** 6) - list_sum(list_transform(range(40), lambda k: 1 / (x + k)))', 'v', 8)} "
    "FROM (SELECT l_orderkey, l_linenumber, l_quantity * 0.5::DOUBLE + 1.25::DOUBLE AS x FROM lineitem)",
)


@query
def error_function(s, d):
    x = F.col("l_quantity") / 7 - 3.05
    return rounded(_lines(s, d, special.erf(x).alias("erf"), special.erfc(x).alias("erfc")), 8)


#: Simpson's rule over 200 parts; few different arguments
_ERF = f"integral AS (SELECT q, 2 / sqrt(pi()) * x / 600 * sum(CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(0 - (x * k / 200) * (x * k / 200))) AS v FROM (SELECT DISTINCT l_quantity AS q, {_X} AS x FROM lineitem), (SELECT unnest(range(201)) AS k) GROUP BY q, x)"
twin("error_function", "", f"SELECT l_orderkey, l_linenumber, {r('v', 'erf', 8)}, {r('1 - v', 'erfc', 8)} FROM lineitem JOIN integral ON q = l_quantity", _ERF)


# element-wise functions that elementwise_maths leaves out


@query
def elementwise_more(s, d):
    v, u = F.col("l_quantity"), F.col("l_discount") * 9
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(v)
    return rounded(_lines(
        s, d, F.when(v < 25, math.pi).otherwise(0.0).alias("argument"), F.tan(v).alias("tangent"), F.acos(u).alias("arc_cosine"), F.asin(u).alias("arc_sine"), F.sinh(v / 20).alias("sinh"), F.cosh(v / 20).alias("cosh"), (1 / v).alias("inverse"),
        F.round(v / 7).alias("nearest"), F.isnan(odd).alias("is_nan"), (F.abs(odd) == float("inf")).alias("is_inf"), (~F.isnan(odd) & (F.abs(odd) != float("inf"))).alias("is_finite"), (-v).alias("minus"), v.cast("int").alias("whole"), (~(v > 25)).alias("at_most"),
    ))


_ODD = "CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE l_quantity END"
twin(
    "elementwise_more", "", "SELECT l_orderkey, l_linenumber, " + ", ".join([
        r("CASE WHEN l_quantity < 25 THEN pi() ELSE 0 END", "argument"), r("tan(l_quantity)", "tangent"), r("acos(l_discount * 9)", "arc_cosine"), r("asin(l_discount * 9)", "arc_sine"), r("(exp(l_quantity / 20) - exp(0 - l_quantity / 20)) / 2", "sinh"), r("(exp(l_quantity / 20) + exp(0 - l_quantity / 20)) / 2", "cosh"), r("1 / l_quantity", "inverse"),
        "round(l_quantity / 7) AS nearest", f"isnan({_ODD}) AS is_nan", f"isinf({_ODD}) AS is_inf", f"isfinite({_ODD}) AS is_finite", "0 - l_quantity AS minus", "l_quantity::INT AS whole", "l_quantity <= 25 AS at_most",
    ]) + " FROM lineitem",
)


@query
def elementwise_binary(s, d):
    a, b = F.col("l_quantity"), F.col("l_tax") * 100
    return rounded(_lines(
        s, d, (a + b).alias("plus"), (a - b).alias("minus"), (a * b).alias("times"), F.try_divide(a, b).alias("over"), F.least(a, b).alias("smaller"), F.greatest(a, b).alias("greater"), F.pow(b, F.lit(2.5)).alias("power"),
        (a < b).alias("lt"), (a <= b).alias("le"), (a > b).alias("gt"), (a >= b).alias("ge"), (a == b).alias("eq"), (a != b).alias("ne"), ((a > 25) & (b > 4)).alias("both"), ((a > 25) | (b > 4)).alias("either"), ((a > 25) != (b > 4)).alias("one"),
    ))


twin(
    "elementwise_binary", "", "SELECT l_orderkey, l_linenumber, " + ", ".join([
        r("a + b", "plus"), r("a - b", "minus"), r("a * b", "times"), r("a / nullif(b, 0)", "over"), r("CASE WHEN a < b THEN a ELSE b END", "smaller"), r("CASE WHEN a > b THEN a ELSE b END", "greater"), r("b * b * sqrt(b)", "power"),
        "a < b AS lt", "a <= b AS le", "a > b AS gt", "a >= b AS ge", "a = b AS eq", "a <> b AS ne", "a > 25 AND b > 4 AS both", "a > 25 OR b > 4 AS either", "xor((a > 25)::INT, (b > 4)::INT) = 1 AS one",
    ]) + " FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax * 100 AS b FROM lineitem)",
)


@query
def complex_parts(s, d):
    z = F.struct(F.col("l_quantity").alias("re"), (F.col("l_tax") * 100).alias("im"))
    return rounded(_lines(s, d, z["re"].alias("re"), (-z["im"]).alias("conj_im"), (z["re"] * z["re"] + z["im"] * z["im"]).alias("squared"), F.atan2(z["im"], z["re"]).alias("argument")))


twin("complex_parts", "", f"SELECT l_orderkey, l_linenumber, {r('l_quantity', 're')}, {r('l_tax * -100', 'conj_im')}, {r('l_quantity * l_quantity + l_tax * l_tax * 10000', 'squared')}, {r('atan2(l_tax * 100, l_quantity)', 'argument')} FROM lineitem")


# generators, slices, permutations


@query
def generators(s, d):
    """A constant matrix of all suppliers by five, with the identity of the suppliers and evenly spaced values."""
    n = V.table(s, d, "supplier").count()
    name = lambda df, kind: df.select(F.lit(kind).alias("kind"), "i", "j", "v")
    return rounded(name(linalg.constant(s, n, 5, 2.5), "constant").union(name(linalg.identity(s, n), "identity")).union(name(linalg.linspaced(s, n, -1.0, 3.0).withColumn("j", F.lit(0)), "linspaced")))


twin(
    "generators", "", f"SELECT 'constant' AS kind, i, j, 2.5::DOUBLE AS v FROM k, range(5) u(j) UNION ALL SELECT 'identity', i, i, 1.0::DOUBLE FROM k UNION ALL SELECT 'linspaced', i, 0, round(-1 + 4 * i / (n - 1.0::DOUBLE), 6) + 0.0 FROM k, (SELECT count(*) AS n FROM supplier)",
    "k AS (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i)",
)


@query
def matrix_slices(s, d):
    """Blocks, the reverse, copies and the diagonal of the raster as a matrix of 64 columns."""
    m = V.dsm(s, d).select(F.col("y").alias("i"), F.col("x").cast("long").alias("j"), "v")
    n = V.size(V.dsm(s, d))[0]
    parts = {"block": linalg.block(m, 10, 5, 20, 30), "reverse": linalg.reverse(m, n, 64), "replicate": linalg.replicate(linalg.block(m, 0, 0, 3, 4), 3, 4, 2, 3), "diagonal": linalg.diagonal(m).select("i", F.col("i").alias("j"), "v")}
    named = [p.select(F.lit(k).alias("kind"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v") for k, p in parts.items()]
    return named[0].union(named[1]).union(named[2]).union(named[3])


twin(
    "matrix_slices", "dsm dims", "SELECT 'block' AS kind, y - 10 AS i, x - 5 AS j, v FROM dsm WHERE y BETWEEN 10 AND 29 AND x BETWEEN 5 AND 34 UNION ALL SELECT 'reverse', h - 1 - y, 63 - x, v FROM dsm, dims "
    "UNION ALL SELECT 'replicate', y + 3 * a, x + 4 * b, v FROM dsm, range(2) p(a), range(3) q(b) WHERE y < 3 AND x < 4 UNION ALL SELECT 'diagonal', y, x, v FROM dsm WHERE y = x",
)


@query
def permuted_rows(s, d):
    suppliers = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("source"))
    n = suppliers.count()
    p = suppliers.withColumn("target", (F.col("source") * 7) % (n + 1))
    return rounded(linalg.permute_rows(linalg.from_triplets(V.coo(s, d)), p), 4)


twin("permuted_rows", "coo", f"SELECT (i * 7) % (SELECT count(*) + 1 FROM supplier) AS i, j, {r('sum(v)', 'v', 4)} FROM coo WHERE i IN (SELECT s_suppkey FROM supplier) GROUP BY coo.i, j")


@query
def random_numbers(s, d):
    """Repeatable numbers by key; no twin, as engines differ in their hashes: tests hold the distribution against chance."""
    k = F.struct("l_orderkey", "l_linenumber")
    return _lines(s, d, linalg.uniform(k, 1).alias("u"), linalg.random_index(k, 10, 2).alias("k"))


# systems


@query
def triangular_solve(s, d):
    """A lower triangle of the suppliers, each tied to the two before it."""
    k = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("b"))
    m = k.select("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("o")).filter("i % 8 >= o").select("i", (F.col("i") - F.col("o")).alias("j"), F.when(F.col("o") == 0, 4.0).otherwise(F.lit(1.0) / (F.col("o") + 1)).alias("v"))
    return rounded(linalg.triangular_solve(m, k.select("i", F.col("b").alias("v"))), 4)


#: chains have at most eight links, so the substitution is written out by a recursion over the place in the chain
twin(
    "triangular_solve", "", f"SELECT i, {r('x', 'v', 4)} FROM (SELECT i, x0 AS x FROM step)",
    "RECURSIVE step(i, x0, x1) AS (SELECT s_suppkey, s_acctbal / 4, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 8 = 0 "
    "UNION ALL SELECT s_suppkey, (s_acctbal - step.x0 / 2 - CASE WHEN s_suppkey % 8 >= 2 THEN step.x1 / 3 ELSE 0 END) / 4, step.x0 FROM step JOIN supplier ON s_suppkey = step.i + 1 WHERE s_suppkey % 8 >= 1)",
)


@query
def small_inverse(s, d):
    """Inverses of 3 x 3 matrices, one an order of three lines or more."""
    li = V.table(s, d, "lineitem").filter("l_linenumber <= 3")
    whole = li.join(li.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n = 3").select("l_orderkey"), "l_orderkey")
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), c.cast("double").alias("v")) for j, c in enumerate((F.col("l_quantity"), F.sqrt(F.col("l_linenumber") * 3.0), F.pmod(F.col("l_partkey"), F.lit(11)) + F.col("l_linenumber") ** 2), 1)]))
    m = whole.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("i"), cells.alias("c")).select("k", "i", F.col("c.j").cast("long").alias("j"), "c.v")
    return rounded(linalg.inverse(m, "k").filter("v is not null"), 4)


_INV = {(1, 1): "e * i - f * h", (1, 2): "c * h - b * i", (1, 3): "b * f - c * e", (2, 1): "f * g - d * i", (2, 2): "a * i - c * g", (2, 3): "c * d - a * f", (3, 1): "d * h - e * g", (3, 2): "b * g - a * h", (3, 3): "a * e - b * d"}
twin(
    "small_inverse", "", " UNION ALL ".join(f"SELECT k, {p}::BIGINT AS i, {q}::BIGINT AS j, {r(f'({x}) / det', 'v', 4)} FROM m WHERE abs(det) > 1e-9" for (p, q), x in _INV.items()),
    "rows AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS p, sqrt(l_linenumber * 3.0::DOUBLE) AS q, (l_partkey % 11 + l_linenumber * l_linenumber)::DOUBLE AS r FROM lineitem WHERE l_linenumber <= 3), "
    "flat AS (SELECT k, max(p) FILTER (n = 1) AS a, max(q) FILTER (n = 1) AS b, max(r) FILTER (n = 1) AS c, max(p) FILTER (n = 2) AS d, max(q) FILTER (n = 2) AS e, max(r) FILTER (n = 2) AS f, max(p) FILTER (n = 3) AS g, max(q) FILTER (n = 3) AS h, max(r) FILTER (n = 3) AS i FROM rows GROUP BY k HAVING count(*) = 3), "
    "m AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM flat)",
)


def _supplier_system(s, d):
    """Suppliers over five parts' groups: diagonally dominant, not symmetric."""
    part = V.coo(s, d).select(F.col("i"), (F.col("j") % 97).alias("k"), "v").groupBy("i", "k").agg(F.sum("v").alias("v"))
    off = part.select("i", ((F.col("i") * 3 + F.col("k")) % 10 + 1).alias("j"), (F.col("v") / 1000).alias("v")).filter("i <> j")
    diagonal = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("j"), F.lit(60.0).alias("v"))
    return linalg.from_triplets(off.union(diagonal))


@query
def bicgstab(s, d):
    """No twin: tests hold the solution against a dense one."""
    m = _supplier_system(s, d)
    return rounded(linalg.bicgstab(m, V.table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.lit(1.0).alias("v"))).select("i", "v"), 8)


@query
def least_squares_cg(s, d):
    """Two coefficients over all lines (lines of one number add up); the twin has the closed form."""
    li = V.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), "l_quantity", "l_tax", "l_extendedprice")
    m = li.select("i", F.explode(F.array(F.struct(F.lit(1).alias("j"), (F.col("l_quantity") / 50).alias("v")), F.struct(F.lit(2).alias("j"), (F.col("l_tax") * 10).alias("v")))).alias("c")).select("i", "c.j", "c.v")
    return rounded(linalg.least_squares_cg(m, li.select("i", (F.col("l_extendedprice") / 1000).alias("v"))).select("j", "v"), 5)


twin(
    "least_squares_cg", "", f"SELECT 1 AS j, {r('(pp * b1 - q * b2) / (qq * pp - q * q)', 'v', 5)} FROM s UNION ALL SELECT 2, {r('(qq * b2 - q * b1) / (qq * pp - q * q)', 'v', 5)} FROM s",
    "s AS (SELECT sum(x * x) AS qq, sum(x * t) AS q, sum(t * t) AS pp, sum(x * y) AS b1, sum(t * y) AS b2 FROM (SELECT sum(l_quantity) / 50 AS x, sum(l_tax) * 10 AS t, sum(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY l_orderkey, l_linenumber))",
)


@query
def ridge_given(s, d):
    fit = linalg.ridge(V.regression(s, d), ["x0", "x1"], "y", [0.0, 0.0], "g", alpha=25.0)
    return rounded(fit.select("g", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("slope")), 3)


twin(
    "ridge_given", "ls", f"SELECT g, {r('(b0 * (qq + 25) - b1 * q) / ((n + 25) * (qq + 25) - q * q)', 'intercept', 3)}, {r('(b1 * (n + 25) - b0 * q) / ((n + 25) * (qq + 25) - q * q)', 'slope', 3)} FROM s",
    "s AS (SELECT g, count(*)::DOUBLE AS n, sum(x1) AS q, sum(x1 * x1) AS qq, sum(y) AS b0, sum(x1 * y) AS b1 FROM ls GROUP BY g)",
)


@query
def last_of_cell(s, d):
    t = V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("o"))
    return linalg.keep_last(t, "o")


twin("last_of_cell", "", "SELECT l_suppkey AS i, l_partkey AS j, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS v FROM lineitem GROUP BY ALL")


@query
def absolute_orientation(s, d):
    """Points turned by 0.4 about the third axis, scaled by 2 and moved, per market segment."""
    c = V.table(s, d, "customer").select("c_mktsegment", (F.col("c_custkey") % 101).cast("double").alias("x"), (F.col("c_custkey") * 7 % 89).cast("double").alias("y"), (F.col("c_custkey") * 11 % 53).cast("double").alias("z"))
    u, v = geometry.rotate2(F.lit(0.4), F.col("x"), F.col("y"))
    moved = c.withColumn("u", 2 * u + 10).withColumn("v", 2 * v - 5).withColumn("w", 2 * F.col("z") + 3)
    return rounded(linalg.absolute_orientation(moved, "c_mktsegment"))


twin("absolute_orientation", "", f"SELECT c_mktsegment, {r('cos(0.2::DOUBLE)', 'q0')}, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, {r('sin(0.2::DOUBLE)', 'q3')}, 2.0::DOUBLE AS scale, 10.0::DOUBLE AS t0, -5.0::DOUBLE AS t1, 3.0::DOUBLE AS t2 FROM customer GROUP BY c_mktsegment")


# geometry


def _vector(*columns):
    return [F.col(c) for c in columns]


@query
def plane_and_line(s, d):
    """The plane through three points near each customer's, a line that meets it, and distances."""
    p = V.points(s, d)
    a, b, c = ([F.col("lon") + i, F.col("lat") + j, F.lit(float(k))] for i, j, k in ((0, 0, 1), (2, 1, 2), (1, 3, 5)))
    plane = geometry.plane_through(a, b, c)
    at = geometry.line_plane([F.col("lon"), F.col("lat"), F.lit(10.0)], [F.lit(0.0), F.lit(0.0), F.lit(-1.0)], plane)
    out = p.select("id", geometry.plane_distance(plane, [F.col("lon"), F.col("lat"), F.lit(10.0)]).alias("distance"), at[2].alias("height"), geometry.line_distance(a, [F.lit(1.0), F.lit(2.0), F.lit(2.0)], b).alias("off_line"))
    return rounded(out)


twin("plane_and_line", "pts", f"SELECT id, {r('9 * 5 / sqrt(75.0::DOUBLE)', 'distance')}, 1.0::DOUBLE AS height, {r('sqrt(6 - 36 / 9.0::DOUBLE)', 'off_line')} FROM pts")


@query
def rotations(s, d):
    """A vector turned by axis and angle, and half-way between that turn and none."""
    p, angle = V.points(s, d), F.radians("lat")
    q = geometry.from_axis_angle([F.lit(0.0), F.lit(0.0), F.lit(2.0)], angle)
    half = geometry.slerp([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], q, F.lit(0.5))
    v = [F.col("lon"), F.lit(1.0), F.lit(4.0)]
    turned, by_half = geometry.rotate(q, v), geometry.rotate(geometry.multiply(half, half), v)
    euler = geometry.rotate(geometry.from_euler(F.lit(0.0), F.lit(0.0), angle), v)
    return rounded(p.select("id", *[x.alias(n) for n, x in zip("xyz", turned)], by_half[0].alias("half_x"), euler[1].alias("euler_y"), geometry.norm(geometry.from_homogeneous([*geometry.homogeneous(v)[:3], F.lit(2.0)])).alias("size")))


twin("rotations", "pts", f"SELECT id, {r('x', 'x')}, {r('y', 'y')}, 4.0::DOUBLE AS z, {r('x', 'half_x')}, {r('y', 'euler_y')}, {r('sqrt(lon * lon + 17) / 2', 'size')} FROM (SELECT id, lon, cos(radians(lat)) * lon - sin(radians(lat)) AS x, sin(radians(lat)) * lon + cos(radians(lat)) AS y FROM pts)")


# corners, sensors, rasters and text


def _nms(n: int) -> None:
    def found(s, d):
        return corners.detect_nms(V.gray(s, d), n, 20)

    found.__name__ = f"fast{n}_detect_nms"
    query(found)
    twin(found.__name__, "dsm gray", NMS.format(t="corner"), f"{OFFSETS}, {fast(n)}")


for _n in (10, 11, 12):
    _nms(_n)


@query
def rpc_moved(s, d):
    """Models of crops, corrected for a bias."""
    m = sensor.correct_bias(sensor.shift(F.col("model"), F.lit(100.0), F.lit(50.0)), F.col("image") * 0.5, F.lit(-1.5))
    return V.images(s, d).select("image", m["line_off"].alias("line_off"), m["samp_off"].alias("samp_off"))


twin("rpc_moved", "", "SELECT n_nationkey AS image, 4900.0::DOUBLE + n_nationkey * 1.5::DOUBLE AS line_off, 3948.5::DOUBLE - n_nationkey AS samp_off FROM nation")


@query
def zone_prefixes(s, d):
    text = F.concat(F.lit(" "), F.when(F.col("id") % 5 == 0, "x").otherwise(""), (F.col("id") % 70).cast("string"), F.when(F.col("id") % 11 == 0, "99999999999").otherwise(""), F.lit("N"))
    return V.points(s, d).select("id", geodesy.zone_prefix(text).alias("zone"), geodesy.is_north(text).alias("north"))


twin("zone_prefixes", "pts", "SELECT id, CASE WHEN id % 5 = 0 OR id % 11 = 0 AND id % 70 > 0 THEN NULL WHEN id % 11 = 0 THEN NULL ELSE (id % 70)::INT END AS zone, id % 5 <> 0 AS north FROM pts")


@query
def raster_info(s, d):
    px = V.u16(s, d).select(F.lit("u16").alias("image"), "y", "x", "v").union(V.gray(s, d).select(F.lit("gray"), "y", "x", "v")).union(V.dsm(s, d).select(F.lit("dsm"), "y", "x", "v"))
    return files.raster_info(px, "image")


twin("raster_info", "dsm u16 gray", " UNION ALL ".join(f"SELECT '{t}' AS image, max(y) + 1 AS rows, (max(x) + 1)::BIGINT AS cols, count(*) AS pixels, count(v) AS values, {b} AS bits FROM {t}" for t, b in (("u16", 16), ("gray", 8), ("dsm", 64))))


@query
def bits_16_to_8(s, d):
    return raster.minmax_stretch(V.u16(s, d)).select("y", "x", F.floor(F.round("v", 6)).cast("int").alias("v"))


twin("bits_16_to_8", "dsm u16", "SELECT y, x::INT AS x, floor(round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 255, 6))::INT AS v FROM u16")


@query
def copied_geo(s, d):
    images = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("image"), (F.col("s_suppkey") % 30).alias("from"))
    source = V.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("image"), F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("transform"), F.col("n_name").alias("projection"))
    return files.copy_geo(images, source).select("image", "from", F.col("transform")[0].alias("t0"), "projection")


twin("copied_geo", "", "SELECT s_suppkey AS image, s_suppkey % 30 AS \"from\", n_nationkey::DOUBLE AS t0, n_name AS projection FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 30")


@query
def image_lookup(s, d):
    """Observations with their image's number of rows, by id."""
    return V.sightings(s, d).join(V.images(s, d).select("image", "rows"), "image").select("point", "image", "rows")


twin("image_lookup", "seen", "SELECT point, image, 10000 AS rows FROM seen JOIN nation ON n_nationkey = image")


@query
def unicode_characters(s, d):
    code = F.col("o_orderkey") % 60_000
    return V.table(s, d, "orders").select("o_orderkey", xmltext.character(code).alias("c"), xmltext.skip_mark(F.concat(F.lit("\ufeff"), F.col("o_orderpriority"))).alias("plain"))


twin("unicode_characters", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 60000 = 0 OR o_orderkey % 60000 BETWEEN 55296 AND 57343 THEN NULL ELSE chr((o_orderkey % 60000)::INT) END AS c, o_orderpriority AS plain FROM orders")


@query
def unsigned_attributes(s, d):
    text = F.concat((F.col("o_orderkey") * 2_000_003 - 3_000_000_000).cast("string"), F.lit("px"))
    return V.table(s, d, "orders").select("o_orderkey", xmltext.unsigned_attribute(text).alias("v"), xmltext.int_attribute(text).alias("w"))


twin("unsigned_attributes", "", "SELECT o_orderkey, CASE WHEN v BETWEEN 0 AND 4294967295 THEN v WHEN v BETWEEN -2147483648 AND -1 THEN v + 4294967296 END AS v, CASE WHEN v BETWEEN -2147483648 AND 2147483647 THEN v::INT END AS w FROM (SELECT o_orderkey, o_orderkey * 2000003 - 3000000000 AS v FROM orders)")


@query
def largest_singular_triple(s, d):
    """Largest singular value of suppliers over parts with its left vector; the twin iterates with the Gramian of the rows."""
    values, left, _ = spectral.singular_triples(V.coo(s, d), 1, extra=9, rounds=6)
    return rounded(left.select("i", "v", F.lit(values[0]).alias("value")), 4)


twin(
    "largest_singular_triple", "coo", f"SELECT i, {r('v', 'v', 4)}, {r('(SELECT sqrt(sum(p.v * g.v * q.v)) FROM g JOIN u p ON p.i = g.i JOIN u q ON q.i = g.k)', 'value', 4)} FROM u",
    "m AS (SELECT i, j, sum(v) AS v FROM coo GROUP BY i, j), g AS MATERIALIZED (SELECT a.i, b.i AS k, sum(a.v * b.v) AS v FROM m a JOIN m b USING (j) GROUP BY a.i, b.i), "
    "x AS (SELECT 0 AS t, i, 1.0::DOUBLE AS v FROM (SELECT DISTINCT i FROM m) UNION ALL SELECT t + 1, g.i, sum(g.v * x.v) / sqrt(sum(pow(sum(g.v * x.v), 2)) OVER ()) FROM x JOIN g ON g.k = x.i WHERE t < 60 GROUP BY t, g.i), "
    "u AS MATERIALIZED (SELECT i, v FROM x WHERE t = 60)", recursive=True,
)


@query
def product_row_sums(s, d):
    """Row sums of the whole product A'A of parts over suppliers; the twin takes A' times the row sums of A."""
    a = linalg.from_triplets(V.coo(s, d))
    return rounded(linalg.multiply(linalg.transpose(a), a).groupBy("i").agg(F.sum("v").alias("total"), F.count("*").alias("cells")), 4)


twin(
    "product_row_sums", "coo", f"SELECT t.i, {r('total', 'total', 4)}, cells FROM t JOIN n USING (i)",
    "m AS (SELECT i, j, sum(v) AS v FROM coo GROUP BY i, j), t AS (SELECT m.j AS i, sum(m.v * w.s) AS total FROM m JOIN (SELECT i, sum(v) AS s FROM m GROUP BY i) w USING (i) GROUP BY m.j), "
    "n AS (SELECT a.j AS i, count(DISTINCT b.j) AS cells FROM m a JOIN m b USING (i) GROUP BY a.j)",
)

#: the smallest number spreads along the links, a link a step; 40 steps are more than the longest way in these tables
twin(
    "connected_tracks_all", "", "SELECT node, m AS track FROM lab WHERE t = 40",
    "e AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 7 * 211 AS b FROM orders), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), "
    "lab AS (SELECT DISTINCT 0 AS t, a AS node, a AS m FROM w UNION ALL SELECT t + 1, w.a, min(lab.m) FROM lab JOIN w ON w.b = lab.node WHERE t < 40 GROUP BY t, w.a)", recursive=True,
)
