"""SQL twins of the catalog's queries, for an engine with the tables registered as views."""

from __future__ import annotations

import math

from ..functions.geodesy import BANDS, ELLIPSOIDS, K0, WGS84
from ..operators.corners import RING16
from ..operators.raster import invert_transform
from .views import SQL

TWINS: dict[str, str] = {}


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def twin(name: str, views: str, body: str, more: str = "", recursive: bool = False) -> None:
    with_ = ", ".join([*[SQL[v] for v in views.split()], *([more] if more else [])])
    TWINS[name] = f"WITH {'RECURSIVE ' * recursive}{with_} {body}" if with_ else body


OFFSETS = "off AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))"

twin("pixels_from_arrays", "dsm", "SELECT y, x::INT AS x, v FROM dsm")
twin("raster_stats", "dsm", f"SELECT count(v) AS n, {r('min(v)', 'v_min')}, {r('max(v)', 'v_max')}, {r('avg(v)', 'v_mean')}, {r('var_pop(v)', 'v_var')}, {r('stddev_pop(v)', 'v_std')} FROM dsm")
twin("intensity_match", "dsm dsm2", f"SELECT y, x::INT AS x, {r('sqrt(q1 / q2) * v + m1 - sqrt(q1 / q2) * m2', 'v')} FROM dsm2, (SELECT avg(v) m1, var_pop(v) q1 FROM dsm), (SELECT avg(v) m2, var_pop(v) q2 FROM dsm2)")
twin("minmax_stretch", "dsm", f"SELECT y, x::INT AS x, {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 255', 'v')} FROM dsm")
twin("gray_luma", "dsm gray", f"SELECT y, x::INT AS x, {r('0.299::DOUBLE * v + 0.587::DOUBLE * (255 - v) + 0.114::DOUBLE * v / 2', 'v')} FROM gray")
twin("bands_interleave", "dsm gray", f"SELECT y, x::INT AS x, {r('v', 'r')}, {r('255 - v', 'g')}, {r('v / 2', 'b')} FROM gray")
twin("pyramid_avg", "dsm", " UNION ALL ".join(f"SELECT {k} AS level, y // {2**k} AS y, (x // {2**k})::BIGINT AS x, {r('avg(v)', 'v')} FROM dsm GROUP BY ALL" for k in range(3)))
twin("aoi_crop", "dsm", "SELECT y - 100 AS y, (x - 10)::INT AS x, v FROM dsm WHERE y >= 100 AND y < 150 AND x >= 10 AND x < 30")
twin("nodata_restore", "dsm u16", "SELECT y, x::INT AS x, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE v + 1 END AS v FROM u16")
twin("pixel_to_geo", "dsm", f"SELECT y, x::INT AS x, {r('500000.0::DOUBLE + 0.5::DOUBLE * x + 0.01::DOUBLE * y', 'geo_x')}, {r('4100000.0::DOUBLE + 0.02::DOUBLE * x - 0.5::DOUBLE * y', 'geo_y')} FROM dsm")
_inv = [f"({v!r})::DOUBLE" for v in invert_transform([500000.0, 0.5, 0.01, 4100000.0, 0.02, -0.5])]
twin("geo_to_pixel", "pts", f"SELECT id, {r(f'{_inv[0]} + {_inv[1]} * lon + {_inv[2]} * lat', 'col')}, {r(f'{_inv[3]} + {_inv[4]} * lon + {_inv[5]} * lat', 'row')} FROM pts")
twin("point_values", "dsm", "SELECT id, p.y, p.x::INT AS x, (SELECT v FROM dsm WHERE dsm.y = p.y AND dsm.x = p.x) AS v FROM (SELECT c_custkey AS id, (c_custkey * 37) % 600 AS y, (c_custkey * 11) % 70 AS x FROM customer) p")
#: a pixel meets every tile whose 20 rows and columns hold it; weights are distances to the tile's rims
twin(
    "tile_mosaic", "dsm dims", f"SELECT y, x::INT AS x, {r('sum(w * v) / sum(w)', 'v')} FROM (SELECT y, x, v + (ty + 2 * tx) % 3 * 10 AS v, least(y - ty * 16 + 1, ty * 16 + 20 - y) * least(x - tx * 16 + 1, tx * 16 + 20 - x) AS w FROM dsm "
    "JOIN tys ON y BETWEEN ty * 16 AND ty * 16 + 19 JOIN txs ON x BETWEEN tx * 16 AND tx * 16 + 19) GROUP BY y, x",
    "tys AS (SELECT unnest(range((SELECT h // 16 + 1 FROM dims))) AS ty), txs AS (SELECT unnest(range((SELECT w // 16 + 1 FROM dims))) AS tx)",
)

KERNEL = "CASE WHEN dy = 0 AND dx = 0 THEN -3.0::DOUBLE WHEN dy <> 0 AND dx <> 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END"
LAPLACE = f"lap AS (SELECT p.y, p.x, sum({KERNEL} * q.v) AS v FROM dsm p, off JOIN dsm q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x)"
twin("laplacian3x3", "dsm", f"SELECT y, x::INT AS x, {r('v', 'v')} FROM lap", f"{OFFSETS}, {LAPLACE}")
GRAD = "grad AS (SELECT p.y, p.x, (coalesce(e.v, 0) - coalesce(w.v, 0)) / 2 AS gx, (coalesce(s.v, 0) - coalesce(n.v, 0)) / 2 AS gy FROM {t} p LEFT JOIN {t} e ON e.y = p.y AND e.x = p.x + 1 LEFT JOIN {t} w ON w.y = p.y AND w.x = p.x - 1 LEFT JOIN {t} s ON s.y = p.y + 1 AND s.x = p.x LEFT JOIN {t} n ON n.y = p.y - 1 AND n.x = p.x)"
twin("gradient_xy", "dsm", f"SELECT y, x::INT AS x, {r('gx', 'gx')}, {r('gy', 'gy')} FROM grad", GRAD.format(t="dsm"))
twin(
    "bilinear_sample", "dsm",
    f"SELECT id, {r('py', 'py')}, {r('px', 'px')}, {r('sum((CASE WHEN j = 1 THEN py - iy ELSE 1 - (py - iy) END) * (CASE WHEN i = 1 THEN px - ix ELSE 1 - (px - ix) END) * coalesce(dsm.v, 0))', 'v')} "
    "FROM a, (VALUES (0), (1)) b(j), (VALUES (0), (1)) c(i) LEFT JOIN dsm ON dsm.y = iy + j AND dsm.x = ix + i GROUP BY id, py, px",
    "a AS (SELECT *, trunc(py)::BIGINT AS iy, trunc(px)::BIGINT AS ix FROM (SELECT c_custkey AS id, (c_custkey * 37) % 600 - 0.75::DOUBLE AS py, (c_custkey * 11) % 70 - 0.5::DOUBLE AS px FROM customer))",
)
BOX = "SELECT p.y, p.x, {s} FROM {t} p JOIN {t} q ON q.y BETWEEN p.y - {k} AND p.y + {k} AND q.x BETWEEN p.x - {k} AND p.x + {k} GROUP BY p.y, p.x"
WIDE = "wide AS (SELECT a.dy, b.dx FROM (SELECT unnest(range(-{k}, {k} + 1)) AS dy) a, (SELECT unnest(range(-{k}, {k} + 1)) AS dx) b)"
EQUI = "SELECT p.y, p.x, {s} FROM {t} p, wide JOIN {t} q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x"
twin("box_mean", "dsm", f"SELECT y, x::INT AS x, {r('v', 'v')} FROM ({EQUI.format(s='avg(q.v) AS v', t='dsm')})", WIDE.format(k=2))
twin(
    "bilateral3x3", "dsm gray", f"SELECT y, x::INT AS x, {r('top / low', 'v')} FROM (SELECT p.y, p.x, sum(w * z) AS top, sum(w) AS low FROM (SELECT p.y, p.x, q.v AS z, exp(0 - (q.c - p.c) * (q.c - p.c) / (2 * 900.0::DOUBLE) - (dy * dy + dx * dx) / (2 * 4.0::DOUBLE) - (q.v - p.v) * (q.v - p.v) / (2 * 0.04::DOUBLE)) AS w FROM b p, off JOIN b q ON q.y = p.y + dy AND q.x = p.x + dx) p GROUP BY p.y, p.x)",
    f"{OFFSETS}, b AS (SELECT y, x, dsm.v, gray.v AS c FROM dsm JOIN gray USING (y, x))",
)
twin(
    "guided_filter", "dsm gray", f"SELECT m.y, m.x::INT AS x, {r('a * i + b', 'v')} FROM ({EQUI.format(s='avg(q.a) AS a, avg(q.b) AS b', t='ab')}) m JOIN g USING (y, x)",
    f"{WIDE.format(k=2)}, g AS (SELECT y, x, dsm.v AS p, gray.v AS i FROM dsm JOIN gray USING (y, x)), "
    f"s AS ({EQUI.format(s='avg(q.i) AS mi, avg(q.p) AS mp, avg(q.i * q.p) AS mip, avg(q.i * q.i) AS mii', t='g')}), "
    "ab AS (SELECT y, x, (mip - mi * mp) / (mii - mi * mi + 10.0::DOUBLE) AS a, mp - (mip - mi * mp) / (mii - mi * mi + 10.0::DOUBLE) * mi AS b FROM s)",
)
twin(
    "weighted_median3x3", "dsm gray", f"SELECT y, x::INT AS x, {r('min(z)', 'v')} FROM (SELECT y, x, z, sum(w) OVER (PARTITION BY y, x ORDER BY z, w ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY y, x) AS total FROM n) WHERE run >= total / 2 - 1e-9 GROUP BY y, x",
    f"{OFFSETS}, b AS (SELECT y, x, dsm.v, gray.v AS c FROM dsm JOIN gray USING (y, x)), n AS (SELECT p.y, p.x, q.v AS z, round(exp(0 - (q.c - p.c) * (q.c - p.c) / (2 * 900.0::DOUBLE)), 9) AS w FROM b p, off JOIN b q ON q.y = p.y + dy AND q.x = p.x + dx)",
)
BITS = "CASE WHEN dy = -1 THEN dx + 1 WHEN dy = 0 THEN CASE WHEN dx < 0 THEN 3 ELSE 4 END ELSE dx + 6 END"
CENSUS = f"{OFFSETS}, census AS (SELECT p.y, p.x, sum(CASE WHEN q.v < p.v THEN 1 << ({BITS}) ELSE 0 END)::INT AS code FROM gray p, off JOIN gray q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x)"
twin("census3x3", "dsm gray", "SELECT y, x::INT AS x, code FROM census", CENSUS)
twin("census_match", "dsm gray", "SELECT a.y, a.x::INT AS x, bit_count(xor(a.code, b.code))::INT AS distance FROM census a JOIN census b ON b.y = a.y AND b.x = a.x + 1", CENSUS)
twin("harris_response", "dsm", f"SELECT y, x::INT AS x, {r('a * b - c * c - 0.04::DOUBLE * (a + b) * (a + b)', 'v')} FROM ({EQUI.format(s='sum(q.gx * q.gx) AS a, sum(q.gy * q.gy) AS b, sum(q.gx * q.gy) AS c', t='grad')})", f"{GRAD.format(t='dsm')}, {WIDE.format(k=1)}")

TILES = "tiles AS (SELECT (y - 1) // 16 AS ty, ((x - 1) // 16)::BIGINT AS tx, y, x, v FROM {t}, dims WHERE y >= 1 AND x >= 1 AND 1 + (y - 1) // 16 * 16 < h - 16 AND 1 + (x - 1) // 16 * 16 < w - 16), top AS (SELECT ty, tx, y AS fy, x AS fx, v FROM (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY abs(v) DESC, y, x) AS k FROM tiles) WHERE k = 1)"
twin("tile_top1_features", "dsm dims", f"SELECT ty, tx, fy, fx::INT AS fx, {r('abs(v)', 'strength')} FROM top", f"{OFFSETS}, {LAPLACE}, {TILES.format(t='lap')}")

RING = "ring(k, dy, dx) AS (VALUES " + ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(RING16)) + ")"


def fast(n: int) -> str:
    """Arc minima by a join of ring places with arcs, strength by a maximum over arcs."""
    return (
        f"{RING}, around AS (SELECT p.y, p.x, k, q.v - p.v AS d FROM gray p, ring JOIN gray q ON q.y = p.y + dy AND q.x = p.x + dx), "
        f"arcs AS (SELECT y, x, arc, min(d) AS lo, min(-d) AS hi, count(*) AS c FROM around, (SELECT unnest(range(16)) AS arc) WHERE (k - arc + 16) % 16 < {n} GROUP BY y, x, arc), "
        f"corner AS (SELECT y, x, greatest(20, max(greatest(lo, hi)) - 1)::INT AS score FROM arcs GROUP BY y, x HAVING sum(c) = {16 * n} AND max(greatest(lo, hi)) > 20)"
    )


for _n in (9, 10, 11, 12):
    twin(f"fast{_n}_score", "dsm gray", "SELECT y, x::INT AS x, score FROM corner", fast(_n))
twin("fast9_detect", "dsm gray", "SELECT y, x::INT AS x FROM corner", fast(9))
NMS = "SELECT a.y, a.x::INT AS x, a.score FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM {t} b, off WHERE (dy <> 0 OR dx <> 0) AND b.y = a.y + dy AND b.x = a.x + dx AND b.score >= a.score)"
twin("nms_8neighbour", "dsm gray", NMS.format(t="c"), f"{OFFSETS}, c AS (SELECT y, x, v::INT AS score FROM gray WHERE v > 100)")
twin("fast9_detect_nms", "dsm gray", NMS.format(t="corner"), f"{OFFSETS}, {fast(9)}")

GRID = (
    "cells AS (SELECT gy, gx, least(gy * 16, h - 31) AS y0, least(gx * 16, w - 31) AS x0 FROM dims, (SELECT unnest(range((SELECT h // 16 + 1 FROM dims))) AS gy), (SELECT unnest(range((SELECT w // 16 + 1 FROM dims))) AS gx)), "
    "sums AS (SELECT gy, gx, sum(v) / 961 AS m, sum(v * v) / 961 AS q FROM cells JOIN u16 ON y >= y0 AND y < y0 + 31 AND x >= x0 AND x < x0 + 31 GROUP BY gy, gx), "
    "gains AS (SELECT *, CASE WHEN q - m * m > 0 THEN 950.0::DOUBLE / (0.95::DOUBLE * sqrt(greatest(q - m * m, 0)) + 50.0::DOUBLE) ELSE 1.0::DOUBLE END AS r1 FROM sums), "
    "grid AS (SELECT gy, gx, 900.0::DOUBLE + (0.1::DOUBLE - r1) * m AS r0, r1 FROM gains)"
)
twin("wallis_grid", "dsm u16 dims", f"SELECT gy::INT AS gy, gx::INT AS gx, {r('r0', 'r0')}, {r('r1', 'r1')} FROM grid", GRID)


def _axis(c: str, n: str) -> str:
    at = f"greatest(({c} - 15) / 16.0::DOUBLE, 0)"
    return f"CASE WHEN floor({at}) >= {n} // 16 THEN {n} // 16 - 1 ELSE floor({at})::BIGINT END AS i{c}, CASE WHEN floor({at}) >= {n} // 16 THEN 0.999::DOUBLE ELSE {at} - floor({at}) END AS f{c}"


twin(
    "wallis_apply", "dsm u16 dims",
    "SELECT y, x::INT AS x, CASE WHEN v = 0 THEN 0.0::DOUBLE WHEN val > 32768 THEN 65535.0::DOUBLE WHEN val < 0 THEN 0.0::DOUBLE ELSE floor(val) END AS v FROM (SELECT p.y, p.x, p.v, round(p.v * "
    + " + ".join(["({})"] * 1).format("(1 - fy) * (1 - fx) * a.r1 + (1 - fy) * fx * b.r1 + fy * (1 - fx) * c.r1 + fy * fx * d.r1")
    + " + (1 - fy) * (1 - fx) * a.r0 + (1 - fy) * fx * b.r0 + fy * (1 - fx) * c.r0 + fy * fx * d.r0, 6) AS val FROM places p JOIN grid a ON a.gy = iy AND a.gx = ix JOIN grid b ON b.gy = iy AND b.gx = ix + 1 JOIN grid c ON c.gy = iy + 1 AND c.gx = ix JOIN grid d ON d.gy = iy + 1 AND d.gx = ix + 1)",
    f"{GRID}, places AS (SELECT y, x, v, {_axis('y', 'h')}, {_axis('x', 'w')} FROM u16, dims)",
)

twin(
    "lsm_one_step", "dsm dsm2 dims",
    f"SELECT fy, fx::INT AS fx, {r('(d * p - b * q) / nullif(a * d - b * b, 0)', 'dx')}, {r('(a * q - b * p) / nullif(a * d - b * b, 0)', 'dy')} FROM (SELECT fy, fx, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS d, sum(gx * (i.v - j.v)) AS p, sum(gy * (i.v - j.v)) AS q "
    "FROM top, dims, wide JOIN dsm i ON i.y = fy + dy AND i.x = fx + dx JOIN dsm2 j ON j.y = i.y AND j.x = i.x JOIN grad ON grad.y = i.y AND grad.x = i.x WHERE fy >= 3 AND fx >= 3 AND fy + 3 < h AND fx + 3 < w GROUP BY fy, fx)",
    f"{GRAD.format(t='dsm2')}, {WIDE.format(k=3)}, {TILES.format(t='dsm')}",
)
twin("zncc", "dsm gray", f"SELECT y, {r('corr(dsm.v, gray.v)', 'zncc')} FROM dsm JOIN gray USING (y, x) GROUP BY y")
TWINS["median_center"] = f"SELECT event_type, {r('quantile_cont(value, 0.5)', 'median')}, count(value) AS n FROM events GROUP BY event_type"
TWINS["weighted_center"] = f"SELECT l_returnflag, {r('sum(w * l_quantity) / sum(w)', 'center')} FROM (SELECT *, exp(0 - (l_discount - 0.05::DOUBLE) * (l_discount - 0.05::DOUBLE) / (2 * 0.02::DOUBLE * 0.02::DOUBLE)) AS w FROM lineitem) GROUP BY l_returnflag"
TWINS["ratio_test"] = "SELECT feature, candidate, score FROM (SELECT o_custkey AS feature, o_orderkey AS candidate, o_totalprice AS score, row_number() OVER w AS k, lead(o_totalprice) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE k = 1 AND (second IS NULL OR second <= 0.8::DOUBLE * score)"
TWINS["intersection_outliers"] = "WITH m AS (SELECT o_orderkey, o_orderpriority, abs(o_totalprice - quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY o_orderpriority)) AS d FROM orders) SELECT o_orderkey, d <= 2.0::DOUBLE * quantile_cont(d, 0.5) OVER (PARTITION BY o_orderpriority) AS inlier FROM m"
twin("repeated_features", "coo", "SELECT i, j, count(*) AS n FROM coo GROUP BY i, j HAVING count(*) > 1")
_quad = [(-100.0, -50.0), (90.0, -60.0), (120.0, 55.0), (-80.0, 40.0)]
twin("point_in_quad", "pts", "SELECT id FROM pts WHERE " + " AND ".join(f"({x1} - ({x0}))::DOUBLE * (lat - ({y0})) >= ({y1} - ({y0}))::DOUBLE * (lon - ({x0}))" for (x0, y0), (x1, y1) in zip(_quad, _quad[1:] + _quad[:1])))
TWINS["connected_tracks"] = (
    "WITH RECURSIVE e AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 7 * 211 AS b FROM orders WHERE o_orderkey % 11 = 0), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, b FROM reach r JOIN both_ways w ON w.a = r.other) SELECT node, min(other) AS track FROM reach GROUP BY node"
)

_k = ["x0", "x1", "x2"]
twin("normal_equations", "ls", "SELECT g, " + ", ".join([*[r(f"sum({_k[p]} * {_k[q]})", f"a_{p}_{q}", 3) for p in range(3) for q in range(p, 3)], *[r(f"sum({_k[p]} * y)", f"l_{p}", 3) for p in range(3)]]) + ", count(*) AS n FROM ls GROUP BY g")
twin("ols_fit", "ls", f"SELECT g, {r('regr_intercept(y, x1)', 'intercept', 4)}, {r('regr_slope(y, x1)', 'slope', 4)} FROM ls GROUP BY g")
twin(
    "ridge_fit", "ls", f"SELECT g, {r('alpha', 'alpha', 4)}, {r('(d * p - b * q) / (a * d - b * b)', 'intercept', 4)}, {r('(a * q - b * p) / (a * d - b * b)', 'slope', 4)} FROM (SELECT g, alpha, n + alpha AS a, b, c + alpha AS d, p, q FROM s)",
    "s AS (SELECT g, count(*) AS n, sum(x1) AS b, sum(x1 * x1) AS c, sum(y) AS p, sum(x1 * y) AS q, avg((100 + 1000 * x1 - y) ^ 2) * (2 / 1010000.0::DOUBLE) AS alpha FROM ls GROUP BY g)",
)
SUMMED = "m AS (SELECT i, j, sum(v) AS v FROM coo GROUP BY i, j), m2 AS (SELECT i, j, sum(v) AS v FROM coo2 GROUP BY i, j)"
twin("matmul_coo", "coo coo2", f"SELECT a.j AS i, b.j, {r('sum(a.v * b.v)', 'v', 4)} FROM m a JOIN m b ON a.i = b.i WHERE a.j <= 50 AND b.j <= 50 GROUP BY a.j, b.j", SUMMED)
twin("mat_add", "coo coo2", f"SELECT i, j, {r('coalesce(m.v, 0) + coalesce(m2.v, 0)', 'v', 4)} FROM m FULL JOIN m2 USING (i, j)", SUMMED)
twin("mat_transpose", "coo coo2", f"SELECT j AS i, i AS j, {r('v', 'v', 4)} FROM m", SUMMED)
twin("triplets_sum", "coo", f"SELECT i, j, {r('sum(v)', 'v', 4)} FROM coo GROUP BY i, j")
twin("sparse_union_sub", "coo coo2", f"SELECT i, j, {r('sum(v)', 'v', 4)} FROM (SELECT * FROM m UNION ALL SELECT i, j, -v FROM m2) GROUP BY i, j", SUMMED)
twin("sparse_hadamard", "coo coo2", f"SELECT i, j, {r('m.v * m2.v', 'v', 4)} FROM m JOIN m2 USING (i, j)", SUMMED)
twin("sparse_dot", "coo coo2", f"SELECT {r('coalesce(sum(m.v * m2.v), 0)', 'v', 3)} FROM m JOIN m2 USING (i, j)", SUMMED)
twin("matrix_reductions", "coo", f"SELECT {r('sum(v)', 'total', 3)}, {r('avg(v)', 'mean', 3)}, {r('min(v)', 'v_min', 3)}, {r('max(v)', 'v_max', 3)}, {r('coalesce(sum(v) FILTER (i = j), 0)', 'trace', 3)}, {r('sum(v * v)', 'squared_norm', 3)} FROM coo")
twin("argmax_cell", "coo coo2", "SELECT (SELECT i FROM m ORDER BY v, i, j LIMIT 1) AS min_i, (SELECT j FROM m ORDER BY v, i, j LIMIT 1) AS min_j, (SELECT i FROM m ORDER BY v DESC, i, j LIMIT 1) AS max_i, (SELECT j FROM m ORDER BY v DESC, i, j LIMIT 1) AS max_j", SUMMED)
twin("row_norms", "coo", f"SELECT i, {r('sum(v)', 'total', 4)}, {r('avg(v)', 'mean', 4)}, {r('min(v)', 'v_min', 4)}, {r('max(v)', 'v_max', 4)}, count(v) AS n, {r('sum(v * v)', 'squared_norm', 4)}, {r('sqrt(sum(v * v))', 'norm', 4)}, min(v <> 0) AS all_set, max(v <> 0) AS any_set FROM coo GROUP BY i")
twin("bool_reductions", "coo", "SELECT count(*) = count(*) FILTER (v > 10) AS all_true, count(*) FILTER (v > 10) > 0 AS any_true, count(*) FILTER (v > 10) AS n_true, count(*) FILTER (isnan(v)) > 0 AS has_nan, count(*) FILTER (NOT isfinite(v)) = 0 AS all_finite FROM coo")
_det = "nullif(l_quantity - l_tax * l_discount, 0)"
TWINS["inverse2x2"] = f"SELECT l_orderkey, l_linenumber, {r(f'1 / {_det}', 'a')}, {r(f'-l_tax / {_det}', 'b')}, {r(f'-l_discount / {_det}', 'c')}, {r(f'l_quantity / {_det}', 'd')} FROM lineitem"
twin("bbox_merge", "pts", f"SELECT id % 10 AS k, {r('min(lon)', 'x0')}, {r('min(lat)', 'y0')}, {r('max(lon) + 30', 'x1')}, {r('max(lat) + 20', 'y1')}, {r('max(lon)', 'in_x0')}, {r('max(lat)', 'in_y0')}, {r('min(lon) + 30', 'in_x1')}, {r('min(lat) + 20', 'in_y1')} FROM pts GROUP BY id % 10")
_q = "l_quantity"
TWINS["elementwise_maths"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(r(e, n) for e, n in (
    (f"abs({_q} - 25)", "absolute"), (f"{_q} * {_q}", "squared"), (f"exp(-{_q} / 10)", "exponential"), (f"ln({_q})", "logarithm"), (f"ln(1 + {_q})", "log_plus"), (f"log10({_q})", "decadic"), (f"sqrt({_q})", "root"), (f"1 / sqrt({_q})", "inverse_root"),
    (f"sign({_q} - 25)::DOUBLE", "sign"), (f"cos({_q})", "cosine"), (f"sin({_q})", "sine"), (f"atan({_q})", "arc_tangent"), (f"(exp({_q} / 25) - 1) / (exp({_q} / 25) + 1)", "hyperbolic"), (f"{_q} * {_q} * {_q}", "cube"), (f"floor({_q} / 3)", "lower"), (f"ceil({_q} / 3)", "upper"),
    (f"CASE WHEN {_q} > 25 THEN {_q} ELSE 25.0::DOUBLE END", "larger"), (f"CASE WHEN {_q} > 25 THEN {_q} ELSE -{_q} END", "chosen"))) + " FROM lineitem"

WRAP = "(({x}) + 180 - trunc((({x}) + 180) / 360) * 360 - 180)"
_w = WRAP.format(x="lon")
ZONE = (
    f"z AS (SELECT *, {_w} AS wl, (trunc(({_w} + 180) / 6) + 1)::INT AS raw FROM pts), zones AS (SELECT *, CASE WHEN lat >= 72 AND lat < 84 AND wl >= 0 AND wl < 42 THEN CASE WHEN wl < 9 THEN 31 WHEN wl < 21 THEN 33 WHEN wl < 33 THEN 35 ELSE 37 END "
    "WHEN lat >= 56 AND lat < 64 AND wl >= 3 AND wl < 12 THEN 32 ELSE raw END AS zone FROM z)"
)
twin("utm_zone", "pts", "SELECT id, raw AS raw_zone, zone::INT AS zone FROM zones", ZONE)
twin("lon_wrap", "pts", f"SELECT id, {r(WRAP.format(x='lon * 3'), 'lon')} FROM pts")
twin("zone_letter_a", "pts", f"SELECT id, CASE WHEN l < -80 OR l > 84 THEN 'Z' WHEN l >= 72 THEN 'X' ELSE '{BANDS}'[(floor((l + 80) / 8))::INT + 1] END AS letter FROM (SELECT id, lat * 1.1::DOUBLE AS l FROM pts)")
twin("zone_letter_b", "pts", f"SELECT id, CASE WHEN l < -72 THEN 'C' WHEN l >= 72 THEN 'X' ELSE '{BANDS}'[(floor((l + 80) / 8))::INT + 1] END AS letter FROM (SELECT id, lat * 1.1::DOUBLE AS l FROM pts)")
TWINS["ellipsoid_lookup"] = "WITH e(k, name, radius, ecc2) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}::DOUBLE, {e}::DOUBLE)" for i, n, a, e in ELLIPSOIDS[1:]) + ") SELECT c_custkey AS point, name, radius, ecc2 FROM customer JOIN e ON k = c_custkey % 23 + 1"
_a, _e = WGS84
_ep = _e / (1 - _e)
twin(
    "utm_forward", "pts", f"SELECT id, zone::INT AS zone, {r(f'{K0}::DOUBLE * n * (a + (1 - t + c) * a ^ 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_ep!r}::DOUBLE) * a ^ 5 / 120) + 500000', 'easting', 4)}, "
    f"{r(f'{K0}::DOUBLE * (m + n * tan(phi) * (a ^ 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ^ 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_ep!r}::DOUBLE) * a ^ 6 / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END', 'northing', 4)} FROM u",
    f"{ZONE}, p AS (SELECT *, radians(lat) AS phi, radians(wl - (zone * 6 - 183)) AS away FROM zones), u AS (SELECT *, {_a}::DOUBLE / sqrt(1 - {_e}::DOUBLE * sin(phi) ^ 2) AS n, tan(phi) ^ 2 AS t, {_ep!r}::DOUBLE * cos(phi) ^ 2 AS c, cos(phi) * away AS a, "
    f"{_a}::DOUBLE * ({1 - _e / 4 - 3 * _e**2 / 64 - 5 * _e**3 / 256!r}::DOUBLE * phi - {3 * _e / 8 + 3 * _e**2 / 32 + 45 * _e**3 / 1024!r}::DOUBLE * sin(2 * phi) + {15 * _e**2 / 256 + 45 * _e**3 / 1024!r}::DOUBLE * sin(4 * phi) - {35 * _e**3 / 3072!r}::DOUBLE * sin(6 * phi)) AS m FROM p)",
)
_r1 = (1 - math.sqrt(1 - _e)) / (1 + math.sqrt(1 - _e))
TWINS["utm_inverse"] = (
    f"WITH p AS (SELECT c_custkey AS id, 300000.0::DOUBLE + c_custkey % 1000 * 400 - 500000 AS x, c_custkey % 900 * 10000.0::DOUBLE - CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END AS y, c_custkey % 60 + 1 AS z FROM customer), "
    f"q AS (SELECT *, y / {K0 * _a * (1 - _e / 4 - 3 * _e**2 / 64 - 5 * _e**3 / 256)!r}::DOUBLE AS mu FROM p), "
    f"f AS (SELECT *, mu + {3 * _r1 / 2 - 27 * _r1**3 / 32!r}::DOUBLE * sin(2 * mu) + {21 * _r1**2 / 16 - 55 * _r1**4 / 32!r}::DOUBLE * sin(4 * mu) + {151 * _r1**3 / 96!r}::DOUBLE * sin(6 * mu) AS phi FROM q), "
    f"g AS (SELECT *, {_a}::DOUBLE / sqrt(1 - {_e}::DOUBLE * sin(phi) ^ 2) AS n, {_a * (1 - _e)!r}::DOUBLE / pow(1 - {_e}::DOUBLE * sin(phi) ^ 2, 1.5) AS rho, tan(phi) ^ 2 AS t, {_ep!r}::DOUBLE * cos(phi) ^ 2 AS c FROM f), "
    f"h AS (SELECT *, x / (n * {K0}::DOUBLE) AS d FROM g) "
    f"SELECT id, {r(f'degrees(phi - n * tan(phi) / rho * (d ^ 2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {_ep!r}::DOUBLE) * d ^ 4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {_ep!r}::DOUBLE - 3 * c * c) * d ^ 6 / 720))', 'lat')}, "
    f"{r(f'z * 6 - 183 + degrees((d - (1 + 2 * t + c) * d ^ 3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {_ep!r}::DOUBLE + 24 * t * t) * d ^ 5 / 120) / cos(phi))', 'lon')} FROM h"
)
_p, _l, _h = "(lat / 90)", "(lon / 180)", f"({50 / 300!r}::DOUBLE)"
_t = ["1", _l, _p, _h, f"{_l}*{_p}", f"{_l}*{_h}", f"{_p}*{_h}", f"{_l}*{_l}", f"{_p}*{_p}", f"{_h}*{_h}", f"{_p}*{_l}*{_h}", f"{_l}*{_l}*{_l}", f"{_l}*{_p}*{_p}", f"{_l}*{_h}*{_h}", f"{_l}*{_l}*{_p}", f"{_p}*{_p}*{_p}", f"{_p}*{_h}*{_h}", f"{_l}*{_l}*{_h}", f"{_p}*{_p}*{_h}", f"{_h}*{_h}*{_h}"]
_sum = lambda k: " + ".join(f"{1.0 / (i + k)!r}::DOUBLE*{t}" for i, t in enumerate(_t))
_den = "1 + 0.001::DOUBLE * (" + " + ".join(_t[1:]) + ")"
twin("rpc_project", "pts", f"SELECT id, {r(f'({_sum(1)}) / ({_den}) * 500 + 500', 'line')}, {r(f'({_sum(2)}) / ({_den}) * 400 + 400', 'samp')} FROM pts")
twin("footprint_area", "pts", f"SELECT id, {r('abs(lon * (lat + 0.5::DOUBLE) - (lon + 2) * lat + (lon + 2) * (lat + 2) - (lon + 3) * (lat + 0.5::DOUBLE) + (lon + 3) * (lat + 1) - lon * (lat + 2) + lon * lat - lon * (lat + 1)) / 2', 'area')} FROM pts")

TWINS["xml_encode"] = "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS encoded FROM pages"
TWINS["xml_entities"] = "SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS decoded FROM pages"
TWINS["xml_condense"] = r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS condensed FROM documents"
TWINS["typed_attributes"] = "SELECT p_partkey, p_size AS whole, p_size::DOUBLE AS number, CASE WHEN p_size % 7 < 3 THEN true WHEN p_size % 7 < 6 THEN false END AS truth FROM part"
TWINS["file_names"] = "SELECT p_partkey, p_name || '.tif' AS name, 'C:\\data/' || p_brand AS folder FROM part"
