"""Sensor models, adjustment and image pairs on made-up cameras, against what they were made from."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import matching, sensor
from gridloom.plans import photogrammetry
from gridloom.plans import views as V


def camera(spark, numbers):
    return spark.createDataFrame([(k,) for k in numbers], "image long").select("image", V.model(F.col("image")).alias("model"))


def points(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), float(h)) for i, (a, b, h) in enumerate(zip(rng.uniform(-50, 50, n), rng.uniform(-90, 90, n), rng.uniform(0, 300, n)))]
    return spark.createDataFrame(rows, "point long, lat double, lon double, height double")


def test_derivatives_by_differences():
    place, step = dict(p=0.3, l=-0.7, h=1.1), 1e-6
    value = lambda k, at: math.prod(v**e for v, e in zip((at["l"], at["p"], at["h"]), sensor.EXPONENTS[k]))
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.range(1).select(*[sensor.monomial_derivative(k, c, *(F.lit(place[x]) for x in "plh")).alias(f"{c}{k}") for c in "plh" for k in range(20)]).first()
    for c in "plh":
        for k in range(20):
            up, down = (value(k, place | {c: place[c] + s}) for s in (step, -step))
            assert math.isclose(row[f"{c}{k}"], (up - down) / (2 * step), abs_tol=1e-8)


def test_a_model_that_sees_nothing_gives_null(spark):
    flat = camera(spark, [1]).withColumn("model", F.col("model").withField("line_num", F.array(*[F.lit(0.0)] * 20)))
    r = flat.select(sensor.image_to_ground(F.col("model"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("g"), sensor.image_to_ground(F.lit(None).cast(flat.schema["model"].dataType), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("n")).first()
    assert r.g.lat is None and r.n.lat is None


def test_intersection_odd_rows(spark):
    seen = spark.createDataFrame([(p, k) for p in range(5) for k in ((1, 3, 4) if p else (1,))], "point long, image long")
    obs = sensor.observed(points(spark, 5), camera(spark, (1, 3, 4)), seen)
    obs = obs.withColumn("line", F.when(~((F.col("point") == 4) & (F.col("image") == 3)), F.col("line")))
    got = {r.point: r for r in sensor.forward_intersection(obs).collect()}
    want = {r.point: r for r in points(spark, 5).collect()}
    assert got[0].lat is None and got[0].images == 1 and got[4].images == 2
    assert all(math.isclose(got[p][c], want[p][c], abs_tol=1e-4) for p in (1, 2, 3, 4) for c in ("lat", "lon", "height")) and all(got[p].rms < 1e-3 for p in (1, 2, 3))
    assert sensor.forward_intersection(obs.limit(0)).collect() == []


def test_adjustment_finds_the_moves(spark):
    """Two images moved against two that hold; common moves of all would be seen by none."""
    numbers, moves = (0, 1, 2, 3), {2: (0.75, -0.5), 3: (-0.25, 1.0)}
    seen = spark.range(40).select(F.col("id").alias("point"), F.explode(F.array(*[F.lit(k) for k in numbers]).cast("array<long>")).alias("image"))
    obs = sensor.observed(points(spark, 40), camera(spark, numbers), seen)
    for k, (row, col) in moves.items():
        obs = obs.withColumn("line", F.col("line") + F.when(F.col("image") == k, row).otherwise(0.0)).withColumn("samp", F.col("samp") + F.when(F.col("image") == k, col).otherwise(0.0))
    got = {r.image: (r.drow, r.dcol) for r in sensor.bundle_adjust(obs, F.col("image") < 2, rounds=3).collect()}
    assert got[0] == got[1] == (0.0, 0.0)
    assert all(abs(a - b) < 1e-3 for k in moves for a, b in zip(got[k], moves[k]))


def test_sampling_of_a_known_camera(spark):
    """A camera over the equator with 100 x 100 pixels of one ten-thousandth of a degree."""
    m = V.model(F.lit(3)).withField("line_num", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), *[F.lit(0.0)] * 17)).withField("samp_num", F.array(F.lit(0.0), F.lit(1.0), *[F.lit(0.0)] * 18))
    for n in ("line_den", "samp_den"):
        m = m.withField(n, F.array(F.lit(1.0), *[F.lit(0.0)] * 19))
    for n, v in (("line_off", 49.5), ("samp_off", 49.5), ("line_scale", 49.5), ("samp_scale", 49.5), ("lat_scale", 49.5e-4), ("long_scale", 49.5e-4), ("long_off", 3.0)):
        m = m.withField(n, F.lit(v))
    image = spark.range(1).select(F.lit("a").alias("image"), m.alias("model"), F.lit(100).alias("rows"), F.lit(100).alias("cols"))
    r = sensor.ground_sampling(image).first()
    assert abs(r.gsd - 11.09) < 0.03 and r.height == 100.0 and r.zone == 31
    corner = {r.corner: (r.lat, r.lon) for r in sensor.corners(image).collect()}
    assert all(math.isclose(a, b, abs_tol=1e-9) for k, want in enumerate([(-49.5e-4, 3 - 49.5e-4), (-49.5e-4, 3 + 49.5e-4), (49.5e-4, 3 + 49.5e-4), (49.5e-4, 3 - 49.5e-4)]) for a, b in zip(corner[k], want))


def test_patches_in_order(spark):
    plain = F.col("model").withField("line_num", F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0), *[F.lit(0.0)] * 17)).withField("samp_num", F.array(F.lit(0.0), F.lit(1.0), *[F.lit(0.0)] * 18)).withField("line_den", F.array(F.lit(1.0), *[F.lit(0.0)] * 19)).withField("samp_den", F.array(F.lit(1.0), *[F.lit(0.0)] * 19))
    at = camera(spark, range(4)).select(F.lit(1).alias("strip"), F.col("image").alias("patch"), plain.withField("line_off", F.lit(50.0)).withField("samp_off", F.lit(50.0)).withField("line_scale", F.lit(90.0)).withField("samp_scale", F.lit(180.0)).withField("lat_off", 10.0 - 7.0 * F.pmod(F.col("image") * 3, F.lit(4))).withField("long_off", F.col("image").cast("double")).alias("model"), F.lit(101).alias("rows"), F.lit(101).alias("cols"))
    got = {r.patch: r for r in sensor.translations(at).collect()}
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1]["rank"])] == [0, 3, 2, 1] and got[0].tx is None
    assert math.isclose(got[3].ty, 7.0, abs_tol=1e-6) and math.isclose(got[3].tx, 3.0, abs_tol=1e-6) and math.isclose(got[2].tx, -1.0, abs_tol=1e-6)


@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_overlaps_by_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(-8, 8, (2, 60)), *rng.uniform(0, 4, (2, 60))))]
    rows += [(100, 0.0, 0.0, 0.0, 5.0), (101, None, 0.0, 1.0, 1.0), (102, -9.0, -9.0, 9.0, 9.0)]
    got = {(r.a, r.b): r.area for r in sensor.overlaps(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), cell).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and None not in a + b and a[3] > a[1] and b[3] > b[1]:
                w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
                if w > 0 and h > 0:
                    want[a[0], b[0]] = w * h
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_strip_ids(spark):
    rows = [("12_3",), (" 4_05 ",), ("x_1",), ("1_",), (None,), ("99999999999_1",)]
    s, p = sensor.strip_patch(F.col("image"))
    assert [tuple(r) for r in spark.createDataFrame(rows, "image string").select(s, p).collect()] == [(12, 3), (4, 5), (None, None), (None, None), (None, None), (None, 1)]


def test_descriptors(spark):
    d = list(range(128))
    r = spark.createDataFrame([(d,), (d[:5],), (None,)], "d array<int>").select(matching.transposed_descriptor(F.col("d")).alias("t"), matching.scaled_descriptor(F.col("d")).alias("s")).collect()
    want = [0] * 128
    for j in range(4):
        for i in range(4):
            for t in range(8):
                want[8 * i + 32 * (3 - j) + (8 - t) % 8] = d[t + 8 * i + 32 * j]
    assert r[0].t == want and r[1].t is None and r[2].t is None and r[0].s[3] == 1536.0


def test_unknown_scores_are_refused(spark):
    with pytest.raises(ValueError, match="unsupported"):
        matching.window_score(spark.createDataFrame([], "v1 double, v2 double, c1 int, c2 int"), "hog")


def test_places_are_traced_and_projected_by_compiled_code_or_batches(spark):
    """No function of arrays is interpreted for each row; odd models have no place."""
    one = camera(spark, range(5)).filter("image = 3").select("model")
    m = F.col("model")
    odd = {"whole": m, "none": F.when(m["line_off"] < 0, m), "short": m.withField("line_num", F.slice(m["line_num"], 1, 19)), "hole": m.withField("samp_den", F.transform(m["samp_den"], lambda v: F.nullif(v, F.lit(-0.002)))), "flat": m.withField("line_num", F.array_repeat(F.lit(0.0), 20)), "unset": m.withField("samp_off", F.lit(None).cast("double"))}
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("model")) for n, v in odd.items()])).alias("r")).select("r.*")
    g = sensor.image_to_ground(m, F.lit(4000.0), F.lit(3000.0), F.lit(50.0))
    line, samp = sensor.project(m, F.col("g.lat"), F.col("g.lon"), F.lit(50.0))
    got = rows.withColumn("g", g).select("name", "g.lat", "g.lon", line.alias("line"), samp.alias("samp"))
    found = {r.name: r for r in got.collect()}
    assert len(found) == 6 and all((r.lat is None and r.lon is None and r.line is None) == (n != "whole") for n, r in found.items())
    assert abs(found["whole"].line - 4000) < 1e-6 and abs(found["whole"].samp - 3000) < 1e-6
    traced = camera(spark, range(5)).withColumn("g", sensor.image_to_ground(m, F.lit(4000.0), F.lit(3000.0), F.lit(50.0)))
    line, samp = sensor.project(m, F.col("g.lat"), F.col("g.lon"), F.lit(50.0))
    assert "lambdafunction" not in traced.select("image", line.alias("line"), samp.alias("samp"))._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_of_features_in_one_place(spark):
    """Every pair of features that share their places, from one distance; an id in two places has its least distance."""
    at = spark.range(60).select("id", (F.col("id") % 3 * 20.0).alias("line"), F.lit(5.0).alias("samp"))
    other = spark.range(40).select(F.col("id") + 100, (F.col("id") % 2 * 40.0 + 1).alias("line"), F.lit(5.0).alias("samp")).toDF("id", "line", "samp")
    flat = photogrammetry._affine()
    unit = lambda n, k: F.array(*[F.lit(1.0 if x == k else 0.0) for x in range(20)]).alias(n)
    plan = flat.withField("line_num", unit("a", 2)).withField("samp_num", unit("b", 1))
    find = lambda a, b: sensor.epipolar_candidates(a, b, plan, plan, 0.0, 2.0, 1.0, 2.5)
    out = find(at, other)
    got = {(r.id, r.candidate): round(r.distance, 9) for r in out.collect()}
    assert got == {(i, 100 + j): 1.0 for i in range(60) for j in range(40) if i % 3 != 1 and (i % 3 == 0) == (j % 2 == 0)} and out.count() == len(got)
    assert not re.search(r"Aggregate \[id#\d+L?, candidate", out._jdf.queryExecution().optimizedPlan().toString())
    again = find(at.union(at).union(at.filter("id = 0").withColumn("line", F.lit(0.5))), other)
    assert {(r.id, r.candidate): round(r.distance, 9) for r in again.collect()} == got | {(0, 100 + j): 0.5 for j in range(0, 40, 2)} and again.count() == len(got)
