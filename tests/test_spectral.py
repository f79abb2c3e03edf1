"""Singular triples of sparse matrices against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import spectral
from gridloom.plans import views

SF = "/root/testdata/sf0.001"


def dense(df, key, n, k):
    out = np.zeros((n, k))
    for r in df.collect():
        out[r[key], r["rank"]] = r["v"]
    return out


def test_ten_largest_of_supplier_by_part(spark):
    m = views.coo(spark, SF)
    rows = m.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    a = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1))
    for r in rows:
        a[r.i, r.j] = r.v
    values, left, right = spectral.singular_triples(m, 5, extra=6)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(values, want[:5], rtol=1e-8)
    u, v = dense(left, "i", a.shape[0], 5), dense(right, "j", a.shape[1], 5)
    assert np.allclose(u.T @ u, np.eye(5), atol=1e-8) and np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    assert np.allclose(a @ v, u * values, atol=1e-5 * want[0])
    fit = spectral.low_rank(left, right, values, F.col("i"), F.col("j"), spark.createDataFrame([(3, 7), (9, 100)], "i long, j long")).collect()
    assert [r.fit for r in sorted(fit)] == pytest.approx([(u[i] * values) @ v[j] for i, j in ((3, 7), (9, 100))])


def test_wide_matrix_with_a_gap_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 4)) @ np.diag([50, 20, 9, 4]) @ rng.normal(size=(4, 90)) + 1e-3 * rng.normal(size=(60, 90))
    cells = [(int(i), int(j), float(v) / 2) for (i, j), v in np.ndenumerate(a) for _ in (0, 1)]  # each place twice
    df = spark.createDataFrame([*cells, (0, 0, None), (None, 1, 5.0)], "i long, j long, v double").withColumn("V2", F.lit(1)).withColumn("rank", F.lit("x"))
    values, left, right = spectral.singular_triples(df, 4, extra=3, rounds=3)
    u, s, v = np.linalg.svd(a)
    assert np.allclose(values, s[:4], rtol=1e-9)
    got = dense(right, "j", 90, 4)
    assert np.allclose(np.abs(np.sum(got * v[:4].T, axis=0)), 1, atol=1e-8) and all(got[np.abs(got[:, t]).argmax(), t] > 0 for t in range(4))
    low = spark.createDataFrame([(i, j, float((i + 1) * (j + 2))) for i in range(5) for j in range(6)], "i long, j long, v double")
    values, left, right = spectral.singular_triples(low, 3, extra=2)
    assert len(values) == 1 and left.count() == 5 and right.count() == 6  # rank one
    values, left, right = spectral.singular_triples(df.limit(0), 3)
    assert values == [] and left.count() == right.count() == 0
