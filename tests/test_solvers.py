"""Krylov solvers where their recurrences break down."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import linalg
from gridloom.sources import storage


def frames(spark, a, b):
    m = [(i, j, float(v)) for (i, j), v in np.ndenumerate(np.array(a)) if v]
    return spark.createDataFrame(m, "i long, j long, v double"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")


def solved(df, n):
    rows = {r.i: r for r in df.collect()}
    return np.array([rows[i].v for i in range(n)]), rows[0].residual


@pytest.mark.parametrize("a, b", [([[1, 3], [-1, 1]], [1, -1]), ([[1, -2, 0], [2, 1, 5], [0, -5, 1]], [1, 0, 0]), ([[2, 1], [1, -3]], [3, 1])])
def test_bicgstab_breakdown(spark, a, b):
    x, residual = solved(linalg.bicgstab(*frames(spark, a, b)), len(b))
    assert np.allclose(x, np.linalg.solve(np.array(a, float), b), atol=1e-6) and residual < 1e-8


def test_singular_and_indefinite_systems_end(spark):
    x, residual = solved(linalg.bicgstab(*frames(spark, [[1, 1], [-1, -1]], [1, 1])), 2)
    assert np.isfinite(x).all() and residual > 1e-3
    m, b = frames(spark, [[1, 2], [2, 1]], [1, -1])  # the first direction has curvature -2
    x, residual = solved(linalg.conjugate_gradient(m, b), 2)
    assert np.isfinite(x).all() and residual == 1.0
    x, residual = solved(linalg.bicgstab(m, b), 2)
    assert np.allclose(x, [-1, 1]) and residual < 1e-8
    nothing = m.limit(0), b.limit(0)
    assert linalg.bicgstab(*nothing).count() == 0 == linalg.conjugate_gradient(*nothing).count()


def test_saved_tables_leave_no_shuffle_files(spark):
    """Those of earlier jobs may go meanwhile; those of the saved table must."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        at = manager.getAllFiles().iterator()
        return {name for name in iter(lambda: at.next().getName() if at.hasNext() else None, None) if name.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key, None)
    out = storage.save(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key, None) == was
    assert {r.k: r.n for r in out.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}
