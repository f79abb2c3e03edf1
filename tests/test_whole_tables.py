"""Queries without an SQL twin over all rows of the tables, against brute force."""

import duckdb
import numpy as np

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def dense():
    cells = duckdb.sql(f"SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity)::DOUBLE AS v FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").fetchall()
    rows, cols = ({k: n for n, k in enumerate(sorted({c[at] for c in cells}))} for at in (0, 1))
    a = np.zeros((len(rows), len(cols)))
    for i, j, v in cells:
        a[rows[i], cols[j]] = v
    return list(rows), list(cols), a


def test_product_of_all_parts(spark):
    _, parts, a = dense()
    got = {(r.i, r.j): r.v for r in QUERIES["matmul_coo_all"](spark, SF).collect()}
    want = a.T @ a
    assert set(got) == {(parts[p], parts[q]) for p, q in zip(*np.nonzero(want))}
    assert np.allclose([got[parts[p], parts[q]] for p, q in zip(*np.nonzero(want))], want[np.nonzero(want)])


def test_system_of_all_suppliers(spark):
    suppliers, _, a = dense()
    g = a @ a.T
    want = np.linalg.solve(g + np.diag(np.diag(g)), np.ones(len(g)))
    got = {r.i: r.v for r in QUERIES["conjugate_gradient"](spark, SF).collect()}
    assert sorted(got) == suppliers and np.allclose([got[i] for i in suppliers], want, rtol=1e-5, atol=0)


def test_tracks_of_all_orders(spark):
    links = duckdb.sql(f"SELECT o_custkey, o_custkey + o_orderkey % 7 * 211 FROM '{SF}/orders.parquet'").fetchall()
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.track for r in QUERIES["connected_tracks_all"](spark, SF).collect()}
    assert got == {x: find(x) for x in parent}
