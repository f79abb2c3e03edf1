"""Linear algebra on coordinate matrices (i, j, v) and least squares by normal equations.

Products and reductions are joins and grouped sums. A least-squares fit needs one pass that
sums k(k+1)/2 + k products per group; only those k x k systems meet numpy.

NULL entries count in no sum; a NULL coordinate matches nothing. Entries that repeat a cell add up in sums and
products (:func:`hadamard`, :func:`combine` and :func:`arg_extremes` need each cell once: :func:`from_triplets`).
Empty matrices give no rows, or one row of zeros or NULLs where the result is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import save

SIDE = 2048  # of the squares of a product
PRODUCTS_AT_ONCE = 1 << 22


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def from_triplets(t: DataFrame) -> DataFrame:
    """Duplicates are summed."""
    return t.groupBy("i", "j").agg(F.sum("v").alias("v"))


def keep_last(t: DataFrame, order: str) -> DataFrame:
    """Of duplicates the one with the highest ``order`` stays."""
    return t.groupBy("i", "j").agg(F.max_by("v", order).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of supports; one shuffle, no join."""
    return from_triplets(a.unionByName(b))


def combine(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """Any ``op(x, y)`` over the union of supports, a missing side as 0."""
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["i", "j"], "full_outer")
    zero = F.lit(0.0)
    return both.select("i", "j", op(F.coalesce("x", zero), F.coalesce("y", zero)).alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["i", "j"]).select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return hadamard(a, b).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def multiply(a: DataFrame, b: DataFrame, eps: float | None = None) -> DataFrame:
    """Sparse product; entries up to ``eps`` are pruned if given.

    Of doubles at whole-number places, the entries of a and b that meet are dealt to the squares of ``SIDE`` x ``SIDE`` cells of the
    product, each of which one group sums up, so that no partial product is shuffled: an entry is copied once for each square of
    its row of squares that has any product of it. A square holds its cells and the entries of SIDE rows of a and columns of b.
    """
    whole, real = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    kinds = dict(a.dtypes), dict(b.dtypes)
    if kinds[0]["i"] in whole and kinds[1]["j"] in whole and {kinds[0]["v"], kinds[1]["v"]} <= real:
        packed = lambda m, at, key, n: m.select(F.col(key).alias("k"), F.floor(F.col(at) / SIDE).alias(f"b{n}"), F.struct(F.col(at).cast("long").alias("at"), F.col("v").cast("double").alias("v")).alias("c")).filter("k is not null")
        lists = lambda p, n: p.groupBy("k", f"b{n}").agg(F.collect_list("c").alias("c")).select("k", f"b{n}", F.transform("c.at", lambda x: (x - F.col(f"b{n}") * SIDE).cast("short")).alias(f"at{n}"), F.col("c.v").alias(f"v{n}"))
        met = lists(packed(a, "i", "j", 0), 0).join(lists(packed(b, "j", "i", 1), 1), "k").drop("k")
        out = met.groupBy("b0", "b1").applyInArrow(_square, "i bigint, j bigint, v double")
        out = out.select(F.col("i").cast(kinds[0]["i"]).alias("i"), F.col("j").cast(kinds[1]["j"]).alias("j"), "v")
    else:
        right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
        out = a.join(right, "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out if eps is None else out.filter(F.abs("v") > eps)


def _square(key: tuple[pa.Scalar, ...], met: pa.Table) -> pa.Table:
    """One square of a product, from rows (at0, v0, at1, v1): lists of entries of which every one of a meets every one of b."""
    sums, hits, good = np.zeros(SIDE * SIDE), np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
    some = False
    for batch in met.to_batches():
        many = [pc.list_value_length(batch.column(f"at{n}")).to_numpy(zero_copy_only=False) for n in (0, 1)]
        at = [pc.fill_null(batch.column(f"at{n}").flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1)]  # a NULL place has a square of its own
        values = [batch.column(f"v{n}").flatten() for n in (0, 1)]
        v, lost = [x.to_numpy(zero_copy_only=False) for x in values], [x.is_null().to_numpy(zero_copy_only=False) for x in values]
        any_lost = bool(lost[0].any() or lost[1].any())
        some |= any_lost
        count = np.repeat(many[1], many[0])  # partners of each entry of a
        first = np.repeat(np.cumsum(many[1]) - many[1], many[0])
        ends = np.cumsum(count)
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS_AT_ONCE, "right")))
            n = count[lo:hi]
            p = np.repeat(np.arange(lo, hi), n)
            q = np.arange(n.sum()) + np.repeat(first[lo:hi] - (np.cumsum(n) - n), n)
            cell = at[0][p] * SIDE + at[1][q]
            x = v[0][p] * v[1][q]
            if any_lost:
                ok = ~(lost[0][p] | lost[1][q])
                good += np.bincount(cell[ok], minlength=SIDE * SIDE)
                x = np.where(ok, x, 0.0)
            else:
                good += (n := np.bincount(cell, minlength=SIDE * SIDE))
            hits += np.bincount(cell, minlength=SIDE * SIDE) if any_lost else n
            sums += np.bincount(cell, weights=x, minlength=SIDE * SIDE)
            lo = hi
    found = np.flatnonzero(hits)
    i, j = (pa.nulls(len(found), pa.int64()) if k.as_py() is None else pa.array(k.as_py() * SIDE + at) for k, at in zip(key, (found // SIDE, found % SIDE)))
    out = pa.table({"i": i, "j": j, "v": pa.array(sums[found], mask=good[found] == 0 if some else None)})
    return pa.Table.from_batches(out.to_batches(max_chunksize=1 << 16), out.schema)


def apply_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """m x for a vector (i, v); rows without entries are missing."""
    return m.join(x.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def whole(m: DataFrame) -> DataFrame:
    """Sum, mean, extremes, trace, squared norm and product of signs of all entries; the sum of nothing is 0."""
    return m.agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.avg("v").alias("mean"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("trace"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("squared_norm"),
    )


def arg_extremes(m: DataFrame) -> DataFrame:
    """Cells of the smallest and the largest entry; of equals the first in row order."""
    low, high = (F.min(F.struct(s * F.col("v"), F.col("i"), F.col("j"))) for s in (1.0, -1.0))
    return m.agg(low.alias("a"), high.alias("b")).select(F.col("a.i").alias("min_i"), F.col("a.j").alias("min_j"), F.col("b.i").alias("max_i"), F.col("b.j").alias("max_j"))


def by_line(m: DataFrame, axis: str) -> DataFrame:
    """Row-wise (axis i) or column-wise (axis j) reductions."""
    v = F.col("v")
    return m.groupBy(axis).agg(
        F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("v").alias("n"),
        F.sum(v * v).alias("squared_norm"), F.sqrt(F.sum(v * v)).alias("norm"), F.product("v").alias("product"), F.bool_and(v != 0).alias("all_set"), F.bool_or(v != 0).alias("any_set"),
    )


def truths(m: DataFrame, test: Column) -> DataFrame:
    """all, any, count of a test, and whether every value is finite or one is not a number."""
    v = F.col("v")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return m.agg(F.bool_and(test).alias("all_true"), F.bool_or(test).alias("any_true"), F.count_if(test).alias("n_true"), F.bool_or(F.isnan(v)).alias("has_nan"), F.bool_and(finite).alias("all_finite"))


def inverse2(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """Inverse of [[a, b], [c, d]]; NULL where singular."""
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return [d / det, -b / det, -c / det, a / det]


def normal_equations(rows: DataFrame, x: list[str], y: str, *by: str) -> DataFrame:
    """Sums of x_p x_q (a_p_q, p <= q) and x_p y (l_p) per group; one pass, partial sums first."""
    pairs = [F.sum(F.col(x[p]) * F.col(x[q])).alias(f"a_{p}_{q}") for p, q in combinations_with_replacement(range(len(x)), 2)]
    return rows.groupBy(*by).agg(*pairs, *[F.sum(F.col(c) * F.col(y)).alias(f"l_{p}") for p, c in enumerate(x)], F.count("*").alias("n"))


def _solve(k: int, by: tuple[str, ...], ridge: str | None):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"a_{min(p, q)}_{max(p, q)}"] for q in range(k)] for p in range(k)], float)
                a = a + np.eye(k) * (r[ridge] if ridge else 0)
                singular = not np.isfinite(a).all() or np.linalg.matrix_rank(a) < k
                out.append([*[r[c] for c in by], None if singular else np.linalg.solve(a, [r[f"l_{p}"] for p in range(k)]).tolist()])
            yield pd.DataFrame(out, columns=[*by, "beta"])

    return run


def solve(sums: DataFrame, k: int, *by: str, ridge: str | None = None) -> DataFrame:
    """beta of each group's k x k system, plus ``ridge`` (a column) on the diagonal; NULL if singular."""
    kinds = ", ".join([*[f"{c} {dict(sums.dtypes)[c]}" for c in by], "beta array<double>"])
    return sums.mapInPandas(_solve(k, by, ridge), kinds)


def ols(rows: DataFrame, x: list[str], y: str, *by: str) -> DataFrame:
    return solve(normal_equations(rows, x, y, *by), len(x), *by)


def ridge(rows: DataFrame, x: list[str], y: str, start: list[float], *by: str, alpha: float = 0.0) -> DataFrame:
    """Ridge fit; with alpha 0 it is k * mean((A x0 - y)^2) / (x0 . x0) for the given x0 = ``start``."""
    norm = sum(s * s for s in start)
    if alpha == 0 and norm == 0:
        raise ValueError("the start vector must not be zero")
    sums = normal_equations(rows, x, y, *by)
    if alpha:
        return solve(sums.withColumn("alpha", F.lit(float(alpha))), len(x), *by, ridge="alpha").withColumn("alpha", F.lit(float(alpha)))
    fit = sum((F.col(c) * s for c, s in zip(x[1:], start[1:])), F.col(x[0]) * start[0]) - F.col(y)
    found = rows.groupBy(*by).agg((F.avg(fit * fit) * (len(x) / norm)).alias("alpha"))
    both = sums.join(found, list(by)) if by else sums.crossJoin(F.broadcast(found))
    beta = solve(both, len(x), *by, ridge="alpha")
    return beta.join(found, list(by)) if by else beta.crossJoin(F.broadcast(found))


def _eigen(k: int, by: tuple[str, ...]):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"a_{min(p, q)}_{max(p, q)}"] for q in range(k)] for p in range(k)], float)
                values, vectors = np.linalg.eigh(a)
                values, vectors = values[::-1], vectors[:, ::-1]
                vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
                out += [[*[r[c] for c in by], n, values[n], float(np.sqrt(max(values[n], 0))), vectors[:, n].tolist()] for n in range(k)]
            yield pd.DataFrame(out, columns=[*by, "rank", "eigenvalue", "singular_value", "vector"])

    return run


def gram_eigen(rows: DataFrame, x: list[str], *by: str) -> DataFrame:
    """Eigenpairs of A'A per group, largest first; each vector's largest entry is positive.
    Their roots are the singular values of A."""
    sums = normal_equations(rows, x, x[0], *by)
    kinds = ", ".join([*[f"{c} {dict(sums.dtypes)[c]}" for c in by], "rank long, eigenvalue double, singular_value double, vector array<double>"])
    return sums.mapInPandas(_eigen(len(x), by), kinds)


def thin_r(rows: DataFrame, x: list[str]) -> DataFrame:
    """R of a thin QR of all rows (sign: positive diagonal), by QR of each task's rows and then, 64
    at a time, of the stacked k x k results, until one is left."""
    k = len(x)

    def local(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, k))
        for pdf in pdfs:
            r = np.linalg.qr(np.vstack((r, pdf[[f"c{p}" for p in range(k)]].to_numpy(float))), mode="r")
        if len(r):
            r = np.vstack((r, np.zeros((k - len(r), k))))
            r = r * np.where(np.diag(r) < 0, -1, 1)[:, None]
            yield pd.DataFrame(r, columns=[f"c{p}" for p in range(k)])

    kinds = ", ".join(f"c{p} double" for p in range(k))
    parts = rows.select(*[F.col(c).cast("double").alias(f"c{p}") for p, c in enumerate(x)])
    out = save(parts.mapInPandas(local, kinds), "thin-r")
    while (n := out.count()) > k:
        out = save(out.repartition(max(1, n // (64 * k))).mapInPandas(local, kinds), "thin-r")
    return out


def _system(m: DataFrame, b: DataFrame) -> DataFrame:
    """i, right side (0 where b has no row) and diagonal of every row of m or b; ValueError names a row without a diagonal."""
    d = m.filter("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    rows = m.select("i").union(b.select("i")).distinct()
    state = rows.join(b.groupBy("i").agg(F.sum("v").alias("b")), "i", "left").join(d, "i", "left")
    state = save(state.select("i", F.coalesce("b", F.lit(0.0)).alias("b"), "d"), "system")
    if bad := state.filter("d is null or d = 0").select("i").orderBy("i").first():
        raise ValueError(f"row {bad[0]} of the matrix has no diagonal entry")
    return state


def _sums(state: DataFrame, *pairs: str) -> list[float]:
    """Sum of the product of each pair of columns, as "p q"."""
    return [x or 0.0 for x in state.agg(*[F.sum(F.col(p.split()[0]) * F.col(p.split()[1])) for p in pairs]).first()]


def _applied(m: DataFrame, state: DataFrame, column: str, name: str, key: str = "i") -> DataFrame:
    """``state`` with column ``name``: m times ``column``; 0 where m has no entries."""
    q = apply_vector(m, state.select(F.col(key).alias("i"), F.col(column).alias("v"))).select(F.col("i").alias(key), F.col("v").alias(name))
    return save(state.join(q, key, "left").withColumn(name, F.coalesce(name, F.lit(0.0))), "krylov")


def conjugate_gradient(m: DataFrame, b: DataFrame, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """Solution (i, v) of a symmetric positive definite m x = b, with the diagonal as preconditioner.

    The vectors stay distributed; a few scalars a step come to the driver. Each step is written to the
    shared folder, which also cuts the lineage. Rows that b lacks count as 0; a row without a diagonal entry
    raises ValueError. ``residual`` is |b - m x| / |b| as the recurrence has it, the same in all rows: where
    it is above the tolerance, the steps didn't suffice. An empty system gives no rows.
    """
    state = _system(m, b).select("i", F.lit(0.0).alias("x"), F.col("b").alias("r"), "d", (F.col("b") / F.col("d")).alias("z"), (F.col("b") / F.col("d")).alias("p"))
    state = save(state, "krylov")
    rz, size = _sums(state, "r z", "r r")
    first, rr = rz, size
    for _ in range(steps):
        if not rz or rz <= tolerance * tolerance * first:
            break
        with_q = _applied(m, state, "p", "q")
        curve = _sums(with_q, "p q")[0]
        if curve <= 0:
            break
        alpha = rz / curve
        moved = with_q.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "d", "p").withColumn("z", F.col("r") / F.col("d"))
        new, rr = _sums(moved, "r z", "r r")
        beta, rz = new / rz, new
        state = save(moved.withColumn("p", F.col("z") + beta * F.col("p")), "krylov")
    return state.select("i", F.col("x").alias("v"), F.lit(float(np.sqrt(rr / size)) if size else 0.0).alias("residual"))


def bicgstab(m: DataFrame, b: DataFrame, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """As :func:`conjugate_gradient`, for any square matrix with a diagonal.

    Where the recurrence breaks down, it begins anew from the residual r, with a shadow that is orthogonal neither to r nor to the
    direction's image v: r / abs(r) plus or minus v / abs(v). If v is 0, m is singular there, and the steps end.
    """
    state = save(_system(m, b).select("i", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("shadow"), F.lit(0.0).alias("p"), F.lit(0.0).alias("v"), "d"), "krylov")
    (size,) = _sums(state, "r r")
    rr, rho, alpha, omega, fresh = size, size, 1.0, 1.0, True
    for _ in range(steps):
        if rr <= tolerance * tolerance * size:
            break
        if fresh:
            state = state.withColumn("p", F.col("r")).withColumn("shadow", F.col("r"))
        state = _applied(m, state.withColumn("y", F.col("p") / F.col("d")).drop("v"), "y", "v")
        vv, ss, rv, sv = _sums(state, "v v", "shadow shadow", "r v", "shadow v")
        if fresh and vv and abs(sv) <= 1e-8 * np.sqrt(ss * vv):
            state = save(state.withColumn("shadow", F.col("r") / float(np.sqrt(rr)) + F.col("v") / float(np.copysign(np.sqrt(vv), rv))), "krylov")
            sv, ss = _sums(state, "shadow v", "shadow shadow")
        if fresh:
            (rho,) = _sums(state, "shadow r")
        if abs(sv) <= 1e-14 * np.sqrt(ss * vv):
            if fresh:
                break  # v is 0
            fresh = True
            continue
        alpha = rho / sv
        state = _applied(m, state.withColumn("s", F.col("r") - alpha * F.col("v")).withColumn("z", F.col("s") / F.col("d")), "z", "t")
        tt, ts = _sums(state, "t t", "t s")
        omega = ts / tt if tt else 0.0
        state = save(state.select("i", (F.col("x") + alpha * F.col("y") + omega * F.col("z")).alias("x"), (F.col("s") - omega * F.col("t")).alias("r"), "shadow", "p", "v", "d"), "krylov")
        new, rr, ss = _sums(state, "shadow r", "r r", "shadow shadow")
        fresh = not omega or abs(new) <= 1e-14 * np.sqrt(ss * rr)
        if not fresh:
            beta, rho = (new / rho) * (alpha / omega), new
            state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v")))
    return state.select("i", F.col("x").alias("v"), F.lit(float(np.sqrt(rr / size)) if size else 0.0).alias("residual"))


def least_squares_cg(m: DataFrame, b: DataFrame, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """Least-squares solution (j, v) of m x = b for any shape, by conjugate gradients on the normal equations,
    which are never formed. ``residual`` is |m' (b - m x)| / |m' b|."""
    back = transpose(m)
    rows = save(m.select("i").union(b.select("i")).distinct().join(b.groupBy("i").agg(F.sum("v").alias("r")), "i", "left").select("i", F.coalesce("r", F.lit(0.0)).alias("r")), "krylov")
    cols = save(m.select("j").distinct(), "krylov")

    def gradient(r: DataFrame) -> DataFrame:
        return apply_vector(back, r.select("i", F.col("r").alias("v"))).select(F.col("i").alias("j"), F.col("v").alias("s"))

    state = cols.join(gradient(rows), "j", "left").select("j", F.lit(0.0).alias("x"), F.coalesce("s", F.lit(0.0)).alias("s")).withColumn("p", F.col("s"))
    state = save(state, "krylov")
    first = gamma = _sums(state, "s s")[0]
    for _ in range(steps):
        if not gamma or gamma <= tolerance * tolerance * first:
            break
        q = apply_vector(m, state.select(F.col("j").alias("i"), F.col("p").alias("v"))).withColumnRenamed("v", "q")
        rows = save(rows.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "krylov")
        alpha = gamma / _sums(rows, "q q")[0]
        rows = rows.select("i", (F.col("r") - alpha * F.col("q")).alias("r"))
        moved = state.select("j", (F.col("x") + alpha * F.col("p")).alias("x"), "p").join(gradient(rows), "j", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        moved = save(moved, "krylov")
        new = _sums(moved, "s s")[0]
        state = moved.withColumn("p", F.col("s") + (new / gamma) * F.col("p"))
        gamma = new
    return state.select("j", F.col("x").alias("v"), F.lit(float(np.sqrt(gamma / first)) if first else 0.0).alias("residual"))


def triangular_solve(m: DataFrame, b: DataFrame, lower: bool = True, steps: int = 10_000) -> DataFrame:
    """Solution (i, v) of m x = b by the lower (or upper) triangle of m; entries beyond it are ignored.

    Every pass solves all rows whose predecessors are known, so as many passes run as the longest chain of
    rows has links (at most ``steps``; ValueError beyond). A row without a diagonal entry raises ValueError.
    """
    off = m.filter("j < i" if lower else "j > i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    state = _system(m, b)
    left = save(off, "triangle")
    known = save(state.join(left.select("i").distinct(), "i", "left_anti").select("i", (F.col("b") / F.col("d")).alias("v")), "solved")
    for _ in range(steps):
        open_rows = state.join(known.select("i"), "i", "left_anti")
        if open_rows.isEmpty():
            return known
        terms = left.join(open_rows.select("i"), "i").join(known.select(F.col("i").alias("j"), F.col("v").alias("x")), "j", "left")
        ready = terms.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("q"), F.bool_and(F.col("x").isNotNull()).alias("ok")).filter("ok")
        known = save(known.union(open_rows.join(ready, "i").select("i", ((F.col("b") - F.col("q")) / F.col("d")).alias("v"))), "solved")
    raise ValueError("the chain of rows is longer than the steps")


def inverse(m: DataFrame, *by: str) -> DataFrame:
    """Inverse (by, i, j, v) of each group's small square matrix; groups that are singular, not
    square or not finite have one row of NULLs. Missing entries are 0, repeated ones add up."""

    cells = m.select(*by, F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).alias("c"))
    rows = cells.groupBy(*by).agg(F.collect_list("c").alias("c")).select(*by, *[F.col(f"c.{n}").alias(f"_{n}") for n in "ijv"])  # a small matrix each
    kinds = {c: dict(m.dtypes)[c] for c in by} | {"i": "long", "j": "long", "v": "double"}
    return rows.mapInArrow(_inverses(list(by)), ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def _inverses(by: list[str]):
    """Groups (by, _i, _j, _v) of a batch; those of equal shape are inverted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, v = (batch.column(f"_{n}") for n in "ijv")
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(i).to_numpy(zero_copy_only=False))
            flat = v.flatten()
            i, j, v, none = i.flatten(), j.flatten(), flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
            lost = np.zeros(batch.num_rows, bool)
            for n in (i, j):
                lost[of[n.is_null().to_numpy(zero_copy_only=False)]] = True
            row, rows, names_i = _ranks(of, pc.fill_null(i, 0).to_numpy(), batch.num_rows)
            col, cols, names_j = _ranks(of, pc.fill_null(j, 0).to_numpy(), batch.num_rows)
            lost |= rows != cols
            lost[of[none]] = True
            parts = []
            for n in np.unique(rows[~lost]):
                group = np.flatnonzero(~lost & (rows == n))
                at = np.full(batch.num_rows, -1)
                at[group] = np.arange(len(group))
                mine = at[of] >= 0
                a = np.zeros((len(group), n, n))
                np.add.at(a, (at[of[mine]], row[mine], col[mine]), v[mine])
                ok = np.isfinite(a).all(axis=(1, 2))
                ok[ok] = np.linalg.matrix_rank(a[ok]) == n
                lost[group[~ok]] = True
                group, a = group[ok], np.linalg.inv(a[ok])
                ri, cj = (names[np.add.outer(begin[group], np.arange(n))] for begin, names in (names_i, names_j))
                parts.append((np.repeat(group, n * n), np.repeat(cj, n, axis=1).ravel(), np.tile(ri, (1, n)).ravel(), a.ravel()))
            for group, x, y, values in parts:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(group)) for c in by], pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(values, pa.float64())], [*by, "i", "j", "v"])
            empty = np.flatnonzero(lost)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(empty)) for c in by], *[pa.nulls(len(empty), t) for t in (pa.int64(), pa.int64(), pa.float64())]], [*by, "i", "j", "v"])

    return run


def _ranks(of: np.ndarray, n: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Rank of each number among the different ones of its group, how many a group has, and where its begin in the sorted list."""
    order = np.lexsort((n, of))
    new = np.ones(len(n), bool)
    new[1:] = (np.diff(of[order]) != 0) | (np.diff(n[order]) != 0)
    count = np.bincount(of[order][new], minlength=groups)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    rank = np.empty(len(n), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank - begin[of], count, (begin, n[order][new])


# generators, slices and permutations


def constant(spark, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    """A rows x cols matrix of one value, made where it is read."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), F.lit(float(value)).alias("v"))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def linspaced(spark, n: int, low: float, high: float) -> DataFrame:
    """n values from low to high, both included (high alone for one)."""
    step = F.lit(1.0) if n == 1 else F.col("id") / (n - 1)
    return spark.range(n).select(F.col("id").alias("i"), (low + (high - low) * step).alias("v"))


def uniform(key: Column, seed: int = 0) -> Column:
    """A repeatable pseudo-random number in [0, 1) for each key, 53 bits; NULL keys have one too."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") * 2.0**-53


def random_index(key: Column, n: int, seed: int = 0) -> Column:
    return F.floor(uniform(key, seed) * n)


def block(m: DataFrame, i0: int, j0: int, rows: int, cols: int) -> DataFrame:
    """The block at (i0, j0), moved to the origin."""
    inside = F.col("i").between(i0, i0 + rows - 1) & F.col("j").between(j0, j0 + cols - 1)
    return m.filter(inside).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v")


def reverse(m: DataFrame, rows: int, cols: int) -> DataFrame:
    return m.select((rows - 1 - F.col("i")).alias("i"), (cols - 1 - F.col("j")).alias("j"), "v")


def replicate(m: DataFrame, rows: int, cols: int, down: int, right: int) -> DataFrame:
    """The rows x cols matrix repeated ``down`` times below and ``right`` times beside itself."""
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = m.withColumn("_a", steps(down)).withColumn("_b", steps(right))
    return at.select((F.col("i") + F.col("_a") * rows).alias("i"), (F.col("j") + F.col("_b") * cols).alias("j"), "v")


def diagonal(m: DataFrame) -> DataFrame:
    return m.filter("i = j").select("i", "v")


def permute_rows(m: DataFrame, permutation: DataFrame) -> DataFrame:
    """Row ``source`` of m becomes row ``target``; rows that the permutation lacks are left out."""
    return m.join(permutation.select(F.col("source").alias("i"), "target"), "i").select(F.col("target").alias("i"), "j", "v")


def absolute_orientation(pairs: DataFrame, *by: str) -> DataFrame:
    """Similarity transform that takes points (x, y, z) to (u, v, w) with the least squared error, per group.

    Sums of 9 products, 6 coordinates and 3 squares are grouped; the unit quaternion q0..q3 is the dominant eigenvector of a
    4 x 4 matrix of them. Columns: q0..q3 (q0 >= 0), scale, t0..t2: target = scale * R(q) * source + t.
    Groups with fewer than two different points have NULLs.
    """
    a, b = ("x", "y", "z"), ("u", "v", "w")
    ok = pairs.dropna(subset=[*a, *b])
    sums = ok.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in (*a, *b)], *[F.sum(F.col(p) * F.col(q)).alias(f"m_{p}{q}") for p in a for q in b], sum((F.sum(F.col(p) * F.col(p)) for p in a[1:]), F.sum(F.col("x") * F.col("x"))).alias("sq")
    )

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.to_dict("records"):
                n = r["n"]
                ca, cb = np.array([r[f"s_{c}"] for c in a]) / n, np.array([r[f"s_{c}"] for c in b]) / n
                m = np.array([[r[f"m_{p}{q}"] for q in b] for p in a]) - n * np.outer(ca, cb)
                spread = r["sq"] - n * ca @ ca
                skew = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
                k = np.block([[np.array([[np.trace(m)]]), skew[None]], [skew[:, None], m + m.T - np.trace(m) * np.eye(3)]])
                values, vectors = np.linalg.eigh(k)
                if spread <= 1e-12 * max(1.0, r["sq"]):
                    out.append([*[r[c] for c in by], *[None] * 8])
                    continue
                q = vectors[:, -1] * (-1 if vectors[0, -1] < 0 else 1)
                scale = values[-1] / spread
                w, v = q[0], q[1:]
                turned = ca + 2 * np.cross(v, np.cross(v, ca) + w * ca)
                out.append([*[r[c] for c in by], *q.tolist(), float(scale), *(cb - scale * turned).tolist()])
            yield pd.DataFrame(out, columns=[*by, "q0", "q1", "q2", "q3", "scale", "t0", "t1", "t2"])

    kinds = ", ".join([*[f"{c} {dict(sums.dtypes)[c]}" for c in by], *[f"{c} double" for c in ("q0", "q1", "q2", "q3", "scale", "t0", "t1", "t2")]])
    return sums.mapInPandas(run, kinds)


def box_merge(boxes: DataFrame, *by: str) -> DataFrame:
    """Smallest box around all boxes and the box that all share (empty: min above max)."""
    return boxes.groupBy(*by).agg(*[f(c).alias(n) for f, c, n in (
        (F.min, "x0", "x0"), (F.min, "y0", "y0"), (F.max, "x1", "x1"), (F.max, "y1", "y1"),
        (F.max, "x0", "in_x0"), (F.max, "y0", "in_y0"), (F.min, "x1", "in_x1"), (F.min, "y1", "in_y1"))])
