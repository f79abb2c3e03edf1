"""Tree filter of a whole raster: weighted means over the minimum spanning tree of its guide, in pieces of bounded size.

A pixel's new value is the mean over all pixels j of its part of the raster, weighted by exp(-length / sigma) of the tree's path to j,
where the tree is the minimum spanning tree of the 4-neighbour grid with the guide's differences as lengths. Equal lengths go
in order of their ends, which makes the tree unique, so that the result doesn't depend on the tiling.

Both steps work on tiles, then on groups of ``MERGE`` x ``MERGE`` of what is left of them, up to the whole raster, and come back down.
What is left of a region is a skeleton no larger than its rim: leaves that don't touch the rim are raked off and chains are
compressed to one edge, in some log(n) rounds that numpy takes for all nodes at once.

* Tree: an edge of a raked leaf is in the tree for certain, and so are all edges of a chain but its longest. The skeletons of several
  regions and the edges between them give the next tree, until no rim is left.
* Sums: a raked leaf adds its sum, times its weight, to its neighbour; a compressed chain keeps its weight and what its inside
  gives to either end. On the way down the rounds run backwards: every edge learns the sum of what lies beyond it, every node its own.

Pixels that are NULL in either raster are no nodes and get no value; parts that they cut off are trees of their own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import save
from .raster import deal, unique

TILE = 512
MERGE = 4
WIDE = 1 << 31  # columns at most
PIXEL, EDGE, STUB, NODE, SURE = range(5)
ROW = "ry long, rx long, kind int, u long, v long, a long, b long, w double, p double, q double, r double, s double, t double"
NAMES = [c.split()[0] for c in ROW.split(", ")]


class Rounds:
    """Rakes (leaf, neighbour, edge) and compressions (node, two ends, two edges, new edge), round by round, of a forest."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, keep: np.ndarray):
        self.u, self.v, self.steps = u.astype(np.int64), v.astype(np.int64), []
        alive, seed = np.arange(len(u)), 0
        gone = np.zeros(n, bool)
        while True:
            a, b = self.u[alive], self.v[alive]
            degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            leaf = (degree == 1) & ~keep
            first = leaf[a] & ~(leaf[b] & (b < a))
            second = leaf[b] & ~first
            some = first | second
            raked = np.where(first, a, b)[some], np.where(first, b, a)[some], alive[some]
            alive = alive[~some]
            a, b = self.u[alive], self.v[alive]
            inner = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n) == 2) & ~keep
            ends, edges = np.concatenate([a, b]), np.concatenate([alive, alive])
            at = np.flatnonzero(inner[ends])
            at = at[np.argsort(ends[at], kind="stable")]
            x, e1, e2 = ends[at[0::2]], edges[at[0::2]], edges[at[1::2]]
            o1, o2 = self.u[e1] + self.v[e1] - x, self.u[e2] + self.v[e2] - x
            seed += 1
            rank = lambda k: (k.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)  # noqa: E731, B023  # another order each round
            take = (~inner[o1] | (rank(x) > rank(o1))) & (~inner[o2] | (rank(x) > rank(o2)))
            x, o1, o2, e1, e2 = (k[take] for k in (x, o1, o2, e1, e2))
            new = np.arange(len(self.u), len(self.u) + len(x))
            if not len(raked[0]) and not len(x):
                break
            self.steps.append((raked, (x, o1, o2, e1, e2, new)))
            gone[raked[0]] = gone[x] = True
            self.u, self.v = np.concatenate([self.u, o1]), np.concatenate([self.v, o2])
            dead = np.zeros(len(self.u), bool)
            dead[e1] = dead[e2] = True
            alive = np.concatenate([alive[~dead[alive]], new])
        self.alive, self.left = alive, ~gone


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest; edges come in ascending order."""
    name, chosen, alive = np.arange(n), np.zeros(len(u), bool), np.arange(len(u))
    while len(alive):
        a, b = name[u[alive]], name[v[alive]]
        alive, a, b = (k[a != b] for k in (alive, a, b))
        if not len(alive):
            break
        best = np.full(n, len(u))
        np.minimum.at(best, a, alive)
        np.minimum.at(best, b, alive)
        own = np.flatnonzero(best < len(u))
        chosen[best[own]] = True
        to = np.arange(n)
        to[own] = name[u[best[own]]] + name[v[best[own]]] - own
        back = own[(to[to[own]] == own) & (own < to[own])]
        to[back] = back
        while (to[to] != to).any():
            to = to[to]
        name = to[name]
    return np.flatnonzero(chosen)


class Sums:
    """Sums over a forest with decaying edges; masses and sums have two columns."""

    def __init__(self, rounds: Rounds, mass: np.ndarray, decay: np.ndarray, to_u: np.ndarray, to_v: np.ndarray):
        size, start = len(rounds.u), len(decay)
        self.r, self.mass, self.decay = rounds, mass.copy(), np.zeros((size, 1))
        self.gives = np.zeros((2, size, 2))  # of an edge's inside, to its u and to its v
        self.decay[:start, 0], self.gives[0, :start], self.gives[1, :start] = decay, to_u, to_v
        for (leaf, near, edge), (x, o1, o2, e1, e2, new) in rounds.steps:
            np.add.at(self.mass, near, self.decay[edge] * self.mass[leaf] + self.given(edge, near))
            self.decay[new] = self.decay[e1] * self.decay[e2]
            self.gives[0, new] = self.given(e1, o1) + self.decay[e1] * (self.mass[x] + self.given(e2, x))
            self.gives[1, new] = self.given(e2, o2) + self.decay[e2] * (self.mass[x] + self.given(e1, x))

    def given(self, edge: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.where((self.r.u[edge] == node)[:, None], self.gives[0, edge], self.gives[1, edge])

    def down(self, total: np.ndarray, beyond: np.ndarray) -> None:
        """Fill ``total`` (of nodes) and ``beyond`` (of an edge's u and v: the sum there of all but what the edge leads to);
        those of the nodes and edges that are left are given."""
        u = self.r.u

        def put(edge: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
            beyond[np.where(u[edge] == node, 0, 1), edge] = value

        for (leaf, near, edge), (x, o1, o2, e1, e2, new) in reversed(self.r.steps):
            far1, far2, in1, in2 = beyond[0, new], beyond[1, new], self.given(e1, x), self.given(e2, x)
            put(e1, o1, far1)
            put(e2, o2, far2)
            put(e1, x, self.mass[x] + in2 + self.decay[e2] * far2)
            put(e2, x, self.mass[x] + in1 + self.decay[e1] * far1)
            total[x] = self.mass[x] + in1 + in2 + self.decay[e1] * far1 + self.decay[e2] * far2
            rest = total[near] - self.decay[edge] * self.mass[leaf] - self.given(edge, near)
            put(edge, near, rest)
            put(edge, leaf, self.mass[leaf])
            total[leaf] = self.mass[leaf] + self.given(edge, leaf) + self.decay[edge] * rest


def _rows(**columns) -> pd.DataFrame:
    n = max((len(c) for c in columns.values() if not np.isscalar(c)), default=0)
    blank = {c: 0 if c in ("ry", "rx", "kind", "u", "v", "a", "b") else 0.0 for c in NAMES} | columns
    return pd.DataFrame({c: np.broadcast_to(v, n) if np.isscalar(v) else v for c, v in blank.items()})


def _numbered(*ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids and, for each array, the places of its ids among them."""
    every, at = np.unique(np.concatenate(ids), return_inverse=True)
    return every, np.split(at, np.cumsum([len(k) for k in ids])[:-1])


def _cell(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return ids // WIDE // size, ids % WIDE // size


def _inside(ids: np.ndarray, key: tuple, size: int) -> np.ndarray:
    y, x = _cell(ids, size)
    return (y == key[0]) & (x == key[1])


def _tree_of_tile(tile: int):
    """The tile's edges from its pixels and a rim of one: sure ones, the skeleton's, and those that leave it."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        ids, c = pdf["u"].to_numpy(), pdf["w"].to_numpy()
        parts = []
        for step, ok in ((1, ids % WIDE < WIDE - 1), (WIDE, ids >= 0)):
            to = np.searchsorted(ids, ids + step).clip(max=len(ids) - 1)
            found = np.flatnonzero((ids[to] == ids + step) & ok)
            parts.append((ids[found], ids[to[found]], np.abs(c[found] - c[to[found]])))
        a, b, w = (np.concatenate(k) for k in zip(*parts))
        return _reduced(key, tile, a, b, a, b, w, out=(a, b, a, b, w))

    return run


def _tree_of_region(size: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        edge, stub = pdf[pdf["kind"] == EDGE], pdf[pdf["kind"] == STUB]
        u, v, a, b, w = (edge[c].to_numpy() for c in ("u", "v", "a", "b", "w"))
        return _reduced(key, size, u, v, a, b, w, out=tuple(stub[c].to_numpy() for c in ("u", "v", "a", "b", "w")))

    return run


def _reduced(key, size: int, u, v, a, b, w, out) -> pd.DataFrame:
    """Skeleton of a region: edges u-v inside, each standing for the pixels' edge a-b of length w; ``out`` may have edges
    inside it too, seen from either end, and those that leave."""
    x, y, oa, ob, ow = out
    near, far = _inside(x, key, size), _inside(y, key, size)
    new = near & far & (x < y)
    if len(u) == len(x) and u is a:  # a tile: its own edges are among them
        u = v = a = b = np.zeros(0, np.int64)
        w = np.zeros(0)
    u, v, a, b, w = (np.concatenate([p, q[new]]) for p, q in ((u, x), (v, y), (a, oa), (b, ob), (w, ow)))
    leaves = near ^ far
    stub = [k[leaves] for k in (np.where(near, x, y), np.where(near, y, x), oa, ob, ow)]
    order = np.lexsort((b, a, w))
    u, v, a, b, w = (k[order] for k in (u, v, a, b, w))
    ids, (iu, iv, rim) = _numbered(u, v, stub[0])
    tree = forest(len(ids), iu, iv)
    keep = np.zeros(len(ids), bool)
    keep[rim] = True
    rounds = Rounds(len(ids), iu[tree], iv[tree], keep)
    longest, sure = np.concatenate([tree, np.zeros(len(rounds.u) - len(tree), np.int64)]), []
    for (_, _, edge), (_, _, _, e1, e2, new) in rounds.steps:
        sure.append(longest[edge])
        sure.append(np.minimum(longest[e1], longest[e2]))  # edges stand in ascending order
        longest[new] = np.maximum(longest[e1], longest[e2])
    sure, open_ = np.concatenate([*sure, np.zeros(0, np.int64)]).astype(np.int64), longest[rounds.alive]
    ry, rx = key
    return pd.concat(
        [
            _rows(ry=ry, rx=rx, kind=SURE, a=a[sure], b=b[sure], w=w[sure]),
            _rows(ry=ry, rx=rx, kind=EDGE, u=ids[rounds.u[rounds.alive]], v=ids[rounds.v[rounds.alive]], a=a[open_], b=b[open_], w=w[open_]),
            _rows(ry=ry, rx=rx, kind=STUB, u=stub[0], v=stub[1], a=stub[2], b=stub[3], w=stub[4]),
        ]
    )


def _regions(df: DataFrame, size: int) -> DataFrame:
    """Rows moved to the next coarser regions."""
    return df.withColumn("ry", F.floor(F.col("ry") / size)).withColumn("rx", F.floor(F.col("rx") / size))


def spanning_tree(guide: DataFrame, tile: int = TILE, merge: int = MERGE) -> DataFrame:
    """Edges (a, b, w) of the minimum spanning forest of guide (y, x, v); a pixel's id is y * 2**31 + x."""
    px = deal(guide.filter("v is not null").select("y", "x", F.col("v").alias("w")), tile, 1).select(F.col("ty").alias("ry"), F.col("tx").alias("rx"), (F.col("y") * WIDE + F.col("x")).alias("u"), "w")
    level = save(px.groupBy("ry", "rx").applyInPandas(_tree_of_tile(tile), ROW), "tree-tiles")
    parts, size = [level], tile
    while not parts[-1].filter(F.col("kind") == STUB).isEmpty():
        size *= merge
        up = _regions(parts[-1].filter(F.col("kind") != SURE), merge)
        parts.append(save(up.groupBy("ry", "rx").applyInPandas(_tree_of_region(size), ROW), "tree-regions"))
    return reduce(DataFrame.unionByName, [p.filter(F.col("kind") == SURE).select("a", "b", "w") for p in parts])


class Region:
    """A region's forest: pixels or nodes with masses, edges with what their insides give, stubs that leave.

    Rows are put in order first: a shuffle brings them in another order each time, and the way down must find the ends of
    compressed edges as the way up left them."""

    def __init__(self, key, size: int, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["kind", "u", "v"])
        node, edge, stub = (pdf[pdf["kind"] == k] for k in (NODE, EDGE, STUB))
        u, v, w = (np.concatenate([edge[c], stub[c][:0]]) for c in ("u", "v", "w"))
        x, y, d = (stub[c].to_numpy() for c in ("u", "v", "w"))
        within = _inside(y, key, size)
        once = within & (x < y)
        to = [np.concatenate([edge[[p, q]].to_numpy(float).reshape(-1, 2), np.zeros((once.sum(), 2))]) for p, q in (("p", "q"), ("r", "s"))]
        self.own, self.decay = len(u), np.concatenate([w, d[once]])
        self.ids, (i, iu, iv, rim) = _numbered(node["u"].to_numpy(np.int64), np.concatenate([u, x[once]]).astype(np.int64), np.concatenate([v, y[once]]).astype(np.int64), x[~within])
        mass = np.zeros((len(self.ids), 2))
        np.add.at(mass, i, node[["p", "q"]].to_numpy(float).reshape(-1, 2))
        self.keep = np.zeros(len(self.ids), bool)
        self.keep[rim] = True
        self.u, self.v, self.child = iu, iv, (node["u"].to_numpy(np.int64), node["a"].to_numpy(np.int64), node["b"].to_numpy(np.int64))
        self.edge_child = edge["a"].to_numpy(np.int64), edge["b"].to_numpy(np.int64)
        self.stubs = stub[~within]
        self.rounds = Rounds(len(self.ids), iu, iv, self.keep)
        self.sums = Sums(self.rounds, mass, self.decay, *to)
        self.key = key

    def skeleton(self) -> pd.DataFrame:
        r, s, (ry, rx) = self.rounds, self.sums, self.key
        joined = self.keep.copy()  # nodes of trees that leave the region; the others are done
        joined[r.u[r.alive]] = joined[r.v[r.alive]] = True
        n, e = np.flatnonzero(r.left & joined), r.alive
        return pd.concat(
            [
                _rows(ry=ry, rx=rx, kind=NODE, u=self.ids[n], a=ry, b=rx, p=s.mass[n, 0], q=s.mass[n, 1]),
                _rows(ry=ry, rx=rx, kind=EDGE, u=self.ids[r.u[e]], v=self.ids[r.v[e]], a=ry, b=rx, w=s.decay[e, 0], p=s.gives[0, e, 0], q=s.gives[0, e, 1], r=s.gives[1, e, 0], s=s.gives[1, e, 1]),
                self.stubs.assign(ry=ry, rx=rx)[NAMES],
            ]
        )

    def solve(self, known: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        """Totals of all nodes, and sums beyond the ends of all edges; ``known`` has those of the skeleton."""
        r, s = self.rounds, self.sums
        total, beyond = np.where(r.left[:, None], s.mass, 0.0), np.zeros((2, len(r.u), 2))
        if known is not None and len(known):
            node, edge = known[known["kind"] == NODE], known[known["kind"] == EDGE]
            total[np.searchsorted(self.ids, node["u"])] = node[["p", "q"]]
            e = r.alive
            at = {(p, q): k for k, (p, q) in enumerate(zip(edge["u"], edge["v"]))}
            place = [at[p, q] for p, q in zip(self.ids[r.u[e]], self.ids[r.v[e]])]
            values = edge[["p", "q", "r", "s"]].to_numpy(float).reshape(-1, 4)[place]
            beyond[0, e], beyond[1, e] = values[:, :2], values[:, 2:]
        s.down(total, beyond)
        return total, beyond

    def answers(self, known: pd.DataFrame | None) -> pd.DataFrame:
        """For each child: totals of its skeleton's nodes, sums beyond its edges."""
        total, beyond = self.solve(known)
        u, ry, rx = self.child
        n, e = np.searchsorted(self.ids, u), np.arange(self.own)
        r = self.rounds
        return pd.concat(
            [
                _rows(ry=ry, rx=rx, kind=NODE, u=u, p=total[n, 0], q=total[n, 1]),
                _rows(ry=self.edge_child[0], rx=self.edge_child[1], kind=EDGE, u=self.ids[r.u[e]], v=self.ids[r.v[e]], p=beyond[0, e, 0], q=beyond[0, e, 1], r=beyond[1, e, 0], s=beyond[1, e, 1]),
            ]
        )


def _up(size: int):
    return lambda key, pdf: Region(key, size, pdf).skeleton()


def _top_down(size: int):
    """Rows of a region and, marked by t = 1, what its parent found for its skeleton."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return Region(key, size, pdf[pdf["t"] == 0]).answers(pdf[pdf["t"] == 1])

    return run


def _last(size: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["t"] == 0]
        region = Region(key, size, own)
        total, _ = region.solve(pdf[pdf["t"] == 1])
        u = own["u"][own["kind"] == NODE].to_numpy(np.int64)
        found = total[np.searchsorted(region.ids, u)]
        return pd.DataFrame({"y": u // WIDE, "x": u % WIDE, "v": found[:, 0] / found[:, 1]})

    return run


def smooth(dsm: DataFrame, tree: DataFrame, sigma: float, tile: int = TILE, merge: int = MERGE) -> DataFrame:
    """dsm (y, x, v) with each value replaced by the mean over its tree, weighted by exp(-length / sigma)."""
    shape = lambda df, **c: df.select(*[c.get(n, F.lit(0).cast(k)).cast(k).alias(n) for n, k in (x.split() for x in ROW.split(", "))])
    cell = lambda c, axis: F.floor((F.floor(F.col(c) / WIDE) if axis == "y" else F.col(c) % WIDE) / tile)
    nodes = shape(dsm, ry=F.floor(F.col("y") / tile), rx=F.floor(F.col("x") / tile), kind=F.lit(NODE), u=F.col("y") * WIDE + F.col("x"), p=F.col("v"), q=F.lit(1.0))
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    both = tree.select(ends.alias("e"), F.exp(-F.col("w") / sigma).alias("d")).select("e.u", "e.v", "d")
    seen = both.select("u", "v", "d", cell("u", "y").alias("ty"), cell("u", "x").alias("tx"), ((cell("u", "y") == cell("v", "y")) & (cell("u", "x") == cell("v", "x"))).alias("within"))
    edges = shape(seen.filter(~F.col("within") | (F.col("u") < F.col("v"))), ry=F.col("ty"), rx=F.col("tx"), kind=F.when(F.col("within"), EDGE).otherwise(STUB), u=F.col("u"), v=F.col("v"), w=F.col("d"))
    base = save(nodes.unionByName(edges), "tree-rows")
    levels, size = [base], tile
    while True:
        up = save(levels[-1].groupBy("ry", "rx").applyInPandas(_up(size), ROW), "tree-sums")
        if up.filter(F.col("kind") == STUB).isEmpty():
            break
        size *= merge
        levels.append(_regions(up, merge))
    known = None
    mark = lambda df, t: df.withColumn("t", F.lit(float(t)))
    for k in range(len(levels) - 1, 0, -1):
        rows = mark(levels[k], 0) if known is None else mark(levels[k], 0).unionByName(mark(known, 1))
        known = save(rows.groupBy("ry", "rx").applyInPandas(_top_down(size), ROW), "tree-answers")
        size //= merge
    rows = mark(base, 0) if known is None else mark(base, 0).unionByName(mark(known, 1))
    return rows.groupBy("ry", "rx").applyInPandas(_last(tile), "y long, x long, v double")


def tree_filter(dsm: DataFrame, guide: DataFrame, sigma: float, iterations: int = 1, tile: int = TILE, merge: int = MERGE) -> DataFrame:
    """``dsm`` filtered ``iterations`` times over the tree of ``guide``. Places are whole numbers from 0; of those that repeat the largest value counts."""
    nodes = lambda px, v: unique(px.filter("v is not null and y is not null and x is not null").select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))).withColumnRenamed("v", v)
    both = save(nodes(dsm, "v").join(nodes(guide, "c"), ["y", "x"]), "tree-pixels")
    tree = save(spanning_tree(both.select("y", "x", F.col("c").alias("v")), tile, merge), "tree-edges")
    out = both.select("y", "x", "v")
    for k in range(iterations):
        out = smooth(out, tree, sigma, tile, merge)
        out = save(out, "tree-filtered") if k + 1 < iterations else out
    return out
