"""Merkle manifest of a data set: one leaf a document, a subtree a group, one root.

The place of a document in its group is exact and comes without a global sort. Ids are cut into digits;
a histogram counts the documents of every prefix that leaves out the last ``LOW`` bits, coarser ones
sum it up by ``DIGIT`` bits at a time, and from the coarsest down each prefix starts where its parent starts plus
what smaller siblings hold. Only inside a prefix, of no more than ``2**LOW`` ids, rows are put in order.
Where ids repeat so often that a prefix has more than ``CROWD`` rows, digits of the leaf's digest, then of the row
number, cut it further.

The base-8 digits of the rank are the keys of the tree: a node at level k has the rank without its last k digits. One
shuffle gathers the ``8**STEP`` nodes that share a prefix and reduces them by ``STEP`` levels, so
each longer prefix is done before the shorter one. Siblings go down the same way: a gathered row gets the path above it once, and each
of its nodes puts its own levels before that path.

Leaves ascend by doc_id, null ids first; rows of one id by the leaf's digest; equal rows are interchangeable and get
a place each. A null group comes first. Any column may be null or empty; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_starts, integer_id, ordered, remainder_is, salted_join, save

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 3  # of a digit of the rank: 8 nodes have one parent
STEP = 3  # levels that one shuffle reduces
LOW = 8
DIGIT = 12
CROWD = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(group: Column) -> Column:
    """A string that sorts as the group does bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered: dict[str, Column], where: Column, group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """grp, doc_id, leaf, own (the leaf with the ``tampered`` values, null where not ``where``), row of every document."""
    leaf = digest(*(field(F.col(c)) for c in fields))
    own = digest(*(field(tampered.get(c, F.col(c))) for c in fields))
    out = docs.select(group_key(F.col(group)).alias("grp"), integer_id(docs), leaf.alias("leaf"), F.when(where, own).alias("own"), F.monotonically_increasing_id().alias("row"))
    return save(out, "merkle-leaves")


def _starts(hist: DataFrame, shifts: list[int]) -> DataFrame:
    """``hist`` (grp, some, p, n) with ``start``, the documents of the group before prefix p, and ``total``, all of the group."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not shifts:
        return hist.withColumn("start", before(Window.partitionBy("grp").orderBy("some", "p"))).withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
    up = F.shiftright("p", shifts[0])
    coarse = hist.groupBy("grp", "some", up.alias("p")).agg(F.sum("n").alias("n"))
    above = _starts(coarse, shifts[1:]).select("grp", "some", F.col("p").alias("up"), "start", "total")
    own = hist.withColumn("up", up).withColumn("before", before(Window.partitionBy("grp", "some", "up").orderBy("p")))
    return own.join(above, ["grp", "some", "up"]).select("grp", "some", "p", "n", (F.col("start") + F.col("before")).alias("start"), "total")


def _settle(rows: DataFrame, crowd: int) -> DataFrame:
    """Ranks in crowded prefixes, cut by one more digit a round; rows have grp, total, path, start, n and their leaf."""
    tie = F.lpad(F.hex(F.xxhash64("row")), 16, "0")
    digits = [F.lpad(F.hex(F.coalesce("doc_id", F.lit(0)).bitwiseAND((1 << LOW) - 1)), 2, "0"), *(F.substring("leaf", *x) for x in ((1, 3), (4, 3), (7, 58))), *(F.substring(tie, k, 3) for k in (1, 4, 7, 10)), tie]
    done: DataFrame | None = None
    for k, digit in enumerate(digits):
        rows = rows.withColumn("digit", digit)
        hist = rows.groupBy("grp", "path", "digit").agg(F.count("*").alias("m"), F.min("start").alias("first"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy("grp", "path").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = save(hist.select("grp", "path", "digit", "m", (F.col("first") + before).alias("at")), "merkle-digits")
        rows = save(salted_join(rows, hist, ["grp", "path", "digit"], F.col("row")).select("grp", "total", "doc_id", "leaf", "own", "row", F.concat_ws("/", "path", "digit").alias("path"), F.col("at").alias("start"), F.col("m").alias("n")), "merkle-crowded")
        few = rows if k == len(digits) - 1 else rows.filter(F.col("n") <= crowd)
        place = F.row_number().over(Window.partitionBy("grp", "path").orderBy("doc_id", "leaf", "row")) - 1
        part = few.select("grp", "total", "doc_id", "leaf", "own", (F.col("start") + place).alias("i"))
        done = part if done is None else done.unionByName(part)
        if (hist.agg(F.max("m")).first()[0] or 0) <= crowd:
            break
        rows = rows.filter(F.col("n") > crowd)
    return done


def ranked(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """grp, doc_id, leaf, own, the exact place ``i`` in the group and the group's size ``total``."""
    rows = rows.withColumn("some", F.col("doc_id").isNotNull()).withColumn("p", F.coalesce(F.shiftright("doc_id", LOW), F.lit(0)))
    hist = save(rows.groupBy("grp", "some", "p").agg(F.count("*").alias("n")), "merkle-histogram")
    most = hist.agg(F.max("n")).first()[0] or 0
    starts = _starts(hist, [DIGIT] * ((64 - LOW) // DIGIT))
    keys = ["grp", "some", "p"]
    placed = rows.join(starts, keys) if most <= crowd else salted_join(rows, starts, keys, F.col("row"))
    if most > crowd:
        placed = save(placed, "merkle-placed")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "leaf", "row")) - 1
    out = placed.filter(F.col("n") <= crowd).select("grp", "total", "doc_id", "leaf", "own", (F.col("start") + place).alias("i"))
    if most > crowd:
        out = out.unionByName(_settle(placed.filter(F.col("n") > crowd).withColumn("path", F.concat_ws("/", "some", "p")), crowd))
    return out


def height(n: Column) -> Column:
    """Levels until one node is left: how many powers of 8, from 1 on, are smaller than n."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(60 // BITS)), lambda k: F.pow(F.lit(2.0), BITS * k) < n))


def _parents(nodes: Column) -> Column:
    fan = 1 << BITS
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int")), lambda k: digest(F.array_join(F.slice(nodes, k * fan + 1, F.lit(fan)), "")))


def _gather(nodes: DataFrame, base: int) -> DataFrame:
    """One row for the nodes that share all digits but the last ``STEP``; levels l0, l1, l2 and what they come to."""
    item = F.struct("i", "h", "doc_id", "own")
    rows = nodes.groupBy("grp", F.shiftright("i", BITS * STEP).alias("c")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("height").alias("height"))
    rows = rows.withColumn("l0", F.transform("items", lambda x: x["h"]))
    for k in range(STEP):
        rows = rows.withColumn(f"l{k + 1}", F.when(F.col("height") > base + k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return save(rows.withColumn("top", F.get(f"l{STEP}", F.lit(0))).drop(f"l{STEP}"), "merkle-nodes")


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The gathered rows of every ``STEP`` levels; nodes: grp, i, h, doc_id, own, height."""
    out = [_gather(nodes, 0)]
    for base in range(STEP, levels, STEP):
        left = out[-1].filter(F.col("height") > base)
        out.append(_gather(left.select("grp", F.col("c").alias("i"), F.col("top").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("own"), "height"), base))
    return out


def _path(j: Column, base: int, above: Column) -> Column:
    """Siblings (l: to the left, r: to the right) of node j of a gathered row, its own levels and those above."""
    fan, out = 1 << BITS, []
    for k in range(STEP):
        at, level = F.shiftright(j, BITS * k), F.col(f"l{k}")
        first = F.shiftleft(F.shiftright(at, BITS), BITS)
        some = F.struct(F.array_join(F.slice(level, first + 1, at - first), "").alias("l"), F.array_join(F.slice(level, at + 2, first + fan - 1 - at), "").alias("r"))
        out.append(F.when(F.col("height") > base + k, F.array(some)).otherwise(F.array().cast("array<struct<l: string, r: string>>")))
    return F.concat(*out, above)


def _descend(rows: list[DataFrame], top: DataFrame, root: str) -> DataFrame:
    """doc_id, leaf, grp, subroot, proof and fold of every leaf; top: grp, subroot, above (the subroot's path) of every group."""
    ends = lambda base: top.filter(F.col("height") <= base + STEP).select("grp", F.lit(0).cast("long").alias("c"), "subroot", "above")
    above = None
    for k in range(len(rows) - 1, -1, -1):
        base = k * STEP
        known = ends(base) if above is None else ends(base).unionByName(above)
        here = rows[k].join(known, ["grp", "c"])
        if k:
            nodes = F.transform("items", lambda x, j: F.struct(x["i"].alias("c"), _path(j, base, F.col("above")).alias("above")))
            above = here.select("grp", "subroot", F.inline(nodes)).select("grp", "c", "subroot", "above")

    def judged(x: Column, path: Column) -> Column:
        siblings = F.transform(path, lambda e: F.concat(e["l"], e["r"]))
        fold = F.aggregate(path, F.coalesce(x["own"], x["h"]), lambda acc, e: digest(e["l"], acc, e["r"]))
        return F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("leaf"), F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), fold.alias("folded_root"))

    each = F.transform("items", lambda x, j: F.transform(F.array(_path(j, 0, F.col("above"))), lambda p: judged(x, p))[0])
    found = here.select("grp", "subroot", F.inline(each))
    return found.select("grp", "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, group: str = "lang", fields: tuple[str, ...] = FIELDS, crowd: int = CROWD) -> DataFrame:
    """grp, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    ``tampered`` gives other values of columns for the rows ``where``; their folded_root is recomputed from
    the changed leaf and the siblings of the original tree.
    """
    where = F.lit(False) if where is None else where
    rows = ranked(leaves(docs, tampered or {}, where, group, fields), crowd)
    nodes = save(rows.select("grp", "i", F.col("leaf").alias("h"), "doc_id", "own", height(F.col("total")).alias("height")), "merkle-ranked")
    most = nodes.agg(F.max("height")).first()[0]
    if most is None:
        return rows.select("grp", "doc_id", "leaf", *(F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    climbed = _climb(nodes, most)
    sub = None
    for k, part in enumerate(climbed):
        done = part.filter((F.col("height") <= (k + 1) * STEP) & (F.col("c") == 0)).select("grp", F.col("top").alias("subroot"), "height")
        sub = done if sub is None else sub.unionByName(done)
    sub = save(sub, "merkle-subroots")
    order = save(ordered(sub, "grp"), "merkle-order")
    order = add_starts(order, F.lit(1), "before").withColumn("i", F.col("before") + F.col("_place").bitwiseAND((1 << 33) - 1))
    count = sub.count()
    levels = next(k for k in range(64) if (1 << BITS * k) >= count)
    nodes = order.select(F.lit("").alias("grp"), "i", F.col("subroot").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.col("grp").alias("own"), F.lit(levels).alias("height"))
    tops = _climb(nodes, levels)
    root = tops[-1].first()["top"]
    names = sub.select("grp", "subroot", "height")
    paths = _top_paths(tops).join(names, "grp")
    return _descend(climbed, save(paths, "merkle-top"), root)


def _top_paths(rows: list[DataFrame]) -> DataFrame:
    """grp, above: path of each subroot, for the tree over the groups."""
    empty = F.array().cast("array<struct<l: string, r: string>>")
    above = rows[-1].select("c", empty.alias("above"))
    for k in range(len(rows) - 1, -1, -1):
        here = rows[k].join(above, "c")
        nodes = F.transform("items", lambda x, j: F.struct(x["i"].alias("c"), x["own"].alias("grp"), _path(j, k * STEP, F.col("above")).alias("above")))
        above = here.select(F.inline(nodes))
    return above.select("grp", "above")


def audit(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The manifest, with the text of every document whose crc32(doc_id) 3 divides in lower case (A-Z only) as tampering."""
    found = manifest(docs, {"text": F.translate("text", UPPER, LOWER)}, remainder_is(F.col("doc_id"), 3, 0), crowd=crowd)
    return found.drop("grp")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars::VARCHAR AS n_chars, text, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
  doc_id IS NOT NULL AND coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)))::BIGINT[],
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295), 1) % 3 = 0 AS bad FROM documents),
h AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars) || ':' || n_chars, '-') AS head,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
l AS (SELECT r, doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN bad THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS own FROM h),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
node AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM leaf UNION ALL SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM node WHERE n > 1 GROUP BY g, lvl, i // 8, n),
sub AS (SELECT g, h AS subroot FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, g AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub UNION ALL SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, i // 8, n),
every AS (SELECT g, lvl, i, h FROM node WHERE n > 1 UNION ALL SELECT -1, lvl, i, h FROM top WHERE n > 1),
sib AS (SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM every a JOIN every b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 8 = b.i // 8 GROUP BY ALL),
step AS (SELECT leaf.r AS row, sib.lvl AS k, sib.l, sib.r FROM leaf JOIN sib ON sib.g = leaf.g AND sib.i = leaf.i // (8 ** sib.lvl)::BIGINT
  UNION ALL SELECT leaf.r, 100 + sib.lvl, sib.l, sib.r FROM leaf JOIN sib ON sib.g = -1 AND sib.i = leaf.g // (8 ** sib.lvl)::BIGINT),
numbered AS (SELECT row, l, r, row_number() OVER (PARTITION BY row ORDER BY k) AS k FROM step),
fold AS (SELECT r AS row, 1 AS k, coalesce(own, leaf) AS h FROM leaf UNION ALL SELECT row, fold.k + 1, sha256(l || h || r) FROM fold JOIN numbered USING (row, k)),
done AS (SELECT row, arg_max(h, k) AS folded_root FROM fold GROUP BY row),
proof AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM numbered GROUP BY row)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub USING (g) JOIN done ON done.row = leaf.r LEFT JOIN proof ON proof.row = leaf.r, (SELECT h AS root FROM top WHERE n = 1)
"""
