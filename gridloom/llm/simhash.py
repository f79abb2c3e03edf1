"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most ``4`` of 64 bits differ in at most one bit of one of
three bit blocks (22, 21 and 21 bits), as two bits in each would be six: threshold 4 on all bits becomes
threshold 1 in some block. Each block's anchors are a covering code:
the [15,11] Hamming code on its low 15 bits (covering radius 1) times all words of the rest.
A fingerprint's *home* is the anchor within the covering radius; it is replicated to every
anchor that can be the home of a partner (distance at most radius + 1, 13.6 anchors on average
of 2**17 or 2**18), and each anchor compares its homes with all that it got, on all 64 bits.

Equal fingerprints are merged first, so copies cost nothing. Anchors with many homes are
cut into chunks of homes, each with all of the anchor's rows, so that a hot anchor spreads over
many tasks and no link is lost. A batch emits a spanning forest of its links, not all pairs.
Components come from alternating large-star and small-star steps, each a join and a
grouping written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, integer_id, save

SHINGLE = 4
BITS = 4
CHUNK_HOMES = 2048
PAIRS_AT_ONCE = 1 << 21
ROWS_AT_ONCE = 1 << 20
#: (lowest bit, width) of the three blocks
BLOCKS = ((42, 22), (21, 21), (0, 21))

_words = np.arange(1 << 15)
SYNDROME = np.bitwise_xor.reduce([np.where(_words >> i & 1, i + 1, 0) for i in range(15)]).astype(np.uint8)
HOME = np.where(SYNDROME > 0, _words ^ (1 << (SYNDROME.astype(np.int64) - 1).clip(0)), _words)
#: for each syndrome but 0, the seven flips of two bits that lead to a codeword
TWO_FLIPS = np.array([[0] * 7] + [[(1 << i - 1) ^ (1 << (i ^ s) - 1) for i in range(1, 16) if i < (i ^ s)] for s in range(1, 16)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; 0 for a text without words (null included)."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes both mean ASCII only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())])
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(integer_id(docs), "text").mapInArrow(run, "doc_id long, fp long")


def home_anchors(fp: np.ndarray) -> list[np.ndarray]:
    """For each block, the key of the anchor within the covering radius."""
    u, out = fp.view(np.uint64), []
    for k, (low, width) in enumerate(BLOCKS):
        b = (u >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        out.append(k << 22 | (b & ~0x7FFF) | HOME[b & 0x7FFF])
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is home) for each anchor that each fingerprint goes to."""
    u, rows, keys, homes = fp.view(np.uint64), [], [], []

    def add(row, key, home):
        rows.append(row)
        keys.append(key)
        homes.append(np.full(len(row), home))

    every = np.arange(len(fp))
    for k, (low, width) in enumerate(BLOCKS):
        b = (u >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        rest, word = k << 22 | (b & ~0x7FFF), b & 0x7FFF
        add(every, rest | HOME[word], True)
        for bit in range(15, width):
            add(every, (rest ^ (1 << bit)) | HOME[word], False)
        (off,) = np.nonzero(SYNDROME[word])
        for flips in TWO_FLIPS[SYNDROME[word[off]]].T:
            add(off, rest[off] | (word[off] ^ flips), False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _count_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, n = np.unique(np.concatenate(home_anchors(batch.column(0).to_numpy())), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _replicate(hot_keys: np.ndarray, hot_chunks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, key, home = anchors(fp)
            chunks = np.ones(len(key), np.int64)
            if len(hot_keys):
                at = np.searchsorted(hot_keys, key).clip(max=len(hot_keys) - 1)
                chunks = np.where(hot_keys[at] == key, hot_chunks[at], 1)
            mine = ((fp[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks
            upto = np.cumsum(chunks)
            cuts = np.searchsorted(upto, np.arange(ROWS_AT_ONCE, upto[-1] + 1, ROWS_AT_ONCE)) if len(upto) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):  # a hot key's copies may be many times the batch
                n = chunks[lo:hi]
                again = np.repeat(np.arange(lo, hi), n)
                chunk = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                is_home = home[again] & (chunk == mine[again])
                yield pa.RecordBatch.from_arrays([pa.array(key[again].astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(~is_home), pa.array(fp[row[again]])], ["key", "chunk", "away", "fp"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node it reaches) with the components of the edges a-b."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    (leaf,) = np.nonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def _compare(bits: int):
    """Rows come sorted by key, chunk, homes first; only the homes of an unfinished group are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = -1, np.zeros(0, np.int64)
        for batch in batches:
            key, chunk, away, new = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if not len(new):
                continue
            group = key.astype(np.int64) << 31 | chunk
            if group[0] != held_group:
                held = held[:0]
            fp = np.concatenate((held, new))
            group = np.concatenate((np.full(len(held), group[0]), group))
            is_home = np.concatenate((np.ones(len(held), bool), ~away))
            starts = np.nonzero(np.concatenate(([True], group[1:] != group[:-1])))[0]
            n_homes = np.add.reduceat(is_home.astype(np.int64), starts)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fp))))
            mine = np.arange(len(held), len(fp))
            each = n_homes[of[mine]]
            a_out, b_out = [], []
            bounds = np.searchsorted(np.cumsum(each), np.arange(PAIRS_AT_ONCE, each.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="right")
            for lo, hi in zip(np.concatenate(([0], bounds)), np.append(bounds, len(mine))):
                m, e = mine[lo:hi], each[lo:hi]
                left = np.repeat(m, e)
                right = np.repeat(starts[of[m]], e) + np.arange(len(left)) - np.repeat(np.cumsum(e) - e, e)
                near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= bits  # of signed numbers it would count the absolute value's bits
                near &= left != right
                a_out.append(fp[left[near]])
                b_out.append(fp[right[near]])
            a, b = np.concatenate(a_out), np.concatenate(b_out)
            if len(a):
                x, y = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
            held_group, last = group[-1], starts[-1]
            held = fp[last:][is_home[last:]]

    return run


def links(distinct: DataFrame, bits: int = BITS, chunk_homes: int = CHUNK_HOMES) -> DataFrame:
    """Edges u, v (u > v) whose components are those of all pairs within ``bits`` bits.

    ``distinct`` has one row per fingerprint (column fp).
    """
    hot = distinct.mapInArrow(_count_homes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > chunk_homes)
    rows = sorted(hot.collect())  # at most one row per anchor of the code, whatever the data
    hot_keys, hot_chunks = np.array([r[0] for r in rows], np.int64), np.array([-(-r[1] // chunk_homes) for r in rows], np.int64)
    spread = distinct.mapInArrow(_replicate(hot_keys, hot_chunks), "key int, chunk int, away boolean, fp long")
    dealt = spread.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "away")
    return dealt.mapInArrow(_compare(bits), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` but the roots."""
    state = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-minima")  # stored, so that a hub's join can be split
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = save(large, "large-star")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        state = save(small.filter("u <> v").distinct(), "small-star")


def dedup(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, chunk_homes: int = CHUNK_HOMES) -> DataFrame:
    """doc_id, fp, component_id, root for every row of ``docs``; ``root`` is the smallest fingerprint of the component.

    A null or wordless text has fingerprint 0 and links like any other; a row with null
    doc_id gets the id of its component (null if no member has one); repeated rows stay;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    fps = save(fingerprints(docs, shingle), "fingerprints")
    first = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(first.select("fp"), bits, chunk_homes))
    rooted = save(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = save(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-minima")
    ids = save(rooted.join(least, "root").select("fp", "component_id", "root"), "component-ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id", "root")


def hex_digits(fp: Column) -> Column:
    """A signed fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, **params) -> DataFrame:
    """``docs`` (all columns) with one row per near-duplicate group: that of the smallest doc_id.

    Where the smallest id of a group repeats, one of its rows in that group stays (of the lowest fingerprint, then text);
    rows that share an id over different texts are told apart. Rows with a null doc_id can't be told
    apart, so they take no part and stay.
    """
    known = save(dedup(docs.filter("doc_id is not null"), shingle=shingle, **params), "near-duplicates")
    rows = save(known.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "near-duplicate-ids")
    again = rows.filter("n > 1").select("doc_id")
    gone = rows.filter("n > 1 or doc_id <> component_id").select("doc_id")
    once = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)  # one shuffle of docs at every size
    if again.isEmpty():
        return once
    fp, root, rank = (free_name(docs, x) for x in ("fingerprint", "root", "rank"))

    @F.arrow_udf("long")
    def of_text(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    firsts = known.join(again, "doc_id", "left_semi").filter("doc_id = component_id").select("doc_id", F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    several = docs.join(again, "doc_id", "left_semi").withColumn(fp, of_text("text")).join(firsts, ["doc_id", fp])
    first = F.row_number().over(Window.partitionBy("doc_id", root).orderBy(fp, "text"))
    return once.unionByName(several.withColumn(rank, first).filter(F.col(rank) == 1).select(*docs.columns))
