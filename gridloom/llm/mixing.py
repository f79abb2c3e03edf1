"""Mixing sources to target weights by Pfair scheduling of document blocks.

Block k (0, 1, ...) of a source with the share w of all weights is released at floor(k / w) and
due at ceil((k + 1) / w); in each slot the released block that is due first goes. As the shares
sum to 1, every slot is filled, every block runs inside its window, and after any number of slots
each source is less than one block off its share. Weights are taken as the exact fractions that
their doubles stand for, so no rounding adds up however long the mix is.

The order is worked out by one task that holds one row a source, and streams one row a block (not a
document) to the shared store, where the documents join it. With a ``period``, weights are rounded to whole
slots of a period first (largest remainders, one at least).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_starts, ordered, save

PERIOD = 4096
BLOCK_DOCS = 64
TEMPERATURE = 0.7
NO_SOURCE = "\x01"
PLAN_ROWS = 1 << 16  # rows of the plan in a batch
FEW_SOURCES = 1 << 16  # so many are broadcast


def quotas(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in a period, by largest remainder; ties by name."""
    if len(weights) > period or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive and at most one source per slot of the period")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    over = sum(out.values()) - period
    while over > 0:  # many sources were raised to one slot: the others give some back in turn
        for s in sorted((s for s in out if out[s] > 1), key=lambda s: (-out[s], s))[:over]:
            out[s] -= 1
        over = sum(out.values()) - period
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, -over)]:
        out[s] += 1
    return out


def period_order(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, k, slot, release, deadline) for each slot of one period, earliest deadline first."""
    period = sum(slots.values())
    window = lambda s, k: (k * period // slots[s], -(-(k + 1) * period // slots[s]))
    waiting = [(0, s, 0) for s in sorted(slots)]
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], s, k))
        due, s, k = heapq.heappop(ready)
        out.append((s, k, slot, window(s, k)[0], due))
        if k + 1 < slots[s]:
            heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))
    return out


def _exact(weights: list[float]) -> list[int]:
    """Whole numbers in the same proportions."""
    parts = [float(w).as_integer_ratio() for w in weights]
    below = max((d for _, d in parts), default=1)  # powers of 2
    return [n * (below // d) for n, d in parts]


def block_order(sources: list[str], weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of source, k, slot, release, deadline) until every source has given all its blocks."""
    total, left, slot = sum(weights), len(blocks), 0
    ties = sorted(range(len(sources)), key=sources.__getitem__)  # equal deadlines go by name
    waiting = [(0, rank, 0) for rank in range(len(ties))]
    ready: list[tuple[int, int, int, int]] = []
    while left:
        while waiting and waiting[0][0] <= slot:
            release, rank, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[ties[rank]]), rank, k, release))
        due, rank, k, release = heapq.heappop(ready)
        s = ties[rank]
        yield s, k, slot, release, due
        left -= k + 1 == blocks[s]
        heapq.heappush(waiting, ((k + 1) * total // weights[s], rank, k + 1))
        slot += 1


PLAN = "mix_source string, own long, block long, epoch long, slot long, release long, deadline long"


def _plan(period: int | None, repeat: bool):
    """Rows of ``PLAN`` from rows (mix_source, weight, blocks) in one task."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([pd.DataFrame({"mix_source": [], "weight": [], "blocks": []}), *pdfs])
        names, blocks = found["mix_source"].tolist(), [int(b) for b in found["blocks"]]
        given = found["weight"].tolist()
        slots = quotas(dict(zip(names, given)), period) if period and names else None
        order = block_order(names, [slots[s] for s in names] if slots else _exact(given), blocks)
        rows = ((names[s], k % blocks[s], k, k // blocks[s], slot, release, due) for s, k, slot, release, due in order if repeat or k < blocks[s])
        while part := list(islice(rows, PLAN_ROWS)):
            yield pd.DataFrame(part, columns=[c.split()[0] for c in PLAN.split(", ")])

    return run


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, repeat: bool = True, block_docs: int = BLOCK_DOCS, period: int | None = None) -> DataFrame:
    """Every row of ``docs`` (as struct ``doc``) with its place in the mix.

    Without ``weights``, a source's weight is its number of rows to the power ``temperature``.
    With ``repeat``, the mix ends with the slot in which the last source has given all its rows;
    sources that are through earlier start again (column epoch). Otherwise every row
    comes once and a source that is through leaves its slots empty. Rows of a source come in
    the order of a hash of their id. Columns: doc, mix_source, quota (share of the slots; with
    ``period``, slots of a period), block, epoch, slot, release, deadline, position (slot * block_docs + place
    in block).

    A null source is a source of its own; rows with null or repeated ids are all kept; sources
    without a weight, and weights that aren't positive, raise ValueError; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("mix_source"), F.xxhash64("doc_id").alias("_h"))
    placed = save(ordered(rows, "mix_source", "_h"), "mix-order")
    index = (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("_index")
    placed = add_starts(placed, F.lit(1), "_before").select("doc", "mix_source", index)
    sources = placed.groupBy("mix_source").agg(F.count("*").alias("n"), F.min("_index").alias("_first"))
    if weights is None:
        sources = sources.withColumn("weight", F.pow("n", F.lit(float(temperature))))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "mix_source string, weight double")
        sources = sources.join(given, "mix_source", "left")
    sources = save(sources.withColumn("blocks", F.ceil(F.col("n") / block_docs).cast("long")), "mix-sources")
    if missing := [r["mix_source"] for r in sources.filter("weight is null").orderBy("mix_source").limit(5).collect()]:
        raise ValueError(f"sources without a weight: {missing}")
    kinds, total = sources.agg(F.count("*"), F.sum("weight")).first()
    if sources.filter("not weight > 0 or isnan(weight) or weight = double('inf')").limit(1).count():
        raise ValueError("weights must be positive")
    if period:
        slots = quotas({r["mix_source"]: r["weight"] for r in sources.limit(period + 1).collect()}, period) if kinds else {}
        quota = spark.createDataFrame(list(slots.items()), "mix_source string, quota long")
        sources = sources.join(F.broadcast(quota), "mix_source")
    else:
        sources = sources.withColumn("quota", F.col("weight") / F.lit(total))
    plan = save(sources.select("mix_source", "weight", "blocks").repartition(1).mapInPandas(_plan(period, repeat), PLAN), "mix-plan")
    few = sources.select("mix_source", "_first", "quota")
    at = placed.join(F.broadcast(few) if kinds <= FEW_SOURCES else few, "mix_source").withColumn("_at", F.col("_index") - F.col("_first"))
    at = at.select("doc", "mix_source", "quota", F.floor(F.col("_at") / block_docs).cast("long").alias("own"), (F.col("_at") % block_docs).alias("_inside"))
    return at.join(plan, ["mix_source", "own"]).select("doc", "mix_source", "quota", "block", "epoch", "slot", "release", "deadline", (F.col("slot") * block_docs + F.col("_inside")).alias("position"))


def interleave(docs: DataFrame, **params) -> DataFrame:
    """``docs`` (all columns, each row once) in the order of the mix, one range of positions per partition."""
    params = {"temperature": 1.0, "repeat": False} | params
    mixed = schedule(docs, **params)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")
