"""Packing token sequences into fixed windows by bounded-space online best fit.

Each partition keeps ``open_windows`` windows. A document is cut into full windows and one
remainder; a remainder goes to the open window that it fills best; when none has room,
the fullest is closed and a new one opened. What a partition leaves open is merged
by the same rule, ``fan_in`` partitions at a time, round by round, until one group is
left, so that no task ever holds more than ``fan_in * open_windows`` windows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword
from .common import integer_id, save

WINDOW = 2048
OPEN_WINDOWS = 48
FAN_IN = 32


class OpenWindows:
    """At most ``most`` open windows, kept in order of their free room."""

    def __init__(self, most: int, size: int, new_id):
        self.most, self.size, self.new_id = most, size, new_id
        self.room: list[tuple[int, int]] = []  # (free, window), ascending

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for an item of ``length``."""
        at = bisect.bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                self.room.pop(0)  # the fullest
            free, window = self.size, self.new_id()
        if free > length:
            bisect.insort(self.room, (free - length, window))
        return window, self.size - free


PIECES = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long"
ARROW = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset"))])


def _pack_partition(path: str, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, count = subword.word_ids(path), TaskContext.get().partitionId(), iter(range(1 << 33))
        new_id = lambda: (part << 33) + next(count)
        windows = OpenWindows(most, size, new_id)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = ids.encode(text.as_py())
                n = len(data) // 4
                for at in range(0, n, size):
                    length = min(size, n - at)
                    window, offset = (new_id(), 0) if length == size else windows.place(length)
                    rows.append((0, doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n, window, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
        left = [(1, None, None, size - free, None, None, window, None) for free, window in windows.room]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left), ARROW.types)], schema=ARROW)

    return run


def _merge_group(size: int, most: int):
    def run(key, pdf):
        """Items are whole windows; the longest go first, ties by id. The first item of a target names it."""
        pdf = pdf.sort_values(["used", "window"], ascending=[False, True])
        fresh: list[int] = []
        windows = OpenWindows(most, size, lambda: fresh.pop())
        target, shift = [], []
        for window, used in zip(pdf["window"], pdf["used"]):
            fresh[:] = [int(window)]
            t, o = windows.place(int(used))
            target.append(t)
            shift.append(o)
        room = {w: size - free for free, w in windows.room}
        pdf = pdf.assign(target=target, shift=shift)
        pdf["open_used"] = [room.get(t) if t == w else None for t, w in zip(pdf["target"], pdf["window"])]
        pdf["open_used"] = pdf["open_used"].astype("Int64")
        pdf["grp"] = int(key[0])
        return pdf[["window", "target", "shift", "open_used", "grp"]]

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty and still has its end id; a null doc_id stays null; repeated
    rows are packed once each; an empty table gives no rows. Other columns of ``docs`` are
    ignored, whatever their names. Sequence ids are unique, not consecutive.
    """
    path = path or subword.default_path()
    rows = save(docs.select(integer_id(docs), "text").mapInArrow(_pack_partition(path, size, open_windows), PIECES), "pack")
    pieces = rows.filter("kind = 0").drop("kind")
    left = rows.filter("kind = 1").select("window", F.col("length").alias("used"), F.shiftright("window", 33).alias("grp"))
    groups = (left.agg(F.max("grp")).first()[0] or 0) + 1
    moved = left.select("window", F.col("window").alias("target"), F.lit(0).cast("long").alias("shift"))
    while True:
        done = groups <= fan_in
        merged = save(
            left.groupBy(F.floor(F.col("grp") / fan_in).cast("long").alias("g")).applyInPandas(_merge_group(size, open_windows), "window long, target long, shift long, open_used long, grp long"),
            "pack-merge",
        )
        step = merged.select(F.col("window").alias("target"), F.col("target").alias("t2"), F.col("shift").alias("s2"))
        moved = moved.join(step, "target", "left").select("window", F.coalesce("t2", "target").alias("target"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"))
        if done:
            break
        left = merged.filter("open_used is not null").select("window", F.col("open_used").alias("used"), "grp")
        groups = -(-groups // fan_in)
    return pieces.join(moved, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("target", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
