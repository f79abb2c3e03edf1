"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank among all ids of the corpus (0 = most frequent, ties by id).
A rank takes 1 to 4 little-endian bytes; its length minus 1 is a 2-bit code, four codes a
control byte, and control bytes stand apart from data bytes, so a decoder reads
lengths from a 256-row table and gathers all values of a block at once.

A *block* holds consecutive documents in ascending doc_id order (nulls first):

    magic "FRB1" | u32 documents | u64 ids | u32 crc32 of the rest
    i64 doc_id per document | u8 "has an id" per document | u32 ids per document
    control bytes | data bytes

A token file is a folder of two Parquet tables, as Spark's writers are the only way to commit files
atomically on any store that a cluster mounts: ``blocks`` with a block a row, and ``ranks`` (rank, id), at
most one row per vocabulary entry. The folder is all that a reader needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import subword
from .common import add_starts, integer_id, new_folder, ordered, save

MAGIC = b"FRB1"
HEADER = struct.Struct("<4sIQI")
BLOCK_IDS = 1 << 20
DOCS_AT_ONCE = 512
#: lengths of the four values of each control byte
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of unsigned 32-bit ``values``."""
    v = values.astype("<u4", copy=False)
    code = (v > 0xFF).view(np.uint8) + (v > 0xFFFF).view(np.uint8) + (v > 0xFFFFFF).view(np.uint8)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    at = np.cumsum(code, dtype=np.int64) + np.arange(len(v))  # of each value's last byte
    data = np.empty(len(v) + int(code.sum(dtype=np.int64)), np.uint8)
    data[at - code] = v & 0xFF
    for k in (1, 2, 3):
        (more,) = np.nonzero(code >= k)
        data[at[more] - code[more] + k] = v[more] >> np.uint32(8 * k) & 0xFF
    return control, data


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`encode_values`, by table lookup and one gather per byte."""
    length = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype("<u4")
    for k in (1, 2, 3):
        (more,) = np.nonzero(length > k)
        out[more] |= data[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    body = b"".join((
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array(counts, "<u4").tobytes(), control.tobytes(), data.tobytes(),
    ))
    return HEADER.pack(MAGIC, len(doc_ids), len(ranks), zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and ranks; raises ValueError for damaged blocks."""
    magic, docs, n, crc = HEADER.unpack_from(block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[HEADER.size :]) != crc:
        raise ValueError("damaged token block")
    at, parts = HEADER.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("u1", -(-n // 4))):
        parts.append(np.frombuffer(block, kind, count, at))
        at += parts[-1].nbytes
    ids = [int(d) if has else None for d, has in zip(parts[0], parts[1])]
    return ids, parts[2], decode_values(parts[3], np.frombuffer(block, np.uint8, offset=at), n)


def _narrow(path: str):
    """Documents to their ids as 16-bit numbers (32-bit if the vocabulary needs it), then one
    row without a place: the task's number of each id, as 64-bit numbers."""
    names = ["doc_id", "_place", "wide", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = subword.word_ids(path)
        vocab = ids.tokenizer.get_vocab_size()
        kind, total = "<u2" if vocab <= 1 << 16 else "<u4", np.zeros(vocab, np.int64)
        for batch in (whole.slice(at, DOCS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, DOCS_AT_ONCE)):
            out = [np.frombuffer(ids.encode(t.as_py()), "<u4").astype(kind) for t in batch.column(1)]
            total += np.bincount(np.concatenate(out), minlength=vocab)
            wide = pa.array([kind == "<u4"] * len(out), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), wide, pa.array([x.tobytes() for x in out], pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([total.tobytes()])], names)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total = np.frombuffer(raw, np.int64)
            (seen,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _encode(by_rank: np.ndarray, block_ids: int):
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "<u4")
    rank[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []  # (place, doc_id, ids) of the open block
        held = 0

        def close():
            nonlocal docs, held
            block = encode_block([d for _, d, _ in docs], [len(x) for _, _, x in docs], rank[np.concatenate([x for _, _, x in docs])])
            row = pa.RecordBatch.from_arrays([pa.array([docs[0][0]], pa.int64()), pa.array([held], pa.int64()), pa.array([block], pa.binary())], ["_place", "n_ids", "block"])
            docs, held = [], 0
            return row

        for batch in batches:
            for place, doc, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("_place", "doc_id", "wide", "ids"))):
                if docs and (held >= block_ids or place >> 33 != docs[0][0] >> 33 or place != docs[-1][0] + 1):
                    yield close()
                ids = np.frombuffer(raw, "<u4" if wide else "<u2")
                docs.append((place, doc, ids))
                held += len(ids)
        if docs:
            yield close()

    return run


def _decode(by_rank: np.ndarray):
    by_rank = by_rank.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, block in zip(batch.column("_place").to_pylist(), batch.column("block").to_pylist()):
                doc_ids, counts, ranks = decode_block(block)
                ids = by_rank[ranks]
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(begins), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["_place", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    return run


def write_blocks(docs: DataFrame, folder: str, path: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the token file of ``docs`` to a new ``folder``.

    ``doc_id`` must be of an integer type (TypeError otherwise). Null text counts as empty and keeps its end
    id; null doc_ids come first; repeated rows stay; an empty table gives no blocks. Other columns are
    ignored, whatever their names.
    """
    path = path or subword.default_path()
    placed = ordered(docs.select(integer_id(docs), "text"), "doc_id")
    stored = save(placed.select("doc_id", "text", "_place").mapInArrow(_narrow(path), "doc_id long, _place long, wide boolean, ids binary"), "token-ids")
    tokens = stored.filter("_place is not null")
    counts = stored.filter("_place is null").select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))], np.int64)  # one row per vocabulary entry at most
    ranks = docs.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long")
    save(ranks.coalesce(1), "ranks", path=f"{folder}/ranks")
    save(tokens.mapInArrow(_encode(by_rank, block_ids), "_place long, n_ids long, block binary"), "blocks", "uncompressed", f"{folder}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """Ids of all earlier blocks, by the block's _place."""
    starts = add_starts(blocks.select("_place", "n_ids"), F.col("n_ids"), "before")
    inside = Window.partitionBy(F.shiftright("_place", 33)).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return starts.select("_place", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").orderBy("rank").toArrow()  # one row per vocabulary entry at most
    blocks = spark.read.schema("_place long, n_ids long, block binary").parquet(f"{folder}/blocks")
    rows = blocks.select("_place", "block").mapInArrow(_decode(ranks.column("id").to_numpy()), "_place long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(block_starts(blocks), "_place").select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """:func:`read_blocks` of what :func:`write_blocks` stores of ``docs``."""
    folder = new_folder(docs.sparkSession, "token-file")
    write_blocks(docs, folder, path)
    return read_blocks(docs.sparkSession, folder)
