"""Media columns: signature sniffing, structure checks, type correction and carving.

An Aho-Corasick automaton over all magic bytes runs once over a binary value. Each hit goes to
its format's validator, which walks the structure (chunks, blocks or segments), checks
lengths and checksums, and returns where the file ends. The valid hit at offset 0
corrects the declared type; every valid hit is carved with offset and length, also one that lies
inside another's data.

Text payloads are stored as 8-bit mono PCM in a RIFF container. The column is written as a
Parquet table and read back, and features come from the carved samples only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, integer_id, save

#: magic bytes, format, and where in a file they stand; fixed values of the formats
SIGNATURES = (
    (b"RIFF", "audio/wav", 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"BM", "image/bmp", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
)
SAMPLE_RATE = 8000
PAD = 64
UNDECLARED = "application/octet-stream"


def wav_end(b: bytes, at: int) -> int | None:
    """End of the RIFF file at ``at``: fmt before data, chunks that fill the declared size."""
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, pos, seen = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, []
    if end > len(b):
        return None
    while pos < end:
        if end - pos < 8:
            return None
        name, size = b[pos : pos + 4], int.from_bytes(b[pos + 4 : pos + 8], "little")
        if name == b"fmt " and size < 16 or name == b"data" and b"fmt " not in seen:
            return None
        seen.append(name)
        pos += 8 + size + (size & 1)
    return end if pos in (end, end + 1) and b"data" in seen else None


def png_end(b: bytes, at: int) -> int | None:
    """End of the PNG at ``at``: IHDR first, right checksums, up to IEND."""
    pos, first = at + 8, True
    while len(b) - pos >= 12:
        size, name = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if pos + 12 + size > len(b) or first != (name == b"IHDR") or zlib.crc32(b[pos + 4 : pos + 8 + size]) != int.from_bytes(b[pos + 8 + size : pos + 12 + size], "big"):
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos
    return None


def gif_end(b: bytes, at: int) -> int | None:
    """End of the GIF at ``at``: colour tables and sub-blocks up to the trailer."""
    if len(b) - at < 14:
        return None
    flags, pos = b[at + 10], at + 13
    pos += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    images = 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 if images else None
        if kind == 0x2C and len(b) - pos >= 11:
            images += 1
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def bmp_end(b: bytes, at: int) -> int | None:
    """End of the bitmap at ``at``: known header size, offsets and lengths that agree."""
    if len(b) - at < 54:
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if zero or header not in (40, 52, 56, 108, 124) or not 14 + header <= offset <= size or size > len(b) - at:
        return None
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    packed = struct.unpack_from("<I", b, at + 30)[0]
    return at + size if packed or offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def jpeg_end(b: bytes, at: int) -> int | None:
    """End of the JPEG at ``at``: marker segments with a frame and a scan, up to the end marker."""
    pos, frame, scan = at + 2, False, False
    while len(b) - pos >= 2:
        if b[pos] != 0xFF:
            return None
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 if frame and scan else None
        if kind == 0xFF:
            pos += 1
            continue
        if len(b) - pos < 4 or kind in (0x00, 0xD8) or 0xD0 <= kind <= 0xD7:
            return None
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if size < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if kind == 0xDA:
            scan = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
    return None


VALIDATORS = {"audio/wav": wav_end, "image/png": png_end, "image/gif": gif_end, "image/bmp": bmp_end, "image/jpeg": jpeg_end}
_automaton = None


def automaton():
    """The worker's automaton over all signatures, on bytes read as Latin-1."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, kind, place in SIGNATURES:
            _automaton.add_word(magic.decode("latin-1"), (len(magic) + place, kind))
        _automaton.make_automaton()
    return _automaton


def sniff(value: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every structure that passes its validator, in order of offset."""
    out = []
    for last, (width, kind) in automaton().iter(value.decode("latin-1")) if value else ():
        start = last + 1 - width
        end = VALIDATORS[kind](value, start) if start >= 0 else None
        if end is not None:
            out.append((kind, start, end - start))
    return out


CARVED = "array<struct<type:string,offset:long,length:long>>"


def identify(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with ``carved`` (all valid structures) and ``detected_type`` (that at offset 0, else null).

    Null and empty values have no structure. The new columns get a leading underscore
    where ``media`` has such names.
    """

    @F.pandas_udf(CARVED)
    def carve(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in values:
            yield pd.Series([[{"type": t, "offset": o, "length": n} for t, o, n in sniff(v)] for v in part], dtype=object)

    carved, kind = free_name(media, "carved"), free_name(media, "detected_type")
    out = media.withColumn(carved, carve(column))
    return out.withColumn(kind, F.get(F.filter(F.col(carved), lambda c: c["offset"] == 0), F.lit(0))["type"])


def cut(value: Column, carved: Column) -> Column:
    """The bytes of one carved structure."""
    return F.substring(value, carved["offset"].cast("int") + 1, carved["length"].cast("int"))


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + n + (n & 1), b"WAVE") + fmt + struct.pack("<4sI", b"data", n) + payload + b"\0" * (n & 1)


def wav_samples(value: bytes, at: int, length: int) -> tuple[dict[str, int], np.ndarray]:
    """Format fields and samples of a validated RIFF file with 8-bit samples."""
    pos, form = at + 12, {}
    while pos < at + length:
        name, size = value[pos : pos + 4], int.from_bytes(value[pos + 4 : pos + 8], "little")
        if name == b"fmt ":
            form = dict(zip(("code", "channels", "rate", "bytes_s", "align", "bits"), struct.unpack_from("<HHIIHH", value, pos + 8)))
        elif name == b"data":
            return form, np.frombuffer(value, np.uint8, size, pos + 8)
        pos += 8 + size + (size & 1)
    return form, np.zeros(0, np.uint8)


def feature(kind: str, form: dict[str, int], samples: np.ndarray) -> str:
    """Whole numbers only, so that equal samples give equal strings everywhere."""
    s = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    low, high = (int(s.min()), int(s.max())) if len(s) else (0, 0)
    return f"{kind};rate={form['rate']};bits={form['bits']};n={len(s)};min={low};max={high};sum={int(s.sum())};energy={int((s * s).sum())};crossings={crossings}"


STORED = "doc_id long, declared string, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, detected_type string, carved long"
DIGEST_NAMES = [x.split()[0] for x in DIGEST.split(", ")]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode()
            sizes.append(len(raw))
            media.append(to_wav(raw + b"\0" * (-len(raw) % PAD if raw else PAD)))
        kinds = pa.array([UNDECLARED] * len(media), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), kinds, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "declared", "n_bytes", "media"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        for doc, declared, n, value in zip(*(batch.column(k) for k in range(4))):
            value, found = value.as_py(), None
            hits = sniff(value)
            found = next((h for h in hits if h[0] == "audio/wav" and h[1] == 0), None)
            if found is None:
                raise ValueError(f"stored media of document {doc} is damaged")
            form, samples = wav_samples(value, found[1], found[2])
            payload = samples.tobytes()
            rows.append((
                doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(value), hashlib.sha256(value).hexdigest(),
                feature(found[0], form, samples), declared.as_py(), found[0], len(hits),
            ))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], DIGEST_NAMES)


def store(docs: DataFrame) -> DataFrame:
    """Every text's payload as a stored media column: doc_id, declared, n_bytes, media."""
    return save(docs.select(integer_id(docs), "text").mapInArrow(_store, STORED), "media")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digest of every stored payload as read back.

    Null text counts as empty: a payload of 64 zero bytes. Null doc_ids stay null; repeated
    rows stay; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return store(docs).mapInArrow(_digest, DIGEST)
