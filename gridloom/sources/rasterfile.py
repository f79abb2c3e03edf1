"""Raster files as a Spark data source: uncompressed TIFF (classic and big) and headered raw files (BSQ, BIL, BIP).

Reading gives pixel form (raster, band, y, x, v). A file is cut by its own blocks, strips or tiles, and each partition takes
about ``split_bytes`` of them; the ranges that a filter or the options y0, y1, x0, x1 leave reach the source, which
then fetches the bytes of no other block. Band numbers do the same. Pixels equal to the file's no-data value (or NaN) are NULL.

Writing puts each tile of ``tile`` x ``tile`` pixels in a file of its own, as no store lets many tasks write one file.
Files of a failed or repeated attempt are never read: names carry the attempt, and the commit at the end writes an index
of those that count (name, origin, shape, bytes), from which a later crop plans the files that it needs. Files without an
index are listed, and tasks read their headers. Absent pixels and NULL are written as no-data; of repeated pixels the largest counts.

Bytes come through ``pyarrow.fs``, by byte ranges, from any store that it knows by its URI.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "raster string, band int, y long, x long, v double"
HEADER_SCHEMA = "raster string, path string, rows long, cols long, bands int, kind string, y0 long, x0 long, transform array<double>, nodata double, blocks long"
SPLIT_BYTES = 32 << 20
TILE = 1024
STRIP_BYTES = 256 << 10
INDEX = "_index.parquet"
BIG = 0xFFF00000  # bytes from which a file needs 64-bit offsets
BATCH = 1 << 18  # pixels handed to Spark at a time

# Fixed values of the TIFF format: field types (struct code, bytes), tags, sample formats.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, X_RES, Y_RES, PLANAR, X_POS, Y_POS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 282, 283, 284, 286, 287
TILE_WIDTH, TILE_LENGTH, TILES, TILE_SIZES, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORM, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113
KINDS = {1: "u", 2: "i", 3: "f"}
#: data types of raw headers
RAW_KINDS = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


@dataclass(frozen=True)
class Block:
    """A range of bytes: samples of rows y.. and columns x.. (from the file's own corner) of all bands, or of one."""

    offset: int
    size: int
    y: int
    x: int
    rows: int
    cols: int
    stored: int  # samples in a stored row
    band: int | None
    order: str = "bip"  # of a block of all bands: bip or bil


@dataclass
class Layout:
    rows: int
    cols: int
    bands: int
    kind: np.dtype
    blocks: list[Block]
    y0: int = 0
    x0: int = 0
    transform: list[float] | None = None
    nodata: float | None = None


@dataclass
class Window:
    """Bounds, both included, that filters leave; None is open."""

    y: list = field(default_factory=lambda: [None, None])
    x: list = field(default_factory=lambda: [None, None])
    bands: set | None = None

    def narrow(self, name: str, low=None, high=None) -> None:
        at = getattr(self, name)
        at[0] = low if at[0] is None else at[0] if low is None else max(at[0], low)
        at[1] = high if at[1] is None else at[1] if high is None else min(at[1], high)

    def meets(self, y: int, x: int, rows: int, cols: int) -> bool:
        return all((lo is None or first + n > lo) and (hi is None or first <= hi) for (lo, hi), first, n in ((self.y, y, rows), (self.x, x, cols)))

    def take(self, f: Filter) -> None:
        """Narrow by a filter where it is one of y, x or band; Spark evaluates all of them again."""
        name, value = f.attribute[-1] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else "", getattr(f, "value", None)
        values = sorted(v for v in (f.value if isinstance(f, In) else [value]) if v is not None) if name in ("y", "x", "band") else []
        if not values:
            return
        if name == "band":
            if isinstance(f, (EqualTo, In)):
                self.bands = set(values) if self.bands is None else self.bands & set(values)
        elif isinstance(f, (EqualTo, In)):
            self.narrow(name, values[0], values[-1])
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.narrow(name, low=value + isinstance(f, GreaterThan))
        else:
            self.narrow(name, high=value - isinstance(f, LessThan))


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """Store and path of a URI or local path."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def tiff_layout(file, size: int) -> Layout:
    """Layout of an uncompressed TIFF; ValueError for anything else."""
    head = file.read_at(min(16, size), 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    big = bool(order) and struct.unpack(order + "H", head[2:4])[0] == 43
    if not order or not big and struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    width = struct.calcsize("=" + word)
    at = struct.unpack(order + word, head[8:16] if big else head[4:8])[0]
    n = struct.unpack(order + count, file.read_at(struct.calcsize("=" + count), at))[0]
    raw = file.read_at(n * entry, at + struct.calcsize("=" + count))
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind = struct.unpack(order + "HH", raw[k * entry : k * entry + 4])
        number = struct.unpack(order + word, raw[k * entry + 4 : k * entry + 4 + width])[0]
        if kind not in TYPES:
            continue
        one = struct.calcsize("=" + TYPES[kind])
        value = raw[k * entry + 4 + width : (k + 1) * entry]
        if one * number > width:
            value = file.read_at(one * number, struct.unpack(order + word, value)[0])
        code = TYPES[kind]
        tags[tag] = (value[:number].rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{number * len(code)}{code[0]}", value[: one * number])
    get = lambda tag, default=0: tags.get(tag, (default,))[0]
    if get(COMPRESSION, 1) != 1:
        raise ValueError("compressed TIFF files can't be read")
    rows, cols, bands, bits, planes = get(LENGTH), get(WIDTH), get(SAMPLES, 1), get(BITS, 1), get(PLANAR, 1) == 2
    letter = KINDS.get(get(SAMPLE_FORMAT, 1))
    if letter is None or bits not in ((32, 64) if letter == "f" else (8, 16, 32, 64)) or len(set(tags.get(BITS, (1,)))) > 1 or len(set(tags.get(SAMPLE_FORMAT, (1,)))) > 1:
        raise ValueError("samples must be whole or real numbers of 8 to 64 bits, of one type in all bands")
    tiled = TILES in tags
    offsets, sizes = tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES]
    height = get(TILE_LENGTH) if tiled else min(rows, get(ROWS_PER_STRIP, rows))
    across = get(TILE_WIDTH) if tiled else cols
    grid = (-(-rows // height), -(-cols // across))
    blocks = []
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        plane, rest = divmod(k, grid[0] * grid[1])
        i, j = divmod(rest, grid[1])
        blocks.append(Block(offset, size, i * height, j * across, min(height, rows - i * height), min(across, cols - j * across), across, plane if planes else None if bands > 1 else 0))
    transform = None
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        transform = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        transform = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    ratio = lambda tag, default: tags[tag][0] / max(1, tags[tag][1]) if tag in tags else default
    nodata = float(get(NODATA, "")) if re.fullmatch(r"\s*[-+0-9.eEnaN]+\s*", str(get(NODATA, ""))) else None
    return Layout(rows, cols, bands, np.dtype(f"{order}{letter}{bits // 8}"), blocks, round(ratio(Y_POS, 0) * ratio(Y_RES, 1)), round(ratio(X_POS, 0) * ratio(X_RES, 1)), transform, nodata)


def raw_layout(header: str, size: int) -> Layout:
    """Layout of a raw file by its text header of "name = value" lines; a block is some rows."""
    pairs = {m[1].strip().lower(): m[2].strip() for m in re.finditer(r"(?m)^\s*([^=\n]+?)\s*=\s*(\{[^}]*\}|[^\n]*)", header)}
    number = lambda name, default=None: int(float(pairs[name])) if name in pairs or default is None else default
    rows, cols, bands, start = number("lines"), number("samples"), number("bands", 1), number("header offset", 0)
    if number("data type") not in RAW_KINDS:
        raise ValueError("complex samples can't be read")
    kind = np.dtype(("><"[number("byte order", 0) == 0]) + RAW_KINDS[number("data type")])
    order = pairs.get("interleave", "bsq").lower()
    if order not in ("bsq", "bil", "bip"):
        raise ValueError(f"interleave {order!r}")
    if size < start + rows * cols * bands * kind.itemsize:
        raise ValueError("the file is shorter than its header says")
    row = cols * kind.itemsize * (1 if order == "bsq" else bands)
    step = max(1, STRIP_BYTES // max(1, row))
    blocks = [Block(start + (p * rows + y) * row, min(step, rows - y) * row, y, 0, min(step, rows - y), cols, cols, p if order == "bsq" or bands == 1 else None, order if order != "bsq" else "bip") for p in range(bands if order == "bsq" else 1) for y in range(0, rows, step)]
    transform = None
    if "map info" in pairs:
        m = [x.strip() for x in pairs["map info"].strip("{}").split(",")]
        px, py, x, y, sx, sy = map(float, m[1:7])
        transform = [x - (px - 1) * sx, sx, 0.0, y + (py - 1) * sy, 0.0, -sy]
    nodata = float(pairs["data ignore value"]) if "data ignore value" in pairs else None
    return Layout(rows, cols, bands, kind, blocks, number("y start", 1) - 1, number("x start", 1) - 1, transform, nodata)


def layout_of(store: pafs.FileSystem, path: str) -> Layout:
    size = store.get_file_info(path).size
    with store.open_input_file(path) as file:
        if size >= 8 and file.read_at(2, 0) in (b"II", b"MM"):
            return tiff_layout(file, size)
    for name in (f"{path}.hdr", re.sub(r"\.[^./]*$", "", path) + ".hdr"):
        if store.get_file_info(name).type == pafs.FileType.File:
            with store.open_input_stream(name) as head:
                return raw_layout(head.read().decode("latin-1"), size)
    raise ValueError(f"{path} is neither a TIFF file nor has a header beside it")


def tiff_bytes(values: np.ndarray, y0: int, x0: int, transform: list[float] | None, nodata: float | None, planes: bool = True) -> Iterator[bytes]:
    """A TIFF of bands x rows x cols, little-endian, in strips; ``planes`` puts bands one after the other."""
    bands, rows, cols = values.shape
    data = np.ascontiguousarray(values if planes else np.moveaxis(values, 0, 2)).astype(values.dtype.newbyteorder("<"), copy=False)
    row = cols * values.dtype.itemsize * (1 if planes else bands)
    step = max(1, STRIP_BYTES // max(1, row))
    sizes = [min(step, rows - y) * row for _ in range(bands if planes else 1) for y in range(0, rows, step)]
    big = sum(sizes) + 16 * len(sizes) > BIG
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags: list[tuple[int, int, list]] = [
        (WIDTH, 4, [cols]), (LENGTH, 4, [rows]), (BITS, 3, [8 * values.dtype.itemsize] * bands), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]),
        (STRIPS, 16 if big else 4, [0] * len(sizes)), (SAMPLES, 3, [bands]), (ROWS_PER_STRIP, 4, [step]), (STRIP_SIZES, 16 if big else 4, sizes),
        (X_RES, 5, [1, 1]), (Y_RES, 5, [1, 1]), (PLANAR, 3, [2 if planes else 1]), (X_POS, 5, [x0, 1]), (Y_POS, 5, [y0, 1]), (SAMPLE_FORMAT, 3, [kind] * bands),
    ]
    if transform:
        t = transform
        tags.append((TRANSFORM, 12, [t[1], t[2], 0.0, t[0] + t[1] * x0 + t[2] * y0, t[4], t[5], 0.0, t[3] + t[4] * x0 + t[5] * y0, *[0.0] * 7, 1.0]))
    if nodata is not None:
        tags.append((NODATA, 2, [*f"{nodata:.17g}".encode(), 0]))
    width = struct.calcsize("=" + word)
    start = (16 if big else 8) + struct.calcsize("=" + count) + len(tags) * entry + width
    packed = [struct.pack(f"<{len(v)}{'B' if t == 2 else TYPES[t][0]}", *v) for _, t, v in tags]
    length = start + sum(len(p) + len(p) % 2 for p in packed if len(p) > width)
    offsets = (length + np.append(0, np.cumsum(sizes[:-1]))).astype(int).tolist() if sizes else []
    at = next(k for k, t in enumerate(tags) if t[0] == STRIPS)
    packed[at] = struct.pack(f"<{len(offsets)}{word}", *offsets)
    out, extra = [struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8), struct.pack("<" + count, len(tags))], []
    for (tag, kind, value), p in zip(tags, packed):
        number = len(value) // (2 if kind == 5 else 1)
        if len(p) <= width:
            field_ = p.ljust(width, b"\0")
        else:
            field_ = struct.pack("<" + word, start + sum(map(len, extra)))
            extra.append(p + b"\0" * (len(p) % 2))
        out.append(struct.pack("<HH" + word, tag, kind, number) + field_)
    yield b"".join([*out, struct.pack("<" + word, 0), *extra])
    yield data.tobytes()


@dataclass
class Share(InputPartition):
    """Blocks of a file that fall to one partition: those that begin in the k-th of n equal parts of its bytes."""

    path: str
    raster: str
    k: int
    n: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.headers = str(options.get("headers", "false")).lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.window = Window()
        for name, low, high in (("y", "y0", "y1"), ("x", "x0", "x1")):
            self.window.narrow(name, *(int(options[k]) if k in options else None for k in (low, high)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.headers:
                self.window.take(f)
            yield f  # a block is wider than a range: Spark cuts the rest off

    def partitions(self) -> list[Share]:
        store, root = place(self.options["path"])
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        index = f"{root}/{INDEX}"
        if info.type == pafs.FileType.Directory and store.get_file_info(index).type == pafs.FileType.File:
            with store.open_input_file(index) as file:
                rows = pq.read_table(file).to_pylist()
            own = root.rstrip("/").rpartition("/")[2]
            found = [(f"{root}/{r['name']}", own, r["bytes"]) for r in rows if self.headers or self.window.meets(r["y0"], r["x0"], r["rows"], r["cols"])]
        else:
            every = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root, recursive=True))
            name = lambda f: f.path.rpartition("/")[2]
            found = [(f.path, re.sub(r"\.[^.]*$", "", name(f)), f.size) for f in every if f.type == pafs.FileType.File and name(f)[0] not in "._" and not name(f).lower().endswith(".hdr")]
        parts = [(p, r, 1 if self.headers else max(1, -(-size // self.split))) for p, r, size in sorted(found)]
        return [Share(p, r, k, n) for p, r, n in parts for k in range(n)] or [Share("", "", 0, 0)]

    def blocks(self, part: Share, layout: Layout, size: int) -> list[Block]:
        """The blocks of a share that meet the window: no bytes of others are fetched."""
        w, out = self.window, []
        for b in layout.blocks:
            mine = min(part.n - 1, b.offset * part.n // max(1, size)) == part.k
            if mine and w.meets(layout.y0 + b.y, layout.x0 + b.x, b.rows, b.cols) and (w.bands is None or b.band is None or b.band in w.bands):
                out.append(b)
        return out

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        store, _ = place(self.options["path"])
        layout, size = layout_of(store, part.path), store.get_file_info(part.path).size
        if self.headers:
            row = [[part.raster], [part.path], [layout.rows], [layout.cols], [layout.bands], [layout.kind.name], [layout.y0], [layout.x0], [layout.transform], [layout.nodata], [len(layout.blocks)]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [c.split()[0] for c in HEADER_SCHEMA.split(", ")])
            return
        with store.open_input_file(part.path) as file:
            for b in self.blocks(part, layout, size):
                yield from self.pixels(part.raster, layout, b, np.frombuffer(file.read_at(b.size, b.offset), layout.kind))

    def pixels(self, raster: str, layout: Layout, b: Block, samples: np.ndarray) -> Iterator[pa.RecordBatch]:
        each = 1 if b.band is not None else layout.bands
        some = samples[: b.stored * each * (len(samples) // (b.stored * each))].reshape(-1, b.stored * each)[: b.rows]
        cube = some.reshape(-1, each, b.stored) if b.order == "bil" else np.moveaxis(some.reshape(-1, b.stored, each), 2, 1)
        for k in range(each):
            band = k if b.band is None else b.band
            if self.window.bands is not None and band not in self.window.bands:
                continue
            step = max(1, BATCH // b.cols)
            for y in range(0, len(cube), step):
                v = cube[y : y + step, k, : b.cols].astype(np.float64).ravel()
                none = np.isnan(v) | (v == layout.nodata if layout.nodata is not None else False)
                n = len(v)
                rows = np.repeat(np.arange(y, y + n // b.cols), b.cols) + layout.y0 + b.y
                cols = np.tile(np.arange(b.cols), n // b.cols) + layout.x0 + b.x
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(raster), n), pa.array(np.full(n, band, np.int32)), pa.array(rows), pa.array(cols), pa.array(v, mask=none)], ["raster", "band", "y", "x", "v"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple]  # name, y0, x0, rows, cols, bytes


class RasterWriter(DataSourceArrowWriter):
    """Rows (ty, tx, band, y, x, v) in order of tiles; see :func:`write`."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        (store, root), tile, kind = place(o["path"]), int(o["tile"]), np.dtype(o["kind"])
        nodata = float(o["nodata"]) if "nodata" in o else None
        transform = [float(x) for x in o["transform"].split(",")] if "transform" in o else None
        out, at, values, ends = [], None, None, None

        def flush() -> None:
            if at is None:
                return
            (low_y, high_y), (low_x, high_x) = ends
            found = values[:, low_y : high_y + 1, low_x : high_x + 1]
            found = np.where(found == -np.inf, np.nan if nodata is None else nodata, found).astype(kind)
            name, y0, x0 = f"{at[0]}_{at[1]}-{uuid.uuid4().hex}.tif", int(at[0] * tile + low_y), int(at[1] * tile + low_x)
            size = 0
            with store.open_output_stream(f"{root}/{name}") as file:
                for piece in tiff_bytes(found, y0, x0, transform, nodata):
                    file.write(piece)
                    size += len(piece)
            out.append((name, y0, x0, *found.shape[1:], size))

        for batch in iterator:
            ty, tx = (batch.column(c).to_numpy() for c in ("ty", "tx"))
            band, y, x, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "y", "x", "v"))
            cuts = np.flatnonzero((np.diff(ty) != 0) | (np.diff(tx) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ty)]):
                if lo == hi:
                    continue
                if at != (ty[lo], tx[lo]):
                    flush()
                    at, values = (ty[lo], tx[lo]), np.full((int(o["bands"]), tile, tile), -np.inf)  # whatever the rows, one tile is held
                    ends = [[tile, 0], [tile, 0]]
                inner = y[lo:hi] - at[0] * tile, x[lo:hi] - at[1] * tile
                np.maximum.at(values, (band[lo:hi], *inner), np.where(np.isnan(v[lo:hi]), -np.inf, v[lo:hi]))
                ends = [[min(e[0], int(k.min())), max(e[1], int(k.max()))] for e, k in zip(ends, inner)]
        flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place(self.options["path"])
        rows = sorted(f for m in messages if m for f in m.files)
        names = ("name", "y0", "x0", "rows", "cols", "bytes")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{INDEX}") as file:
            pq.write_table(pa.table({n: pa.array([r[k] for r in rows], pa.string() if not k else pa.int64()) for k, n in enumerate(names)}), file)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = place(self.options["path"])
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{root}/{f[0]}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return HEADER_SCHEMA if str(self.options.get("headers", "false")).lower() == "true" else SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("raster")`` known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pixels (raster, band, y, x, v) of a file, or of all below a folder; NULL where a file has no data."""
    register(spark)
    return spark.read.format("raster").options(path=path, **options).load()


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: shape, bands, sample type, origin, transform, no-data value and number of blocks."""
    register(spark)
    return spark.read.format("raster").options(path=path, headers="true").load()


def write(px: DataFrame, path: str, kind: str = "float32", tile: int = TILE, bands: int = 1, transform: list[float] | None = None, nodata: float | None = None) -> None:
    """Pixels (y, x, v and, with several bands, band) as one TIFF a tile and an index below a new folder.

    Whole-number kinds need a ``nodata`` value for pixels that are NULL or absent inside a tile; NaN does it for real ones.
    Values that ``kind`` can't hold raise. NULL places are left out; negative places raise, as files can't hold them.
    """
    whole = np.dtype(kind).kind != "f"
    if whole and nodata is None:
        raise ValueError("whole-number samples need a no-data value")
    spark = px.sparkSession
    store, root = place(path)
    if store.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    register(spark)
    store.create_dir(root, recursive=True)
    band = F.col("band").cast("int") if "band" in px.columns else F.lit(0)
    cell = lambda c: F.floor(F.col(c) / tile).cast("long").alias(f"t{c}")
    v = F.col("v").cast("double")
    fits = F.lit(True)
    if whole:
        limits = np.iinfo(kind)
        fits = v.isNull() | F.isnan(v) | ((v >= float(limits.min)) & (v <= float(limits.max)))
    ok = fits & (F.col("y") >= 0) & (F.col("x") >= 0) & (band >= 0) & (band < bands)
    checked = F.when(ok, v).otherwise(F.raise_error(F.lit("a value, place or band doesn't fit the raster")).cast("double"))
    rows = px.filter("y is not null and x is not null").select(cell("y"), cell("x"), band.alias("band"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), checked.alias("v"))
    options = {"path": path, "kind": kind, "tile": tile, "bands": bands}
    options |= {"transform": ",".join(map(repr, transform))} if transform else {}
    options |= {"nodata": nodata} if nodata is not None else {}
    rows.repartition("ty", "tx").sortWithinPartitions("ty", "tx").write.format("raster").options(**options).mode("append").save()
