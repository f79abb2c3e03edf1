"""Raster files: written and read back, foreign layouts byte by byte, crops that fetch only their blocks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from gridloom.plans import views
from gridloom.sources import rasterfile as R

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.select("band", "y", "x", "v").collect())


def cube_rows(a, y0=0, x0=0):
    return sorted((b, y + y0, x + x0, None if np.isnan(v) else float(v)) for (b, y, x), v in np.ndenumerate(a.astype(float)))


@pytest.mark.parametrize("tile, kind", [(64, "float64"), (37, "float64"), (1024, "float32")])
def test_the_tables_raster_comes_back(spark, tmp_path, tile, kind):
    px = views.dsm(spark, SF)
    path = str(tmp_path / "dsm")
    R.write(px, path, kind=kind, tile=tile, transform=[100.0, 0.5, 0.0, 900.0, 0.0, -0.5])
    want = sorted((0, r.y, r.x, float(np.float32(r.v)) if kind == "float32" else r.v) for r in px.collect())
    assert rows(R.read(spark, path)) == want
    heads = R.headers(spark, path).collect()
    assert len(heads) == len({(r.y0, r.x0) for r in heads}) == -(-500 // tile) * -(-64 // tile)
    assert all(r.transform == [100 + 0.5 * r.x0, 0.5, 0.0, 900 - 0.5 * r.y0, 0.0, -0.5] and r.kind == kind for r in heads)


def test_a_crop_reads_only_its_files(spark, tmp_path):
    path = str(tmp_path / "dsm")
    R.write(views.dsm(spark, SF), path, kind="float64", tile=32)
    reader = R.RasterReader({"path": path})
    assert len(reader.partitions()) == 16 * 2
    filters = [GreaterThanOrEqual(("y",), 40), LessThan(("y",), 90), EqualTo(("x",), 5)]
    assert list(reader.pushFilters(filters)) == filters  # Spark evaluates them again
    assert len(reader.partitions()) == 2  # rows 32 to 95, columns 0 to 31
    crop = R.read(spark, path).filter("y >= 40 and y < 90 and x = 5")
    assert rows(crop) == sorted((0, r.y, r.x, r.v) for r in views.dsm(spark, SF).filter("y >= 40 and y < 90 and x = 5").collect())
    assert rows(R.read(spark, path, y0=40, y1=89, x0=5, x1=5).filter("x = 5 and y between 40 and 89")) == rows(crop)
    assert crop.rdd.getNumPartitions() == 2


def test_a_crop_fetches_only_its_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "STRIP_BYTES", 16 * 8)
    a = np.arange(100 * 16.0).reshape(1, 100, 16)
    (tmp_path / "a.tif").write_bytes(b"".join(R.tiff_bytes(a, 0, 0, None, None)))
    reader = R.RasterReader({"path": str(tmp_path), "split_bytes": "3000"})
    list(reader.pushFilters([In(("y",), (7, 9)), GreaterThanOrEqual(("v",), 0.0)]))
    parts = reader.partitions()
    store, path = R.place(parts[0].path)
    layout, size = R.layout_of(store, path), store.get_file_info(path).size
    assert len(parts) > 3 and len(layout.blocks) == 100
    assert sorted(b.y for p in parts for b in reader.blocks(p, layout, size)) == [7, 8, 9]
    found = np.concatenate([b.column("v").to_numpy() for p in parts for b in reader.read(p)])
    assert found.tolist() == a[0, 7:10].ravel().tolist()
    everything = R.RasterReader({"path": str(tmp_path), "split_bytes": "3000"})
    assert sorted(b.y for p in everything.partitions() for b in everything.blocks(p, layout, size)) == list(range(100))  # each block once


@pytest.mark.parametrize("planes", [True, False])
@pytest.mark.parametrize("kind, nodata", [("uint8", 7.0), ("int16", -5.0), ("uint16", None), ("int32", None), ("float32", None), ("float64", 2.0)])
def test_types_and_bands(spark, tmp_path, kind, nodata, planes):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 100, (3, 5, 4)).astype(kind)
    if kind == "float32":
        a[1, 2, 3] = np.nan
    (tmp_path / "x.tif").write_bytes(b"".join(R.tiff_bytes(a, 10, 20, None, nodata, planes)))
    want = np.where(a == nodata, np.nan, a) if nodata is not None else a
    assert rows(R.read(spark, str(tmp_path))) == cube_rows(want, 10, 20)
    assert rows(R.read(spark, str(tmp_path / "x.tif")).filter("band in (0, 2) and y = 11")) == [r for r in cube_rows(want, 10, 20) if r[0] != 1 and r[1] == 11]


def big_endian_tiles(a, tile, big):
    """A tiled TIFF by hand, Motorola byte order, classic or big."""
    a = a.astype(">u2")
    grid = [(y, x) for y in range(0, a.shape[0], tile) for x in range(0, a.shape[1], tile)]
    tiles = [np.pad(t := a[y : y + tile, x : x + tile], ((0, tile - t.shape[0]), (0, tile - t.shape[1]))).tobytes() for y, x in grid]
    word, size = ("Q", 8) if big else ("I", 4)
    entries = [(256, 3, [a.shape[1]]), (257, 3, [a.shape[0]]), (258, 3, [16]), (259, 3, [1]), (262, 3, [1]), (277, 3, [1]), (322, 3, [tile]), (323, 3, [tile]), (324, 16 if big else 4, None), (325, 4, [len(t) for t in tiles]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [1.0, 1.0, 0.0, 500.0, 800.0, 0.0])]
    head = struct.pack(">2sHHHQ", b"MM", 43, 8, 0, 16) if big else struct.pack(">2sHI", b"MM", 42, 8)
    base = len(head) + (8 if big else 2) + len(entries) * (20 if big else 12) + size
    code = {3: "H", 4: "I", 12: "d", 16: "Q"}
    extra, body = b"", b""
    blob = lambda t, v: struct.pack(f">{len(v)}{code[t]}", *v)
    first = base + sum(len(b) for t, k, v in entries if len(b := blob(k, v or [0] * len(tiles))) > size)
    entries[8] = (324, entries[8][1], [first + sum(map(len, tiles[:k])) for k in range(len(tiles))])
    for tag, kind, v in entries:
        b = blob(kind, v)
        cell = b.ljust(size, b"\0") if len(b) <= size else struct.pack(">" + word, base + len(extra))
        extra += b if len(b) > size else b""
        body += struct.pack(">HH" + word, tag, kind, len(v)) + cell
    return head + struct.pack(">Q" if big else ">H", len(entries)) + body + struct.pack(">" + word, 0) + extra + b"".join(tiles)


@pytest.mark.parametrize("big", [False, True])
def test_foreign_tiles(spark, tmp_path, big):
    a = np.arange(45 * 70).reshape(45, 70) % 60_000
    (tmp_path / "t.tiff").write_bytes(big_endian_tiles(a, 16, big))
    assert rows(R.read(spark, str(tmp_path), split_bytes=1500)) == cube_rows(a[None])
    (head,) = R.headers(spark, str(tmp_path)).collect()
    assert (head.rows, head.cols, head.blocks, head.raster, head.transform) == (45, 70, 15, "t", [498.0, 2.0, 0.0, 802.0, 0.0, -2.0])


@pytest.mark.parametrize("order, axes", [("bsq", (0, 1, 2)), ("bil", (1, 0, 2)), ("bip", (1, 2, 0))])
@pytest.mark.parametrize("place", ["a.img.hdr", "a.hdr"])
def test_raw_files(spark, tmp_path, monkeypatch, order, axes, place):
    a = np.random.default_rng(2).integers(-900, 900, (3, 11, 7)).astype(">i2")
    (tmp_path / "a.img").write_bytes(b"xyz" + a.transpose(axes).tobytes())
    (tmp_path / place).write_text(f"ENVI\ndescription = {{\n made = up }}\nsamples = 7\nlines = 11\nbands = 3\nheader offset = 3\ndata type = 2\ninterleave = {order}\nbyte order = 1\ndata ignore value = {a[0, 0, 0]}\nmap info = {{x, 1, 1, 5, 9, 2, 2}}\n")
    want = np.where(a == a[0, 0, 0], np.nan, a)
    assert rows(R.read(spark, str(tmp_path), split_bytes=100)) == cube_rows(want)
    assert R.headers(spark, str(tmp_path)).first().transform == [5.0, 2.0, 0.0, 9.0, 0.0, -2.0]


def test_odd_rasters(spark, tmp_path):
    shape = "y long, x long, v double, band int, Tile string"
    R.write(spark.createDataFrame([], shape), str(tmp_path / "none"), bands=2)
    assert R.read(spark, str(tmp_path / "none")).count() == 0 and R.headers(spark, str(tmp_path / "none")).count() == 0
    some = [(0, 0, 5.0, 0, "a"), (0, 0, 9.0, 0, "b"), (2, 1, None, 0, None), (1, 1, 3.0, 1, None), (None, 4, 1.0, 0, None), (70, 0, float("nan"), 0, "")]
    R.write(spark.createDataFrame(some, shape), str(tmp_path / "some"), kind="int16", nodata=-1.0, bands=2, tile=64)
    got = {r[:3]: r[3] for r in rows(R.read(spark, str(tmp_path / "some")))}
    assert {k: v for k, v in got.items() if v is not None} == {(0, 0, 0): 9.0, (1, 1, 1): 3.0} and (0, 70, 0) in got
    with pytest.raises(FileExistsError):
        R.write(spark.createDataFrame(some, shape), str(tmp_path / "some"), kind="int16", nodata=-1.0)
    with pytest.raises(ValueError):
        R.write(spark.createDataFrame(some, shape), str(tmp_path / "new"), kind="int16")
    for bad in [(0, 0, 300.0, 0, ""), (-1, 0, 3.0, 0, ""), (0, 0, 3.0, 1, "")]:
        with pytest.raises(Exception, match="doesn't fit"):
            R.write(spark.createDataFrame([bad], shape), str(tmp_path / f"bad{bad[0]}{bad[3]}{bad[2]}"), kind="uint8", nodata=0.0)
    (tmp_path / "junk.tif").write_bytes(b"II*\0")
    (tmp_path / "j").write_bytes(b"not a raster")
    for name in ("junk.tif", "j"):
        with pytest.raises(Exception):  # noqa: B017
            R.read(spark, str(tmp_path / name)).count()
    with pytest.raises(Exception, match="No such|FileNotFound|missing"):
        R.read(spark, str(tmp_path / "missing")).count()


def test_files_of_a_lost_attempt_are_not_read(spark, tmp_path):
    path = tmp_path / "dsm"
    R.write(views.dsm(spark, SF), str(path), tile=64)
    first = next(p for p in path.iterdir() if p.suffix == ".tif")
    (path / "0_0-other.tif").write_bytes(first.read_bytes())
    assert R.read(spark, f"file://{path}").count() == views.dsm(spark, SF).count()
    assert R.read(spark, str(path)).filter(F.col("y") < 0).count() == 0
