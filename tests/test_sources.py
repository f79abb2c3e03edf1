"""Readers and writers on small files, and the command line on a small project."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom import __main__ as cli
from gridloom.functions import geodesy, xmltext
from gridloom.operators import postfilter
from gridloom.sources import files, rasterfile, storage


def test_settings(spark, tmp_path):
    (tmp_path / "a.ini").write_text("top = 1\n[One]\r\nkey = a = b\n; no = x\n# no = y\nkey2=\n\n[Two]\nkey= 7 \n[One]\nkey = last\n")
    got = files.read_ini(spark, str(tmp_path / "a.ini"))
    assert {(r.section, r.key): r.value for r in got.collect()} == {("", "top"): "1", ("One", "key"): "last", ("One", "key2"): "", ("Two", "key"): "7"}
    assert files.setting(got, "Two", "key", "0") == "7" and files.setting(got, "Two", "none", "0") == "0"
    assert "none" not in (tmp_path / "a.ini").read_text()


def test_matching_project(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<prj><img_rpb_folder_path> C:/x </img_rpb_folder_path><mch_win_size>15</mch_win_size><mch_epi_stepH>2.5</mch_epi_stepH><Pair_overlap_area>x</Pair_overlap_area></prj>")
    (tmp_path / "q.txt").write_text("IMG_RPB_FOLDER_PATH = /data/y\r\nmch_epi_search_range: 9\n")
    got = {r.path[-5:]: r for r in files.read_matching_project(spark, str(tmp_path)).collect()}
    assert (got["p.xml"].img_rpb_folder_path, got["p.xml"].mch_win_size, got["p.xml"].mch_epi_stepH, got["p.xml"].Pair_overlap_area) == ("C:/x", 15, 2.5, None)
    assert (got["q.txt"].img_rpb_folder_path, got["q.txt"].mch_epi_search_range, got["q.txt"].mch_win_size) == ("/data/y", 9, None)


def test_sensor_models_in_brackets(spark, tmp_path):
    scalars = {n: 1.5 * k - 3 for k, n in enumerate(files.RPC_SCALARS)}
    lists = {n: [(-1) ** k * 10.0 ** (k % 7 - 5) for k in range(20)] for n in files.RPC_ARRAYS}
    model = spark.range(1).select(*[F.lit(v).alias(n) for n, v in scalars.items()], *[F.array(*[F.lit(x) for x in v]).alias(n) for n, v in lists.items()])
    files.write_rpc_rpb(model, str(tmp_path / "m"))
    r = files.read_rpc_rpb(spark, str(tmp_path / "m")).first()
    assert all(math.isclose(r[n], v) for n, v in scalars.items()) and all(r[n] == v for n, v in lists.items())


def test_text_rules_take_anything(spark):
    rows = [("&#1114112;&#xD800;&#0;&#65;&#x1F600;&#16777215;&#x0;",), ("99999999999px",), (None,), ("-1",), ("",), ("&#99999999999;",)]
    got = spark.createDataFrame(rows, "t string").select(xmltext.decode(F.col("t")), xmltext.int_attribute(F.col("t")), xmltext.unsigned_attribute(F.col("t")), xmltext.double_attribute(F.col("t")), geodesy.zone_prefix(F.col("t"))).collect()
    assert got[0][0] == "&#1114112;&#xD800;&#0;A\U0001f600&#16777215;&#x0;" and got[5][0] == "&#99999999999;"
    assert tuple(got[1])[1:] == (None, None, 99999999999.0, None) and tuple(got[2]) == (None,) * 5 and tuple(got[3])[1:3] == (-1, 4294967295) and tuple(got[4])[1:] == (None,) * 4
    marks = spark.createDataFrame([("\ufeffab",), ("ab",), (None,), ("",)], "t string").select(xmltext.skip_mark(F.col("t"))).collect()
    assert [r[0] for r in marks] == ["ab", "ab", None, ""]


def test_scratch_folders(spark):
    with storage.scratch(spark) as path:
        inside = storage.save(spark.range(3), "x")
        assert inside.count() == 3 and inside.inputFiles()[0].removeprefix("file://").startswith(path)
    outside = storage.save(spark.range(2), "y")
    storage.drop(spark, path)
    assert outside.count() == 2 and not outside.inputFiles()[0].removeprefix("file://").startswith(path)
    with pytest.raises(Exception):
        spark.read.parquet(path + "/x").count()


def test_command_line(spark, tmp_path):
    px = spark.range(400).select((F.col("id") / 20).cast("long").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.sin("id").alias("v"))
    px.write.parquet(f"{tmp_path}/dsm")
    px.select("y", "x", (F.col("v") * 9).alias("v")).write.parquet(f"{tmp_path}/image")
    (tmp_path / "p.xml").write_text(
        f"<Main_prj_file><Output_Folder>{tmp_path}/out</Output_Folder><DSM_path>{tmp_path}/dsm</DSM_path><Ortho_path>{tmp_path}/image</Ortho_path><Filtering_parameters><window_size>5</window_size><iteration_times>1</iteration_times>"
        '<tile_size tile_x_size="16" tile_y_size="16" overlap_size="4"/><filtering_methods>bilateral</filtering_methods><common_paras Std_color="-1" Std_distance="2" Std_disparity="-1"/><patch_filter_paras color_weight="0.3" distance_weight="0.3" disparity_weight="0.6"/></Filtering_parameters></Main_prj_file>'
    )
    cli.main(f"{tmp_path}/p.xml", spark)
    want = postfilter.apply(px, px.select("y", "x", (F.col("v") * 9).alias("v")), "bilateral", radius=2, iterations=1, tile=64, sigma_d=2.0)
    both = spark.read.parquet(f"{tmp_path}/out/filtered").join(want.withColumnRenamed("v", "w"), ["y", "x"])
    assert both.count() == 400 and both.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-9


def test_polygons(spark, tmp_path):
    """Two polygons of a file stay two; a quadrilateral has corners, whether closed or not."""
    text = "<kml><coordinates>\n 3,45,10 4,45,20 4,46,30 3,46,40 3,45,10 </coordinates><coordinates>9,60 x,1 10,61,5 9,62</coordinates><coordinates></coordinates></kml>"
    (tmp_path / "a.kml").write_text(text)
    a, b, c = files.read_kml_polygons(spark, str(tmp_path / "a.kml")).orderBy("polygon").collect()
    assert [tuple(v) for v in a.corners] == [(3.0, 45.0, 10.0), (4.0, 45.0, 20.0), (4.0, 46.0, 30.0), (3.0, 46.0, 40.0)] == [tuple(v) for v in a.vertices]
    assert (a.min_lon, a.min_lat, a.max_lon, a.max_lat, a.height, a.zone) == (3.0, 45.0, 4.0, 46.0, 25.0, "31T")
    assert len(b.vertices) == 3 and b.corners is None and b.height == 5.0 and b.zone == "32V"
    assert c.vertices == [] and c.zone is None and c.min_lon is None


def test_project_over_raster_files(spark, tmp_path):
    """A project whose model and image are raster files gives raster files; its tile's shape doesn't matter."""
    px = [(y, x, float((y * 7 + x * 3) % 11)) for y in range(20) for x in range(15)]
    for name in ("dsm", "ortho"):
        rasterfile.write(spark.createDataFrame(px, "y long, x long, v double"), f"{tmp_path}/{name}", kind="float64", tile=8, transform=[5.0, 2.0, 0.0, 9.0, 0.0, -2.0])
    got = []
    for k, tile in enumerate(((5, 9), (1000, 1000))):
        project = f'''<Main_prj_file><Output_Folder>{tmp_path}/out{k}</Output_Folder><DSM_path>{tmp_path}/dsm</DSM_path><Ortho_path>{tmp_path}/ortho</Ortho_path><Filtering_parameters><window_size>3</window_size><iteration_times>2</iteration_times><tile_size _tile_x_size="{tile[0]}" _tile_y_size="{tile[1]}" _overlap_size="1"></tile_size><filtering_methods>bilateral</filtering_methods><common_paras _Std_color="-1" _Std_distance="-1" _Std_disparity="-1"></common_paras><patch_filter_paras _color_weight="0.3" _distance_weight="0.3" _disparity_weight="0.6"></patch_filter_paras></Filtering_parameters></Main_prj_file>'''
        (tmp_path / f"p{k}.xml").write_text(project)
        cli.main(f"{tmp_path}/p{k}.xml", spark)
        got.append(sorted((r.y, r.x, r.v) for r in rasterfile.read(spark, f"{tmp_path}/out{k}/filtered").collect()))
    assert got[0] == got[1] and len(got[0]) == 300 and [r[:2] for r in got[0]] == sorted(r[:2] for r in px)
    assert {tuple(r.transform) for r in rasterfile.headers(spark, f"{tmp_path}/out0/filtered").filter("y0 = 0").collect()} == {(5.0, 2.0, 0.0, 9.0, 0.0, -2.0)}
