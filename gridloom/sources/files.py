"""Project, polygon, world, sensor-model and point files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import zone_letter, zone_number

#: schema of the filter project; attributes carry a leading underscore
PROJECT = (
    "Output_Folder string, DSM_path string, Ortho_path string, Filtering_parameters struct<window_size:int,iteration_times:int,"
    "tile_size:struct<_tile_x_size:int,_tile_y_size:int,_overlap_size:int>,filtering_methods:string,"
    "common_paras:struct<_Std_color:double,_Std_distance:double,_Std_disparity:double>,"
    "patch_filter_paras:struct<_color_weight:double,_distance_weight:double,_disparity_weight:double>>"
)
METHODS = ("bilateral", "guided_image", "MLPA", "tree_filter", "guided_median", "local_patch")
ALIASES = {"patch_filtering": "local_patch"}


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """One row per filter project with flat column names; malformed files raise."""
    raw = spark.read.format("xml").option("rowTag", "Main_prj_file").option("mode", "FAILFAST").schema(PROJECT).load(path)
    p = "Filtering_parameters"
    method = F.col(f"{p}.filtering_methods")
    for alias, name in ALIASES.items():
        method = F.when(method == alias, name).otherwise(method)
    return raw.select(
        F.col("Output_Folder").alias("output_folder"), F.col("DSM_path").alias("dsm_path"), F.col("Ortho_path").alias("ortho_path"),
        F.col(f"{p}.window_size").alias("window_size"), F.col(f"{p}.iteration_times").alias("iterations"),
        F.col(f"{p}.tile_size._tile_x_size").alias("tile_x"), F.col(f"{p}.tile_size._tile_y_size").alias("tile_y"), F.col(f"{p}.tile_size._overlap_size").alias("overlap"),
        method.alias("method"),
        F.col(f"{p}.common_paras._Std_color").alias("std_color"), F.col(f"{p}.common_paras._Std_distance").alias("std_distance"), F.col(f"{p}.common_paras._Std_disparity").alias("std_disparity"),
        F.col(f"{p}.patch_filter_paras._color_weight").alias("color_weight"), F.col(f"{p}.patch_filter_paras._distance_weight").alias("distance_weight"), F.col(f"{p}.patch_filter_paras._disparity_weight").alias("disparity_weight"),
    )


def write_xml(df: DataFrame, path: str, root: str = "rows", row: str = "row") -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def read_kml_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Each file's polygon: vertices, box and mean height."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    lists = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<coordinates>\s*(.*?)\s*</coordinates>"), F.lit(1)))
    points = texts.select("path", lists.alias("c")).select("path", F.posexplode(F.split("c", r"\s+")).alias("n", "p"))
    xyz = F.split("p", ",")
    points = points.select("path", F.get(xyz, F.lit(0)).try_cast("double").alias("lon"), F.get(xyz, F.lit(1)).try_cast("double").alias("lat"), F.get(xyz, F.lit(2)).try_cast("double").alias("height"))
    return points.groupBy("path").agg(F.count("*").alias("points"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"), F.avg("height").alias("height"))


def read_kml_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Every polygon of each file, numbered in file order: its vertices without the closing one, its box, mean height, the UTM zone of
    the box's middle and, of quadrilaterals, the four corners. Vertices without two numbers are left out."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    lists = F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<coordinates>\s*(.*?)\s*</coordinates>"), F.lit(1))).alias("polygon", "c")
    number = lambda p, k: F.get(F.split(p, ","), F.lit(k)).try_cast("double")
    vertex = F.transform(F.split("c", r"\s+"), lambda p: F.struct(number(p, 0).alias("lon"), number(p, 1).alias("lat"), number(p, 2).alias("height")))
    rows = texts.select("path", lists).select("path", "polygon", F.filter(vertex, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()).alias("v"))
    closed = (F.size("v") > 1) & F.get("v", F.lit(0)).eqNullSafe(F.get("v", F.size("v") - 1))
    rows = rows.withColumn("v", F.when(closed, F.slice("v", F.lit(1), F.size("v") - 1)).otherwise(F.col("v")))
    heights = F.filter(F.col("v.height"), lambda h: h.isNotNull())
    mean = F.try_divide(F.aggregate(heights, F.lit(0.0), lambda s, h: s + h), F.size(heights).cast("double"))
    rows = rows.select(
        "path", "polygon", F.col("v").alias("vertices"), F.array_min("v.lon").alias("min_lon"), F.array_min("v.lat").alias("min_lat"), F.array_max("v.lon").alias("max_lon"), F.array_max("v.lat").alias("max_lat"),
        mean.alias("height"), F.when(F.size("v") == 4, F.col("v")).alias("corners"),
    )
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    return rows.withColumn("zone", F.concat(zone_number(lat, lon).cast("string"), zone_letter(lat)))


def read_world_file(spark: SparkSession, path: str) -> DataFrame:
    """The six numbers of each world file, in file order."""
    v = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), *[F.get(v, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("ABCDEF")])


#: names of a rational model's scalar fields, in the order of the text form
RPC_SCALARS = ("line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale")
RPC_ARRAYS = ("line_num", "line_den", "samp_num", "samp_den")


def read_rpc_text(spark: SparkSession, path: str) -> DataFrame:
    """Rational sensor models in ``NAME: value`` form, coefficients numbered from 1."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.upper("value").alias("t"))
    number = r"\s*[:=]\s*([+-]?[0-9.]+(?:E[+-]?[0-9]+)?)"
    scalar = lambda n: F.nullif(F.regexp_extract("t", n.upper() + number, 1), F.lit("")).try_cast("double").alias(n)
    array = lambda n: F.transform(F.regexp_extract_all("t", F.lit(f"{n.upper()}_COEFF?_[0-9]+{number}"), F.lit(1)), lambda x: x.try_cast("double")).alias(n)
    return texts.select("path", *[scalar(n) for n in RPC_SCALARS], *[array(n) for n in RPC_ARRAYS])


def write_rpc_text(models: DataFrame, path: str) -> None:
    """One text row per model, in the form that :func:`read_rpc_text` reads."""
    lines = [F.concat(F.lit(n.upper() + ": "), F.col(n).cast("string")) for n in RPC_SCALARS]

    def coefficients(name: str):
        return F.array_join(F.transform(name, lambda v, i: F.concat(F.lit(f"{name.upper()}_COEFF_"), (i + 1).cast("string"), F.lit(": "), v.cast("string"))), "\n")

    arrays = [coefficients(n) for n in RPC_ARRAYS]
    models.select(F.concat_ws("\n", *lines, *arrays).alias("value")).write.text(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Feature points, two numbers a line."""
    v = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).select(F.get(v, F.lit(0)).try_cast("double").alias("x"), F.get(v, F.lit(1)).try_cast("double").alias("y")).dropna()


def write_tracks(tracks: DataFrame, path: str) -> None:
    tracks.write.option("header", True).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder and name of every file below a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    parts = F.split("path", r"[\\/]")
    return found.select("path", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), "length")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def file_name(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def folder_name(path: Column) -> Column:
    """A path without its last part; the path itself if it has only one."""
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """path, section, key, value of each setting; the last one of a key counts, as do values before any section
    (section ""). Comments begin with ; or #. Reading writes nothing back: give defaults with :func:`setting`."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n|\r")).alias("n", "line"))
    section = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]*)\]", 1), F.lit(""))
    key = F.trim(F.regexp_extract("line", r"^\s*([^;#\[=][^=]*)=", 1))
    value = F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    rows = lines.select("path", "n", section.alias("head"), key.alias("key"), value.alias("value"))
    within = Window.partitionBy("path").orderBy("n")  # a file's lines; a settings file is small
    rows = rows.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(within), F.lit(""))).filter("key <> ''")
    return rows.groupBy("path", "section", "key").agg(F.max_by("value", "n").alias("value"))


def setting(settings: DataFrame, section: str, key: str, default: str) -> str:
    row = settings.filter((F.col("section") == section) & (F.col("key") == key)).select("value").first()
    return default if row is None else row[0]


#: fields of a matching project, in any case and order; fixed names
MATCHING_PROJECT = {
    "img_rpb_folder_path": "string", "AOI_kml_path": "string", "AOI_cutting_extra_size": "int", "Plane_rectification_tile_size": "int", "Plane_rectification_overlap_size": "int",
    "Pair_overlap_area": "double", "mch_win_size": "int", "mch_epi_stepH": "double", "mch_epi_search_range": "int",
}


def read_matching_project(spark: SparkSession, path: str) -> DataFrame:
    """One row per matching project: elements or "name = value" lines by the field's name; absent or
    malformed ones are NULL."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def field(name: str, kind: str) -> Column:
        element = F.nullif(F.trim(F.regexp_extract("value", rf"(?is)<\s*{name}\s*>(.*?)</\s*{name}\s*>", 1)), F.lit(""))
        line = F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^\s*{name}\s*[=:]([^\r\n]*)$", 1)), F.lit(""))
        return F.coalesce(element, line).try_cast(kind).alias(name)

    return texts.select("path", *[field(n, k) for n, k in MATCHING_PROJECT.items()])


def read_rpc_rpb(spark: SparkSession, path: str) -> DataFrame:
    """Rational sensor models in "name = value;" form with coefficient lists in brackets."""
    names = dict(zip(RPC_SCALARS, ("lineOffset", "sampOffset", "latOffset", "longOffset", "heightOffset", "lineScale", "sampScale", "latScale", "longScale", "heightScale")))
    lists = dict(zip(RPC_ARRAYS, ("lineNumCoef", "lineDenCoef", "sampNumCoef", "sampDenCoef")))
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("t"))
    scalar = lambda n: F.nullif(F.regexp_extract("t", rf"(?i)\b{names[n]}\s*=\s*({number})", 1), F.lit("")).try_cast("double").alias(n)
    array = lambda n: F.transform(F.regexp_extract_all(F.regexp_extract("t", rf"(?is)\b{lists[n]}\s*=\s*\((.*?)\)", 1), F.lit(f"({number})"), F.lit(1)), lambda x: x.try_cast("double")).alias(n)
    return texts.select("path", *[scalar(n) for n in RPC_SCALARS], *[array(n) for n in RPC_ARRAYS])


def write_rpc_rpb(models: DataFrame, path: str) -> None:
    """One text row per model, in the form that :func:`read_rpc_rpb` reads."""
    names = ("lineOffset", "sampOffset", "latOffset", "longOffset", "heightOffset", "lineScale", "sampScale", "latScale", "longScale", "heightScale")
    lists = ("lineNumCoef", "lineDenCoef", "sampNumCoef", "sampDenCoef")
    scalars = [F.concat(F.lit(f"\t{n} = "), F.col(c).cast("string"), F.lit(";")) for c, n in zip(RPC_SCALARS, names)]
    arrays = [F.concat(F.lit(f"\t{n} = (\n\t\t\t"), F.array_join(F.transform(c, lambda v: v.cast("string")), ",\n\t\t\t"), F.lit(");")) for c, n in zip(RPC_ARRAYS, lists)]
    models.select(F.concat_ws("\n", F.lit("BEGIN_GROUP = IMAGE"), *scalars, *arrays, F.lit("END_GROUP = IMAGE"), F.lit("END;")).alias("value")).write.text(path)


def raster_info(px: DataFrame, *by: str) -> DataFrame:
    """Rows, columns, pixels, values, and the least number of bits (8, 16, 32 for whole numbers, 64 otherwise) of a raster in pixel form, per group."""
    whole = F.bool_and(F.col("v") == F.floor("v"))
    bits = F.when(whole & (F.min("v") >= 0) & (F.max("v") < 256), 8).when(whole & (F.min("v") >= 0) & (F.max("v") < 65536), 16).when(whole & (F.max(F.abs("v")) < 2**31), 32).otherwise(64)
    return px.groupBy(*by).agg((F.coalesce(F.max("y"), F.lit(-1)) + 1).cast("long").alias("rows"), (F.coalesce(F.max("x"), F.lit(-1)) + 1).cast("long").alias("cols"), F.count("*").alias("pixels"), F.count("v").alias("values"), F.when(F.count("v") > 0, bits).alias("bits"))


def copy_geo(images: DataFrame, source: DataFrame) -> DataFrame:
    """``images`` (image, from, ...) with transform and projection of the image that ``from`` names in ``source``
    (image, transform, projection); NULL where it has none."""
    geo = source.select(F.col("image").alias("from"), "transform", "projection")
    return images.drop("transform", "projection").join(geo, "from", "left")
