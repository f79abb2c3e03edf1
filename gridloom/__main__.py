"""``python -m gridloom PROJECT.xml``: filter an elevation model as a project file says.

The project names a model and an image, both raster files, folders of such files or Parquet tables of pixels (y, x, v),
and an output folder. The filtered model is written there as the model came: a Parquet table or a folder of raster
files (``filtered``). Of several bands the first counts. Settings of -1 mean the operator's defaults; the tile's
width and height only deal out the work, and its overlap is what the filter's reach asks for, so the result depends on none of them.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import postfilter, raster
from .sources import files, rasterfile, storage


def is_table(path: str) -> bool:
    """A Parquet file, or a folder of such (its index of raster files aside)."""
    store, at = rasterfile.place(path)
    info = store.get_file_info(at)
    if info.type != rasterfile.pafs.FileType.Directory:
        return path.lower().endswith(".parquet")
    return any(f.path.endswith(".parquet") and not f.path.endswith(rasterfile.INDEX) for f in store.get_file_info(rasterfile.pafs.FileSelector(at)))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    px = spark.read.parquet(path) if is_table(path) else rasterfile.read(spark, path).filter("band = 0")
    return px.select("y", "x", "v")


def filtered(spark: SparkSession, project: dict) -> DataFrame:
    """The filtered model of one row of :func:`gridloom.sources.files.read_project`; ValueError without a method."""
    given = {k: project[n] for k, n in (("sigma_c", "std_color"), ("sigma_d", "std_distance"), ("sigma_z", "std_disparity")) if project[n] is not None and project[n] >= 0}
    weights = tuple(project[n] for n in ("color_weight", "distance_weight", "disparity_weight"))
    given |= {"weights": weights} if None not in weights and min(weights) >= 0 else {}
    given |= {k: int(project[n]) for k, n in (("iterations", "iterations"), ("tile", "tile_x"), ("tile_y", "tile_y")) if project[n]}
    given |= {"radius": int(project["window_size"]) // 2} if project["window_size"] else {}
    dsm, image = (pixels(spark, project[n]) for n in ("dsm_path", "ortho_path"))
    return postfilter.apply(raster.unique(dsm), raster.unique(image), project["method"] or "", **given)


def main(path: str, spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.builder.getOrCreate()
    for row in files.read_project(spark, path).collect():  # a project file has one
        with storage.scratch(spark):
            out, found = f"{row['output_folder'].rstrip('/')}/filtered", filtered(spark, row.asDict())
            if is_table(row["dsm_path"]):
                found.write.parquet(out)
            else:
                head = rasterfile.headers(spark, row["dsm_path"]).orderBy("y0", "x0").first()
                t = head["transform"]
                whole = [t[0] - t[1] * head["x0"] - t[2] * head["y0"], t[1], t[2], t[3] - t[4] * head["x0"] - t[5] * head["y0"], t[4], t[5]] if t else None
                rasterfile.write(found, out, transform=whole)


if __name__ == "__main__":
    main(sys.argv[1])
