"""The fixed test tables as rasters, points and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster, sensor

HEIGHTS = "embeddings"
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def size(px: DataFrame) -> tuple[int, int]:
    """Height and width; 0, 0 for an empty raster."""
    last = px.agg(F.max("y"), F.max("x")).first()
    return tuple(0 if k is None else k + 1 for k in last)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("v") + 0.5) * 255).cast("double")))
    return dsm(spark, sf_dir).select("y", "x", v.alias("v"))


def u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = (F.col("y") * 64 + F.col("x")) % 97 == 0
    return dsm(spark, sf_dir).select("y", "x", F.when(hole, 0.0).otherwise(F.floor((F.col("v") + 0.6) * 1500).cast("double")).alias("v"))


def dsm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster one column further right, on another scale."""
    return dsm(spark, sf_dir).filter(F.col("x") >= 1).select("y", (F.col("x") - 1).alias("x"), (F.col("v") * 2 + 3).alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = ((k * 7919) % 16400).cast("double") / 100 - 80
    lon = ((k * 104729) % 36000).cast("double") / 100 - 180
    return table(spark, sf_dir, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))


def coo2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second matrix over the same cells: every other one, other values."""
    return table(spark, sf_dir, "lineitem").filter("l_linenumber % 2 = 0").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_discount").alias("v"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (a, b) of customers, one an order."""
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", k.alias("a"), (k + F.col("o_orderkey") % 7 * 211).alias("b"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.lit(1.0).alias("x0"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), F.col("l_extendedprice").alias("y"), F.col("l_returnflag").alias("g")
    )


def model(k: Column) -> Column:
    """A sensor model of number k: nearly affine, each with a viewing angle of its own."""
    angle = F.pmod(k, F.lit(7)).cast("double") - 3.0
    scalars = {"line_off": 5000.0 + k, "samp_off": 4000.0 - k, "lat_off": F.lit(0.0), "long_off": F.lit(0.0), "height_off": F.lit(100.0), "line_scale": F.lit(5000.0), "samp_scale": F.lit(4000.0), "lat_scale": F.lit(90.0), "long_scale": F.lit(180.0), "height_scale": F.lit(300.0)}
    row = lambda *first: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in first], *[F.lit(0.0005)] * (20 - len(first)))
    lists = {"line_num": row(0.01, 0.02, 1.0, angle * 0.02, 0.003), "line_den": row(1.0, 0.001, 0.002, 0.001), "samp_num": row(0.02, 1.0, 0.03, F.pmod(k, F.lit(5)) * 0.03 - 0.06, 0.002), "samp_den": row(1.0, -0.002, 0.001, 0.001)}
    return F.struct(*[v.cast("double").alias(n) for n, v in scalars.items()], *[v.alias(n) for n, v in lists.items()])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each nation: 10,000 rows of 8,000 columns."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("image"), model(k).alias("model"), F.lit(10_000).alias("rows"), F.lit(8_000).alias("cols"))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with heights, kept off the rim of what the models cover."""
    return points(spark, sf_dir).select(F.col("id").alias("point"), (F.col("lat") * 0.8).alias("lat"), (F.col("lon") * 0.8).alias("lon"), (F.col("id") % 400 - 50).cast("double").alias("height"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point is seen by three or four images."""
    k = F.col("c_custkey")
    seen = F.array_distinct(F.array(k % 25, (k + 7) % 25, (k * 3 + 11) % 25, (k + 16) % 25))
    return table(spark, sf_dir, "customer").select(k.alias("point"), F.explode(seen.cast("array<int>")).alias("image"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor.observed(ground(spark, sf_dir), images(spark, sf_dir).select("image", "model"), sightings(spark, sf_dir))


#: the same views for the SQL twins
SQL = {
    "dsm": "dsm AS (SELECT vec_id AS y, i - 1 AS x, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))",
    "gray": "gray AS (SELECT y, x, least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((v + 0.5::DOUBLE) * 255))) AS v FROM dsm)",
    "u16": "u16 AS (SELECT y, x, CASE WHEN (y * 64 + x) % 97 = 0 THEN 0.0::DOUBLE ELSE floor((v + 0.6::DOUBLE) * 1500) END AS v FROM dsm)",
    "dsm2": "dsm2 AS (SELECT y, x - 1 AS x, v * 2 + 3 AS v FROM dsm WHERE x >= 1)",
    "dims": "dims AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM dsm)",
    "pts": "pts AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 16400)::DOUBLE / 100 - 80 AS lat, ((c_custkey * 104729) % 36000)::DOUBLE / 100 - 180 AS lon FROM customer)",
    "ground": "ground AS (SELECT c_custkey AS point, (((c_custkey * 7919) % 16400)::DOUBLE / 100 - 80) * 0.8::DOUBLE AS lat, (((c_custkey * 104729) % 36000)::DOUBLE / 100 - 180) * 0.8::DOUBLE AS lon, (c_custkey % 400 - 50)::DOUBLE AS height FROM customer)",
    "seen": "seen AS (SELECT DISTINCT point, image FROM (SELECT c_custkey AS point, unnest([c_custkey % 25, (c_custkey + 7) % 25, (c_custkey * 3 + 11) % 25, (c_custkey + 16) % 25])::INT AS image FROM customer))",
    "coo": "coo AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem)",
    "coo2": "coo2 AS (SELECT l_suppkey AS i, l_partkey AS j, l_discount AS v FROM lineitem WHERE l_linenumber % 2 = 0)",
    "ls": "ls AS (SELECT 1.0::DOUBLE AS x0, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y, l_returnflag AS g FROM lineitem)",
}
