"""Input views that are derived from the test tables, as select lists that Spark and other SQL engines read alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 340, 720
NODATA = 2147483647
TILE = 100

TRAFFIC = [
    "CASE l_returnflag WHEN 'A' THEN 'commercial' WHEN 'N' THEN 'oil_gas' ELSE 'passenger' END AS category",
    "CAST(84.875 AS DOUBLE) - CAST(0.25 AS DOUBLE) * ((l_partkey * 37 + l_suppkey * 101 + l_linenumber) % 679) AS latitude",
    "CAST(-179.875 AS DOUBLE) + CAST(0.25 AS DOUBLE) * ((l_orderkey * 61 + l_linenumber * 17) % 1440) AS longitude",
    "CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS density",
    "CAST(round(log10(CAST(floor(l_extendedprice * l_quantity) AS DOUBLE) + 1), 4) AS DECIMAL(10,4)) AS intensity",
]
CLUSTERED = [
    "event_id",
    "CASE WHEN event_type = 'error' THEN CAST(-179.875 AS DOUBLE) + CAST(0.25 AS DOUBLE) * ((event_id * 61) % 1440) ELSE CAST(-165 AS DOUBLE) + 30 * (user_id % 12) + CAST(0.125 AS DOUBLE) * ((event_id * 7) % 64 - 32) END AS longitude",
    "CASE WHEN event_type = 'error' THEN CAST(-84.875 AS DOUBLE) + CAST(0.25 AS DOUBLE) * ((event_id * 37) % 679) ELSE CAST(-50 AS DOUBLE) + 20 * (user_id % 6) + CAST(0.125 AS DOUBLE) * ((event_id * 13) % 48 - 24) END AS latitude",
    "CAST(floor(value * 100) AS BIGINT) + 1 AS density",
    "CAST(round(log10(CAST(floor(value * 100) AS DOUBLE) + 2), 4) AS DECIMAL(10,4)) AS intensity",
]
# Points on pixels of 0.005 degrees: crowds around twelve places, and stray ones.
PIXELLED = [
    "CASE WHEN event_type = 'error' THEN CAST(-179.875 AS DOUBLE) + CAST(0.25 AS DOUBLE) * ((event_id * 61) % 1440) ELSE CAST(-165 AS DOUBLE) + 30 * (user_id % 12) + CAST(0.005 AS DOUBLE) * ((event_id * 7) % 24 - 12) + CAST(0.0025 AS DOUBLE) END AS longitude",
    "CASE WHEN event_type = 'error' THEN CAST(-84.875 AS DOUBLE) + CAST(0.25 AS DOUBLE) * ((event_id * 37) % 679) ELSE CAST(-50 AS DOUBLE) + 20 * (user_id % 6) + CAST(0.005 AS DOUBLE) * ((event_id * 13) % 24 - 12) + CAST(0.0025 AS DOUBLE) END AS latitude",
    "CAST(floor(value * 100) AS BIGINT) + 1 AS density",
    "CAST(round(log10(CAST(floor(value * 100) AS DOUBLE) + 2), 4) AS DECIMAL(10,4)) AS intensity",
]
PIXELS = [
    "CASE l_returnflag WHEN 'A' THEN 'commercial' WHEN 'N' THEN 'oil_gas' ELSE 'passenger' END AS category",
    f"CAST((l_partkey * 37 + l_suppkey * 101 + l_linenumber) % {HEIGHT} AS INT) AS row_id",
    f"CAST((l_orderkey * 61 + l_linenumber * 17) % {WIDTH} AS INT) AS col_id",
    f"CAST(CASE WHEN l_quantity <= 2 THEN {NODATA} WHEN l_quantity <= 30 THEN 0 ELSE floor(l_extendedprice * (l_quantity - 30)) END AS INT) AS value",
]
COUNTRIES = [
    "n_name AS country",
    "CAST(-175 AS DOUBLE) + 14 * n_nationkey AS lon0",
    "CAST(-161 AS DOUBLE) + 14 * n_nationkey AS lon1",
    "CAST(-60 AS DOUBLE) + 24 * (n_nationkey % 5) AS lat0",
    "CAST(-36 AS DOUBLE) + 24 * (n_nationkey % 5) AS lat1",
]
# The anchor coordinates.
ANCHORS = [
    ("strait", "Malacca", 101.0, 2.5), ("strait", "Hormuz", 56.2, 26.0), ("strait", "Suez", 32.6, 30.6), ("strait", "Gibraltar", -5.5, 35.95),
    ("strait", "English Channel", -0.9, 50.9), ("strait", "Taiwan", 120.7, 24.3), ("strait", "Bab-el-Mandeb", 40.2, 12.7),
    ("port", "Singapore", 103.8, 1.3), ("port", "Shanghai", 121.5, 31.2), ("port", "Rotterdam", 4.3, 51.9), ("port", "Jebel Ali", 55.3, 25.3),
    ("port", "New York", -74.0, 40.7), ("port", "Tokyo Bay", 139.8, 35.6), ("port", "Jakarta", 106.9, -6.1), ("port", "Mumbai", 72.9, 19.1),
    ("port", "Houston", -95.0, 29.7), ("port", "Lagos", 3.0, 6.4), ("port", "Cape Town", 18.4, -33.9), ("port", "Sydney", 151.2, -33.9),
]


def view(name: str) -> str:
    """The SQL of a derived view, as `name AS (...)`."""
    lists = {"traffic": (TRAFFIC, "lineitem"), "clustered": (CLUSTERED, "events"), "pixelled": (PIXELLED, "events"), "countries": (COUNTRIES, "nation")}
    if name == "pixels":
        return f"pixels AS (SELECT category, row_id, col_id, max(value) AS value FROM (SELECT {', '.join(PIXELS)} FROM lineitem) GROUP BY category, row_id, col_id)"
    columns, source = lists[name]
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*TRAFFIC)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*CLUSTERED)


def pixelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*PIXELLED)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*PIXELS).groupBy("category", "row_id", "col_id").agg(F.max("value").alias("value"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr(*COUNTRIES)


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles as polygons (country, rings)."""
    corners = [("lon0", "lat0"), ("lon1", "lat0"), ("lon1", "lat1"), ("lon0", "lat1"), ("lon0", "lat0")]
    ring = F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners])
    return rectangles(spark, sf_dir).select("country", F.array(ring).alias("rings"))


def raster_tiles(spark: SparkSession, sf_dir: str, tile: int = TILE) -> DataFrame:
    """Pixels as tiles with dense row-major arrays; null where the raster holds no pixel."""
    p = pixels(spark, sf_dir).withColumn("tile_row", F.floor(F.col("row_id") / tile).cast("int")).withColumn("tile_col", F.floor(F.col("col_id") / tile).cast("int"))
    p = p.withColumn("row_off", F.col("tile_row") * tile).withColumn("col_off", F.col("tile_col") * tile)
    p = p.withColumn("height", F.least(F.lit(tile), HEIGHT - F.col("row_off"))).withColumn("width", F.least(F.lit(tile), WIDTH - F.col("col_off")))
    at = (F.col("row_id") - F.col("row_off")) * F.col("width") + F.col("col_id") - F.col("col_off")
    keys = ["category", "tile_row", "tile_col", "row_off", "col_off", "height", "width"]

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = pdf.iloc[0]
        data = np.full(int(tile["height"] * tile["width"]), None, object)
        data[pdf["at"].to_numpy()] = pdf["value"].to_numpy()
        return pd.DataFrame([[*tile[keys], data]], columns=[*keys, "data"])

    schema = "category string, tile_row int, tile_col int, row_off int, col_off int, height int, width int, data array<int>"
    return p.select(*keys, at.cast("int").alias("at"), "value").groupBy(*keys).applyInPandas(dense, schema)


def raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of georeference for each category that occurs."""
    return pixels(spark, sf_dir).select("category").distinct().select("category", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(-180.0).alias("origin_x"), F.lit(85.0).alias("origin_y"), F.lit(0.5).alias("px"), F.lit(-0.5).alias("py"), F.lit(NODATA).alias("nodata"), F.lit("EPSG:4326").alias("crs"))


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANCHORS, "kind string, name string, lon double, lat double")


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, subcategories) with the subcategories as one string, parted by bars or line ends."""
    r, n = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    parted = F.when(F.size("names") % 2 == 0, F.concat_ws(" | ", "names")).otherwise(F.concat_ws("\n", "names"))
    return r.join(n, r["r_regionkey"] == n["n_regionkey"]).groupBy(F.col("r_name").alias("category")).agg(F.sort_array(F.collect_list("n_name")).alias("names")).select("category", parted.alias("subcategories"))
