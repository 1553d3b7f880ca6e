"""Tables in and out: CSV, GeoJSON, JSON records and polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAFFIC_FIELDS = "latitude DOUBLE, longitude DOUBLE, density BIGINT, intensity DECIMAL(10,4), intensity_normalized DECIMAL(10,4)"
REQUIRED = ("latitude", "longitude", "density", "intensity")
NAME_FIELDS = ("name", "NAME", "ADMIN", "country")


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED, source: str = "input") -> DataFrame:
    """df itself, or an error that lists the missing columns in order, before any job runs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{source} lacks required columns: {missing}")
    return df


def read_categories(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One frame of all categories' CSV files, with their category; rows with too few fields are dropped."""
    frames = [spark.read.schema(TRAFFIC_FIELDS).option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(p).withColumn("category", F.lit(c)) for c, p in paths.items()]
    return reduce(DataFrame.unionByName, frames)


def write_traffic(points: DataFrame, path: str) -> None:
    """CSV by category with four decimals and whole densities."""
    four = lambda c: F.col(c).cast("decimal(10,4)").alias(c)
    points.select(four("latitude"), four("longitude"), F.col("density").cast("long").alias("density"), four("intensity"), four("intensity_normalized"), "category").write.mode("overwrite").partitionBy("category").option("header", True).csv(path)


def feature(lon: Column, lat: Column, properties: list[str]) -> Column:
    """A GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_features(df: DataFrame, path: str, properties: list[str], lon: str = "lon_bin", lat: str = "lat_bin") -> None:
    """One feature to a line, written by all tasks."""
    df.select(feature(F.col(lon), F.col(lat), properties).alias("value")).write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, properties: list[str], lon: str = "lon_bin", lat: str = "lat_bin", most: int = 500_000) -> str:
    """A bounded result as one FeatureCollection."""
    rows = df.select(feature(F.col(lon), F.col(lat), properties).alias("f")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many features for one document: write them a line each")
    return '{"type":"FeatureCollection","features":[' + ",".join(r["f"] for r in rows) + "]}"


def read_features(spark: SparkSession, path: str, properties: T.StructType, lines: bool = True) -> DataFrame:
    """Features of a collection, or of a file with one to a line, as (lon, lat, properties...)."""
    shape = T.StructType([T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])), T.StructField("properties", properties)])
    if lines:
        f = spark.read.schema(shape).json(path)
    else:
        whole = T.StructType([T.StructField("features", T.ArrayType(shape))])
        f = spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    return f.select(F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"), "properties.*")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(country, rings) of a polygon FeatureCollection; the name is the first present of NAME_FIELDS."""
    text = spark.read.option("wholetext", True).text(path)
    shape = "STRUCT<features: ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>>"
    f = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    name = F.coalesce(*[F.col("f.properties")[n] for n in NAME_FIELDS], F.get(F.map_values("f.properties"), F.lit(0)))
    one = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    out = f.select(name.alias("country"), F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).alias("rings"))
    if out.limit(1).count() == 0:
        raise ValueError("the boundary layer is empty")
    return out


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Grid, feature or coefficient tables as CSV with a header, JSON lines, or Parquet."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[fmt]()


def write_document(row: DataFrame, path: str) -> None:
    """A one-row metrics table as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
