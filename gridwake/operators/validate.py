"""Data-quality reports on point tables, grids and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.operators.grid import exact_percentiles


def coordinate_errors(points: DataFrame, lon_upper_inclusive: bool = True) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    high = lon > 180 if lon_upper_inclusive else lon >= 180
    return points.agg(F.count("*").alias("rows"), F.count_if((lat < -90) | (lat > 90)).alias("invalid_lat"), F.count_if((lon < -180) | high).alias("invalid_lon"))


def point_diagnostics(points: DataFrame) -> DataFrame:
    """By category: rows, ranges, invalid coordinates, rows with any null, and percentiles of intensity."""
    lat, lon = F.col("latitude"), F.col("longitude")
    missing = F.lit(False)
    for c in points.columns:
        missing = missing | F.col(c).isNull()
    a = points.groupBy("category").agg(F.count("*").alias("rows"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.count_if((lat < -90) | (lat > 90)).alias("invalid_lat_rows"), F.count_if((lon < -180) | (lon > 180)).alias("invalid_lon_rows"), F.count_if(missing).alias("missing_rows"), F.min("density").alias("density_min"), F.max("density").alias("density_max"), F.min("intensity").cast("double").alias("intensity_min"), F.max("intensity").cast("double").alias("intensity_max"))
    return a.join(F.broadcast(exact_percentiles(points, "intensity", {"intensity_p95": 0.95, "intensity_p99": 0.99}, ["category"])), "category")


def summary_statistics(points: DataFrame) -> DataFrame:
    """Rows, range, mean, median, p95 and p99 of density and intensity for each category and for all as `global`."""
    both = points.withColumn("category", F.explode(F.array("category", F.lit("global"))))
    out = both.groupBy("category").agg(F.count("*").alias("rows"), *[f(F.col(v).cast("double")).alias(f"{v}_{n}") for v in ("density", "intensity") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    for v in ("density", "intensity"):
        out = out.join(F.broadcast(exact_percentiles(both, v, {f"{v}_median": 0.5, f"{v}_p95": 0.95, f"{v}_p99": 0.99}, ["category"])), "category")
    return out


def equal_width_histogram(points: DataFrame, bins: int = 60) -> DataFrame:
    """Counts of log10(density + 1) in equal bins between its extremes, by category; the last edge counts."""
    x = points.select("category", F.log10(F.col("density") + 1).alias("x"))
    lim = x.groupBy("category").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)).cast("int")
    return x.join(F.broadcast(lim), "category").groupBy("category", F.coalesce(b, F.lit(1)).alias("bin")).agg(F.count("*").alias("n"))


def seam_metrics(pixels: DataFrame, height: int, width: int, step: int = 256) -> DataFrame:
    """Mean absolute differences across the wrap edges and across every `step`th line, by category.

    Edge strips meet by an equi-join on the position that they face; inner seams compare a pixel with the one beside it.
    """
    strip = max(8, min(40, width // 30))
    p = pixels.select("category", "row_id", "col_id", F.col("value").cast("double").alias("v"))

    def edge(axis: str, across: str, length: int, name: str) -> DataFrame:
        far = p.where(F.col(axis) >= length - strip).select("category", across, (F.col(axis) - (length - strip)).alias(axis), F.col("v").alias("w"))
        return p.where(F.col(axis) < strip).join(far, ["category", across, axis]).groupBy("category").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias(name))

    def inner(axis: str, across: str, name: str) -> DataFrame:
        on = p.where((F.col(axis) % step == 0) & (F.col(axis) > 0))
        before = p.where((F.col(axis) + 1) % step == 0).select("category", across, (F.col(axis) + 1).alias(axis), F.col("v").alias("w"))
        return on.join(before, ["category", across, axis]).groupBy("category").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias(name))

    out = p.select("category").distinct()
    for d in (edge("col_id", "row_id", width, "left_right_diff"), edge("row_id", "col_id", height, "top_bottom_diff"), inner("col_id", "row_id", "vertical_seams"), inner("row_id", "col_id", "horizontal_seams")):
        out = out.join(F.broadcast(d), "category", "left")
    return out.na.fill(0.0)


def file_inventory(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """(name, present, mb) for the required files of a folder; only names and lengths are read."""
    from pyspark.sql.types import StringType

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    sizes = found.groupBy("name").agg(F.sum("length").alias("length"))
    return spark.createDataFrame(required, StringType()).toDF("name").join(sizes, "name", "left").select("name", F.col("length").isNotNull().alias("present"), F.round(F.col("length") / (1024 * 1024), 3).alias("mb"))


def missing_files(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    return file_inventory(spark, folder, required).where(~F.col("present")).select("name")


def json_profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document and top-level key: the value's kind, and its scalar, list length or number of keys."""
    keys = docs.select(id_col, text_col, F.explode(F.json_object_keys(text_col)).alias("key"))
    parsed = keys.withColumn("value", F.from_json(F.col(text_col), "map<string,string>")[F.col("key")])
    kind = F.when(F.col("value").isNull(), "null").when(F.json_object_keys("value").isNotNull(), "object").when(F.json_array_length("value").isNotNull(), "array").when(F.col("value").isin("true", "false"), "boolean").when(F.expr("try_cast(value AS DOUBLE)").isNotNull(), "number").otherwise("string")
    size = F.coalesce(F.json_array_length("value"), F.size(F.json_object_keys("value")))
    return parsed.select(id_col, "key", kind.alias("kind"), F.when(kind.isin("array", "object"), size).cast("int").alias("size"), F.when(~kind.isin("array", "object"), F.col("value")).alias("scalar"))


def density_tiers(points: DataFrame) -> DataFrame:
    """Rows of each category by the percentiles of density that they reach: 95, 98, 99, 99.5."""
    cut = F.broadcast(exact_percentiles(points, "density", {"p95": 0.95, "p98": 0.98, "p99": 0.99, "p995": 0.995}, ["category"]))
    v = F.col("density")
    tier = F.when(v >= F.col("p995"), "p99.5").when(v >= F.col("p99"), "p99").when(v >= F.col("p98"), "p98").when(v >= F.col("p95"), "p95").otherwise("base")
    return points.join(cut, "category").withColumn("tier", tier).drop("p95", "p98", "p99", "p995")


def top_by(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= n)
