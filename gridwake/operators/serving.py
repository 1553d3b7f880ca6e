"""Filters and documents that a map front end asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwake.functions.scalar import resolution_of, wrap_longitude

# The categories and their dataset classes.
CATEGORIES = ("commercial", "oil_gas", "passenger")
DATASET_CLASSES = {"global": "all_traffic", "commercial": "commercial_traffic", "oil_gas": "oil_gas_traffic", "passenger": "passenger_traffic"}


def in_categories(df: DataFrame, categories: list[str], column: str = "category") -> DataFrame:
    """Rows of the categories; an empty list matches nothing."""
    return df.where(F.col(column).isin(categories) if categories else F.lit(False))


def by_zoom(requests: DataFrame, layers: DataFrame) -> DataFrame:
    """Requests (request_id, zoom) joined with the layer of the resolution that the zoom asks for."""
    return requests.withColumn("resolution", resolution_of(F.col("zoom"))).join(layers, "resolution")


def active_categories(selections: DataFrame) -> DataFrame:
    """(request_id, category) from (request_id, category, selected, subcategories): selected, and global or with a subcategory."""
    return selections.where(F.col("selected") & ((F.col("category") == "global") | (F.col("subcategories") > 0))).select("request_id", "category")


def visible_hotspots(selections: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(request_id, hotspot columns): of the active categories, or of all three when global is active."""
    active = active_categories(selections)
    every = F.array(*[F.lit(c) for c in CATEGORIES])
    shown = active.withColumn("c", F.explode(F.when(F.col("category") == "global", every).otherwise(F.array("category")))).select("request_id", F.col("c").alias("category")).distinct()
    return shown.join(hotspots, "category")


def dataset_class(column: str = "top_category"):
    return F.create_map(*[F.lit(x) for kv in DATASET_CLASSES.items() for x in kv])[F.col(column)]


def hotspot_records(hotspots: DataFrame) -> DataFrame:
    """Rounded records (lat, lon, density, intensity, category)."""
    return hotspots.select(F.round("latitude", 5).alias("lat"), F.round("longitude", 5).alias("lon"), F.col("density").cast("long").alias("density"), F.round(F.col("intensity").cast("double"), 4).alias("intensity"), "category")


def hotspot_features(hotspots: DataFrame) -> DataFrame:
    """Hotspots with wrapped longitude as (lon_bin, lat_bin, top_category, dataset_class, density, intensity)."""
    return hotspots.select(F.round(wrap_longitude(F.col("longitude")), 6).alias("lon_bin"), F.round("latitude", 6).alias("lat_bin"), F.col("category").alias("top_category"), dataset_class("category").alias("dataset_class"), F.col("density").cast("long").alias("density"), F.col("intensity").cast("double").alias("intensity"))


def split_clusters(rows: DataFrame) -> DataFrame:
    """Add part: cluster or noise, from a cluster id of any type; what isn't a number is noise."""
    return rows.withColumn("part", F.when(F.coalesce(F.expr("try_cast(CAST(cluster_id AS STRING) AS INT)"), F.lit(-1)) >= 0, "cluster").otherwise("noise"))


def subcategories(taxonomy: DataFrame) -> DataFrame:
    """A row for each subcategory of a list parted by bars or line ends."""
    part = taxonomy.select("category", F.explode(F.split("subcategories", r"[|\n]")).alias("s")).select("category", F.trim("s").alias("subcategory"))
    return part.where("subcategory <> ''")


def payload_summary(features: DataFrame, sources: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row: categories, features by layer, source rows and subcategory counts, and all of it as a JSON document."""
    f = features.groupBy("resolution", "top_category").agg(F.count("*").alias("n"))
    a = f.agg(F.array_sort(F.collect_set("top_category")).alias("categories"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "resolution", "top_category"), "n")))).alias("feature_counts"), F.sum("n").alias("features"))
    s = sources.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "rows")))).alias("source_rows"))
    t = subcategories(taxonomy).groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("subcategory_counts"))
    return a.crossJoin(s).crossJoin(t).withColumn("document", F.to_json(F.struct("categories", "feature_counts", "source_rows", "subcategory_counts")))
