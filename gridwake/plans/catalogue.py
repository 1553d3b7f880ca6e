"""The registered queries: each applies an operator to whole tables, most with the same result in SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake import fixtures as fx
from gridwake.functions import scalar as fn
from gridwake.operators import autocorr, geo, grid, neighbors, pointpattern, raster, regression, serving, tiles, validate
from gridwake.sources import tables
from gridwake.tables import materialize, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
H, W, ND = fx.HEIGHT, fx.WIDTH, fx.NODATA
_E2 = fn.WGS84_E2
_E = _E2**0.5
_K0 = 0.75**0.5 / (1 - _E2 * 0.25) ** 0.5


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a function as a query; `sql` reads the named derived views."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            views_sql = ", ".join(fx.view(v) for v in views)
            # SQL that begins with a comma goes on with views of its own, some of them recursive.
            ORACLE[key] = f"WITH RECURSIVE {views_sql}{'' if sql.startswith(',') else ' '}{sql}" if views else sql
        return f

    return add


def _r(*columns: str, digits: int = 6):
    return [F.round(F.col(c).cast("double"), digits).alias(c) for c in columns]


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _cells(view: str, g: float, extra: str = "") -> str:
    """SQL of a grid aggregate named cells."""
    idx = f"CAST(floor((latitude + 90) / CAST({g} AS DOUBLE)) AS INT)", f"CAST(floor((longitude + 180) / CAST({g} AS DOUBLE)) AS INT)"
    return (
        f"cells AS (SELECT {extra} lat_idx, lon_idx, lat_idx * CAST({g} AS DOUBLE) - 90 + CAST({g} AS DOUBLE) / 2 AS lat_bin, lon_idx * CAST({g} AS DOUBLE) - 180 + CAST({g} AS DOUBLE) / 2 AS lon_bin, density_sum, intensity_sum, points, "
        f"CAST(density_sum AS DOUBLE) / points AS density_mean, intensity_sum / points AS intensity_mean FROM (SELECT {extra} {idx[0]} AS lat_idx, {idx[1]} AS lon_idx, CAST(sum(density) AS BIGINT) AS density_sum, CAST(sum(intensity) AS DOUBLE) AS intensity_sum, count(*) AS points FROM {view} GROUP BY ALL))"
    )


# ---- sources and sinks


@query("SELECT category, row_id, col_id, value FROM pixels", "pixels")
def a1_raster_windows(spark, d):
    return raster.tile_pixels(fx.raster_tiles(spark, d))


@query("SELECT category, latitude, longitude, density, CAST(intensity AS DOUBLE) AS intensity FROM traffic", "traffic")
def a2_a4_traffic_csv(spark, d):
    path = _folder(spark)
    tables.write_traffic(fx.traffic(spark, d).withColumn("intensity_normalized", F.lit(0)), path)
    cats = {c: f"{path}/category={c}" for c in serving.CATEGORIES}
    return tables.require_columns(tables.read_categories(spark, cats)).select("category", "latitude", "longitude", "density", F.col("intensity").cast("double").alias("intensity"))


@query(", " + _cells("traffic", 1.0) + " SELECT lon_bin AS lon, lat_bin AS lat, density_sum, points FROM cells", "traffic")
def a5_a6_feature_round_trip(spark, d):
    from pyspark.sql.types import LongType, StructField, StructType

    path = _folder(spark)
    tables.write_features(grid.aggregate_grid(fx.traffic(spark, d), 1.0), path, ["density_sum", "points"])
    return tables.read_features(spark, path, StructType([StructField("density_sum", LongType()), StructField("points", LongType())]))


@query(", " + _cells("traffic", 1.0) + " SELECT lat_bin, lon_bin, density_sum, points FROM cells", "traffic")
def a7_grid_csv(spark, d):
    path = _folder(spark)
    tables.write_table(grid.aggregate_grid(fx.traffic(spark, d), 1.0).select("lat_bin", "lon_bin", "density_sum", "points"), path)
    return spark.read.schema("lat_bin DOUBLE, lon_bin DOUBLE, density_sum BIGINT, points BIGINT").option("header", True).csv(path)


@query("SELECT category, count(*) AS n, CAST(sum(density) AS BIGINT) AS total FROM traffic GROUP BY category", "traffic")
def a8_records_json(spark, d):
    path = _folder(spark)
    tables.write_table(fx.traffic(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.sum("density").alias("total")), path, "json")
    return spark.read.schema("category STRING, n BIGINT, total BIGINT").json(path)


@query()
def a9_e12_file_inventory(spark, d):
    return validate.file_inventory(spark, d, ["lineitem.parquet", "nation.parquet", "events.parquet", "region.parquet", "traffic.csv"])


@query("SELECT country, 1 AS rings, 5 AS corners, lon0 AS west, lat0 AS south FROM countries", "countries")
def a10_country_polygons(spark, d):
    path = _folder(spark)
    c = fx.countries(spark, d)
    ring = F.transform(F.col("rings"), lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    features = c.select(F.struct(F.struct(F.col("country").alias("ADMIN")).alias("properties"), geometry.alias("geometry")).alias("f"))
    features.agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct("features")).alias("value")).coalesce(1).write.text(path)
    r = tables.read_countries(spark, path)
    return r.select("country", F.size("rings").alias("rings"), F.size(F.col("rings")[0]).alias("corners"), F.col("rings")[0][0]["lon"].alias("west"), F.col("rings")[0][0]["lat"].alias("south"))


# ---- projections and filters


@query(f"SELECT category, row_id, col_id, value FROM pixels WHERE value <> {ND} AND value > 0", "pixels")
def b1_valid_pixels(spark, d):
    return raster.with_traffic(fx.pixels(spark, d), ND)


@query(
    f", r AS (SELECT CAST(i * ({H} - 100) / CAST(4 AS DOUBLE) AS BIGINT) AS r0 FROM (SELECT unnest(range(5)) AS i)), c AS (SELECT CAST(floor(i * ({W} - 100) / CAST(4 AS DOUBLE)) AS BIGINT) AS c0 FROM (SELECT unnest(range(5)) AS i)) "
    f"SELECT category, CAST(r0 AS INT) AS win_row, CAST(c0 AS INT) AS win_col, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM pixels, r, c WHERE value <> {ND} AND row_id BETWEEN r0 AND r0 + 99 AND col_id BETWEEN c0 AND c0 + 99 GROUP BY ALL",
    "pixels",
)
def b2_window_sample(spark, d):
    s = raster.sample_windows(raster.valid(fx.pixels(spark, d), ND), H, W, 100, 5)
    return s.groupBy("category", "win_row", "win_col").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    f", o AS (SELECT * FROM pixels WHERE row_id = floor((floor(row_id * 34 / CAST(340 AS DOUBLE)) + 0.5) * 10) AND col_id = floor((floor(col_id * 72 / CAST(720 AS DOUBLE)) + 0.5) * 10)) SELECT category, count(*) AS valid, count(*) FILTER (WHERE value > 0) AS nonzero, round(count(*) FILTER (WHERE value > 0) / CAST(count(*) AS DOUBLE) * 100, 6) AS coverage_pct FROM o WHERE value <> {ND} GROUP BY category",
    "pixels",
)
def b3_overview_coverage(spark, d):
    return raster.coverage(raster.overview(fx.pixels(spark, d), H, W, 10), ND).select("category", "valid", "nonzero", *_r("coverage_pct"))


@query("SELECT category, row_id, col_id, -180 + (col_id + CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS longitude, 85 - (row_id + CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS latitude FROM pixels", "pixels")
def b4_pixel_to_lonlat(spark, d):
    return raster.to_lonlat(fx.pixels(spark, d), fx.raster_meta(spark, d)).select("category", "row_id", "col_id", "longitude", "latitude")


@query("SELECT category, latitude, longitude, density FROM (SELECT *, quantile_cont(CAST(density AS DOUBLE), 0.9) OVER (PARTITION BY category) AS p FROM traffic) WHERE density >= p", "traffic")
def b5_category_hotspots(spark, d):
    return raster.hotspots(fx.traffic(spark, d)).select("category", "latitude", "longitude", "density")


HOT = ", " + _cells("{v}", 0.5) + ", hot AS (SELECT *, row_number() OVER (ORDER BY round(intensity_sum, 4) DESC, lat_idx, lon_idx) AS hotspot_rank FROM cells WHERE density_sum >= (SELECT quantile_cont(CAST(density_sum AS DOUBLE), 0.95) FROM cells))"


def _hot(view: str) -> str:
    return HOT.replace("{v}", view)


@query(_hot("traffic") + " SELECT lat_bin, lon_bin, density_sum, round(intensity_sum, 4) AS intensity_sum, points, hotspot_rank FROM hot", "traffic")
def b6_d1_ranked_hotspots(spark, d):
    cells = grid.aggregate_grid(fx.traffic(spark, d), 0.5).withColumn("intensity_sum", F.round("intensity_sum", 4))
    return pointpattern.ranked_hotspots(cells).select("lat_bin", "lon_bin", "density_sum", "intensity_sum", "points", "hotspot_rank")


@query("SELECT category, density FROM traffic WHERE category IN ('commercial', 'passenger')", "traffic")
def b7_category_filter(spark, d):
    return serving.in_categories(fx.traffic(spark, d), ["commercial", "passenger"]).select("category", "density")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE latitude < -90 OR latitude > 90) AS invalid_lat, count(*) FILTER (WHERE longitude < -180 OR longitude >= 180) AS invalid_lon FROM traffic", "traffic")
def b9_coordinate_errors(spark, d):
    return validate.coordinate_errors(fx.traffic(spark, d), lon_upper_inclusive=False)


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN coalesce(try_cast(c AS INT), -1) >= 0 THEN 'cluster' ELSE 'noise' END AS part FROM (SELECT CASE user_id % 3 WHEN 0 THEN '-1' WHEN 1 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS c FROM events)) GROUP BY part")
def b10_cluster_split(spark, d):
    u = F.col("user_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.when(u % 3 == 0, "-1").when(u % 3 == 1, "x").otherwise(u.cast("string")).alias("cluster_id"))
    return serving.split_clusters(e).groupBy("part").agg(F.count("*").alias("n"))


@query(
    ", l AS (SELECT 'low' AS resolution, count(DISTINCT (floor(latitude + 90), floor(longitude + 180))) AS cells FROM traffic UNION ALL SELECT 'mid', count(DISTINCT (floor((latitude + 90) * 2), floor((longitude + 180) * 2))) FROM traffic UNION ALL SELECT 'high', count(DISTINCT (floor((latitude + 90) * 4), floor((longitude + 180) * 4))) FROM traffic) "
    "SELECT q.request_id, l.resolution, l.cells FROM (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 80 / CAST(10 AS DOUBLE) < 3.5 THEN 'low' WHEN c_custkey % 80 / CAST(10 AS DOUBLE) < 5.5 THEN 'mid' ELSE 'high' END AS resolution FROM customer) q JOIN l USING (resolution)",
    "traffic",
)
def b11_zoom_routing(spark, d):
    p = grid.pyramid(fx.traffic(spark, d), "density").where("top_category = 'global'").groupBy("resolution").agg(F.count("*").alias("cells"))
    q = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 80 / F.lit(10.0)).alias("zoom"))
    return serving.by_zoom(q, p).select("request_id", "resolution", "cells")


SELECTIONS = "s AS (SELECT c_custkey AS request_id, x.category, (c_custkey + x.i) % 3 = 0 AS selected, CAST((c_custkey * x.i) % 2 AS INT) AS subcategories FROM customer, (VALUES ('global', 0), ('commercial', 1), ('oil_gas', 2), ('passenger', 3)) AS x(category, i))"


@query(
    f", {SELECTIONS}, a AS (SELECT request_id, category FROM s WHERE selected AND (category = 'global' OR subcategories > 0)), v AS (SELECT DISTINCT request_id, c.category FROM a, (VALUES ('commercial'), ('oil_gas'), ('passenger')) AS c(category) WHERE a.category = 'global' OR a.category = c.category), h AS (SELECT category, count(*) AS n FROM traffic GROUP BY category) SELECT request_id, category, n FROM v JOIN h USING (category)",
    "traffic",
)
def b12_active_categories(spark, d):
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("i")) for i, c in enumerate(("global", *serving.CATEGORIES))])
    s = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("request_id"), F.explode(each).alias("x"))
    s = s.select("request_id", "x.category", ((F.col("request_id") + F.col("x.i")) % 3 == 0).alias("selected"), ((F.col("request_id") * F.col("x.i")) % 2).cast("int").alias("subcategories"))
    return serving.visible_hotspots(s, fx.traffic(spark, d).groupBy("category").agg(F.count("*").alias("n"))).select("request_id", "category", "n")


@query(f"SELECT category, count(*) FILTER (WHERE v = 0) AS zeros, CAST(sum(v) AS BIGINT) AS total FROM (SELECT category, CASE WHEN value < 50000 THEN 0 ELSE value END AS v FROM pixels WHERE value <> {ND}) GROUP BY category", "pixels")
def b13_threshold_to_zero(spark, d):
    x = raster.below_threshold_to_zero(raster.valid(fx.pixels(spark, d), ND), 50000)
    return x.groupBy("category").agg(F.count_if(F.col("value") == 0).alias("zeros"), F.sum("value").alias("total"))


@query(f", land AS (SELECT DISTINCT row_id, col_id FROM pixels WHERE (row_id * 7 + col_id) % 5 = 0) SELECT category, CASE WHEN l.row_id IS NULL THEN 'ocean' ELSE 'land' END AS kind, count(*) AS n FROM pixels p LEFT JOIN land l USING (row_id, col_id) WHERE value = 0 GROUP BY ALL", "pixels")
def b14_zero_kinds(spark, d):
    p = fx.pixels(spark, d)
    land = p.where((F.col("row_id") * 7 + F.col("col_id")) % 5 == 0).select("row_id", "col_id")
    return raster.zero_kinds(p, land, ND).groupBy("category", "kind").agg(F.count("*").alias("n"))


# ---- grids and aggregates


def _down(how: str) -> str:
    return f"SELECT category, CAST(row_id * 34 // 340 AS INT) AS row_id, CAST(col_id * 72 // 720 AS INT) AS col_id, CAST({how} AS BIGINT) AS value FROM pixels WHERE value <> {ND} GROUP BY 1, 2, 3"


@query(_down("round(sum(value) / CAST(count(*) AS DOUBLE))"), "pixels")
def c1_downsample_average(spark, d):
    return tiles.downsample(fx.raster_tiles(spark, d), H, W, 10, ND)


for _how in ("max", "min", "sum"):

    @query(_down(f"{_how}(value)"), "pixels", name=f"c2_downsample_{_how}")
    def _downsampled(spark, d, how=_how):
        return tiles.downsample(fx.raster_tiles(spark, d), H, W, 10, ND, how)


@query("SELECT event_id, CAST(x - 360 * floor((x + 180) / 360) AS DOUBLE) AS lon FROM (SELECT event_id, CAST(-900 AS DOUBLE) + (event_id * 7) % 1800 + CAST(0.25 AS DOUBLE) AS x FROM events)")
def c3_wrap_longitude(spark, d):
    x = F.lit(-900.0) + (F.col("event_id") * 7) % 1800 + 0.25
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fn.wrap_longitude(x).alias("lon"))


@query(", " + _cells("traffic", 1.0, "category,") + " SELECT category, lat_bin, lon_bin, density_sum, round(density_mean, 6) AS density_mean, round(intensity_sum, 4) AS intensity_sum, round(intensity_mean, 6) AS intensity_mean, points FROM cells", "traffic")
def c4_grid_aggregate(spark, d):
    return grid.aggregate_grid(fx.traffic(spark, d), 1.0, ["category"]).select("category", "lat_bin", "lon_bin", "density_sum", *_r("density_mean"), *_r("intensity_sum", digits=4), *_r("intensity_mean"), "points")


LAYERS = (
    ", base AS (SELECT * FROM traffic UNION ALL SELECT 'global', latitude, longitude, density, intensity FROM traffic), layer AS (SELECT resolution, grid_deg, category AS top_category, CAST(floor((latitude + 90) / grid_deg) AS INT) AS lat_idx, CAST(floor((longitude + 180) / grid_deg) AS INT) AS lon_idx, CAST(sum(density) AS DOUBLE) AS raw_weight, count(*) AS points "
    "FROM base, (VALUES ('low', CAST(1.0 AS DOUBLE)), ('mid', CAST(0.5 AS DOUBLE)), ('high', CAST(0.25 AS DOUBLE))) AS r(resolution, grid_deg) GROUP BY ALL)"
)


@query(LAYERS + " SELECT resolution, top_category, lat_idx, lon_idx, raw_weight, points FROM layer", "traffic")
def c7_pyramid(spark, d):
    return grid.pyramid(fx.traffic(spark, d), "density").select("resolution", "top_category", "lat_idx", "lon_idx", "raw_weight", "points")


WEIGHTED = LAYERS + ", w AS (SELECT *, CASE WHEN p99 > 0 THEN least(greatest(raw_weight / p99, 0), 1) ELSE least(greatest(raw_weight, 0), 1) END AS weight FROM (SELECT *, quantile_cont(raw_weight, 0.99) OVER (PARTITION BY resolution, top_category) AS p99 FROM layer))"


def _weighted(spark, d):
    # Cells and their percentiles both read the pyramid.
    return grid.normalised_by_p99(materialize(grid.pyramid(fx.traffic(spark, d), "density")), ["resolution", "top_category"])


@query(WEIGHTED + " SELECT resolution, top_category, lat_idx, lon_idx, round(weight, 6) AS weight, raw_weight, points FROM w WHERE weight >= 0.01", "traffic")
def c5_b8_normalised_layers(spark, d):
    return _weighted(spark, d).select("resolution", "top_category", "lat_idx", "lon_idx", *_r("weight"), "raw_weight", "points")


@query(", t AS (SELECT CAST(floor(latitude + 90) AS INT) AS i, CAST(floor(longitude + 180) AS INT) AS j, CAST(sum(density) AS DOUBLE) AS w FROM traffic GROUP BY 1, 2) SELECT i - 90 + CAST(0.5 AS DOUBLE) AS lat_bin, j - 180 + CAST(0.5 AS DOUBLE) AS lon_bin, round(w / (SELECT max(w) FROM t), 5) AS weight FROM t", "traffic")
def c6_heat_triples(spark, d):
    return grid.heat_triples(fx.traffic(spark, d), 1.0, "density")


@query(WEIGHTED + " SELECT resolution, top_category, count(*) AS n FROM w WHERE weight >= 0.01 GROUP BY ALL", "traffic")
def c8_feature_counts(spark, d):
    return _weighted(spark, d).groupBy("resolution", "top_category").agg(F.count("*").alias("n"))


@query("SELECT coalesce(category, 'global') AS category, count(*) AS rows FROM traffic GROUP BY ROLLUP (category)", "traffic")
def c9_source_rows(spark, d):
    return fx.traffic(spark, d).rollup("category").agg(F.count("*").alias("rows")).select(F.coalesce("category", F.lit("global")).alias("category"), "rows")


STATS = f"SELECT category, count(*) AS valid, count(*) FILTER (WHERE value = 0) AS zeros, count(*) FILTER (WHERE value > 0) AS nonzeros, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(CAST(value AS DOUBLE)), 4) AS std, round(count(*) FILTER (WHERE value = 0) / CAST(count(*) AS DOUBLE) * 100, 6) AS zero_pct, round(count(*) FILTER (WHERE value > 0) / CAST(count(*) AS DOUBLE) * 100, 6) AS nonzero_pct FROM pixels WHERE value <> {ND} GROUP BY category"


@query(STATS, "pixels")
def c10_raster_statistics(spark, d):
    return tiles.statistics(fx.raster_tiles(spark, d), ND).select("category", "valid", "zeros", "nonzeros", "min", "max", *_r("mean"), *_r("std", digits=4), *_r("zero_pct", "nonzero_pct"))


def _bins_sql(bins) -> str:
    rows = ", ".join(f"({lo}, {'NULL' if hi is None else hi}, '{label}')" for lo, hi, label in bins)
    return f", b AS (SELECT * FROM (VALUES {rows}) AS b(lo, hi, label)), t AS (SELECT category, count(*) AS all_n FROM pixels WHERE value <> {ND} GROUP BY category) SELECT t.category, b.label, count(p.value) AS n, round(count(p.value) / CAST(max(all_n) AS DOUBLE) * 100, 6) AS pct FROM t CROSS JOIN b LEFT JOIN pixels p ON p.category = t.category AND p.value <> {ND} AND p.value >= lo AND (hi IS NULL OR p.value < hi) GROUP BY t.category, b.label"


@query(_bins_sql(raster.HISTOGRAM), "pixels")
def c11_histogram(spark, d):
    return tiles.histogram(fx.raster_tiles(spark, d), ND).select("category", "label", "n", *_r("pct"))


@query(_bins_sql(raster.RANGES), "pixels")
def c12_exploration_ranges(spark, d):
    return tiles.histogram(fx.raster_tiles(spark, d), ND, raster.RANGES).select("category", "label", "n", *_r("pct"))


def _q(value: str, p: float, name: str) -> str:
    return f"round(quantile_cont(CAST({value} AS DOUBLE), {p}), 6) AS {name}"


@query("SELECT category, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, " + ", ".join(_q("value", p, n) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + f", round(count(*) FILTER (WHERE value > 0) / CAST(count(*) AS DOUBLE) * 100, 6) AS coverage_pct FROM pixels WHERE value <> {ND} GROUP BY category", "pixels")
def c13_exploration_statistics(spark, d):
    return raster.exploration(fx.pixels(spark, d), ND).select("category", "min", "max", *_r("mean", "median", "p25", "p75", "p90", "p95", "p99", "coverage_pct"))


@query(f", m AS (SELECT category, max(col_id) + 1 AS w, max(row_id) + 1 AS h FROM pixels WHERE value <> {ND} GROUP BY category) SELECT count(DISTINCT (w, h)) = 1 AS same_dimensions, count(DISTINCT 'EPSG:4326') = 1 AS same_crs, count(DISTINCT (CAST(360 AS DOUBLE) / w, CAST(-170 AS DOUBLE) / h)) = 1 AS same_resolution, count(*) AS rasters FROM m", "pixels")
def c14_raster_consistency(spark, d):
    """Whether the categories' data reach over one extent, and what resolution that would give."""
    reached = raster.valid(fx.pixels(spark, d), ND).groupBy("category").agg((F.max("col_id") + 1).alias("width"), (F.max("row_id") + 1).alias("height"))
    return raster.consistent(reached.select("width", "height", F.lit("EPSG:4326").alias("crs"), (F.lit(360.0) / F.col("width")).alias("px"), (F.lit(-170.0) / F.col("height")).alias("py")))


@query(f"SELECT category, round(avg(value), 6) AS mean, max(value) AS max, round(count(*) FILTER (WHERE value > 0) / CAST(count(*) AS DOUBLE) * 100, 6) AS traffic_pct FROM pixels WHERE value <> {ND} GROUP BY category", "pixels")
def c15_category_comparison(spark, d):
    return tiles.statistics(fx.raster_tiles(spark, d), ND).select("category", *_r("mean"), "max", F.round("nonzero_pct", 6).alias("traffic_pct"))


SUMMARY = ", ".join(f"CAST({f}(CAST({v} AS DOUBLE)) AS DOUBLE) AS {v}_{f}" for v in ("density", "intensity") for f in ("min", "max"))


@query(
    f", b AS (SELECT * FROM traffic UNION ALL SELECT 'global', latitude, longitude, density, intensity FROM traffic) SELECT category, count(*) AS rows, {SUMMARY}, " + ", ".join(f"round(avg(CAST({v} AS DOUBLE)), 6) AS {v}_mean, {_q(v, 0.5, f'{v}_median')}, {_q(v, 0.95, f'{v}_p95')}, {_q(v, 0.99, f'{v}_p99')}" for v in ("density", "intensity")) + " FROM b GROUP BY category",
    "traffic",
)
def c16_summary_statistics(spark, d):
    s = validate.summary_statistics(fx.traffic(spark, d))
    return s.select("category", "rows", *[f"{v}_{f}" for v in ("density", "intensity") for f in ("min", "max")], *_r(*[f"{v}_{f}" for v in ("density", "intensity") for f in ("mean", "median", "p95", "p99")]))


@query(", x AS (SELECT category, log10(CAST(density + 1 AS DOUBLE)) AS x FROM traffic), l AS (SELECT category, min(x) AS lo, max(x) AS hi FROM x GROUP BY category) SELECT category, CAST(least(floor((x - lo) / (hi - lo) * 60) + 1, 60) AS INT) AS bin, count(*) AS n FROM x JOIN l USING (category) GROUP BY ALL", "traffic")
def c17_log_histogram(spark, d):
    return validate.equal_width_histogram(fx.traffic(spark, d))


@query(
    "SELECT category, count(*) AS rows, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max, count(*) FILTER (WHERE latitude < -90 OR latitude > 90) AS invalid_lat_rows, count(*) FILTER (WHERE longitude < -180 OR longitude > 180) AS invalid_lon_rows, count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL OR density IS NULL OR intensity IS NULL) AS missing_rows, min(density) AS density_min, max(density) AS density_max, CAST(min(intensity) AS DOUBLE) AS intensity_min, CAST(max(intensity) AS DOUBLE) AS intensity_max, "
    + _q("intensity", 0.95, "intensity_p95") + ", " + _q("intensity", 0.99, "intensity_p99") + " FROM traffic GROUP BY category",
    "traffic",
)
def c18_point_diagnostics(spark, d):
    x = validate.point_diagnostics(fx.traffic(spark, d))
    return x.select(*[c for c in x.columns if not c.startswith("intensity_p")], *_r("intensity_p95", "intensity_p99"))


KEPT = f"value <> {ND} AND value > 0"


@query(f"SELECT category, count(*) AS total, count(*) FILTER (WHERE {KEPT}) AS kept, min(value) FILTER (WHERE {KEPT}) AS min, max(value) FILTER (WHERE {KEPT}) AS max, round(avg(value) FILTER (WHERE {KEPT}), 6) AS mean, round(quantile_cont(CAST(value AS DOUBLE), 0.5) FILTER (WHERE {KEPT}), 6) AS median, round((1 - count(*) FILTER (WHERE {KEPT}) / CAST(count(*) AS DOUBLE)) * 100, 6) AS reduction_pct FROM pixels GROUP BY category", "pixels")
def c21_export_summary(spark, d):
    return raster.export_summary(fx.pixels(spark, d), ND).select("category", "total", "kept", "min", "max", *_r("mean", "median", "reduction_pct"))


@query()
def c22_payload_summary(spark, d):
    return serving.payload_summary(_weighted(spark, d), c9_source_rows(spark, d), fx.taxonomy(spark, d))


@query(
    WEIGHTED + ", f AS (SELECT resolution, top_category, count(*) AS n FROM w WHERE weight >= 0.01 GROUP BY ALL) SELECT 'categories' AS section, top_category AS key, CAST(1 AS BIGINT) AS n FROM f GROUP BY 2 UNION ALL SELECT 'feature_counts', resolution || '/' || top_category, n FROM f "
    "UNION ALL SELECT 'source_rows', coalesce(category, 'global'), count(*) FROM traffic GROUP BY ROLLUP (category) UNION ALL SELECT 'subcategory_counts', r_name, count(*) FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 2",
    "traffic",
)
def c22_payload_entries(spark, d):
    """The payload's JSON document, read again: a row for each entry of each section."""
    counts = "map<string,bigint>"
    read = F.from_json("document", f"categories array<string>, feature_counts {counts}, source_rows {counts}, subcategory_counts {counts}")
    doc = c22_payload_summary(spark, d).select(read.alias("r"))
    names = doc.select(F.lit("categories").alias("section"), F.explode("r.categories").alias("key"), F.lit(1).cast("long").alias("n"))
    for section in ("feature_counts", "source_rows", "subcategory_counts"):
        names = names.unionByName(doc.select(F.lit(section).alias("section"), F.explode(f"r.{section}").alias("key", "n")))
    return names


@query("SELECT r_name AS category, n_name AS subcategory, CAST(count(*) OVER (PARTITION BY r_name) AS BIGINT) AS n FROM region JOIN nation ON r_regionkey = n_regionkey")
def c23_taxonomy(spark, d):
    s = serving.subcategories(fx.taxonomy(spark, d))
    return s.withColumn("n", F.count("*").over(Window.partitionBy("category")))


# ---- ranks and top k


@query(", " + _cells("traffic", 1.0) + " SELECT lat_bin, lon_bin, density_sum, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY density_sum DESC, lat_idx, lon_idx) AS rank FROM cells)", "traffic")
def d2_sorted_grid(spark, d):
    cells = grid.aggregate_grid(fx.traffic(spark, d), 1.0)
    return pointpattern.ranked(cells, [F.desc("density_sum"), F.asc("lat_idx"), F.asc("lon_idx")], "rank").select("lat_bin", "lon_bin", "density_sum", "rank")


IN_COUNTRY = ", " + _cells("traffic", 1.0) + ", z AS (SELECT country, avg(density_mean) AS mean_density, avg(intensity_mean) AS mean_intensity, CAST(sum(density_sum) AS BIGINT) AS total_density, CAST(sum(points) AS BIGINT) AS points, count(*) AS cells FROM cells JOIN countries ON lon_bin > lon0 AND lon_bin < lon1 AND lat_bin > lat0 AND lat_bin < lat1 GROUP BY country)"


def _zones(spark, d):
    return geo.zonal_statistics(grid.aggregate_grid(fx.traffic(spark, d), 1.0), fx.countries(spark, d))


@query(IN_COUNTRY + " SELECT country, round(mean_density, 4) AS mean_density FROM z ORDER BY z.mean_density DESC, country LIMIT 20", "traffic", "countries")
def d3_top_countries(spark, d):
    return _zones(spark, d).orderBy(F.desc("mean_density"), "country").limit(20).select("country", *_r("mean_density", digits=4))


@query("SELECT category, latitude, longitude, density, round(CAST(intensity AS DOUBLE) / CAST(max(intensity) OVER (PARTITION BY category) AS DOUBLE), 9) AS intensity_normalized FROM traffic", "traffic")
def d4_max_normalised(spark, d):
    x = grid.normalised_by_max(fx.traffic(spark, d).withColumn("intensity", F.col("intensity").cast("double")), "intensity", ["category"], "intensity_normalized")
    return x.select("category", "latitude", "longitude", "density", *_r("intensity_normalized", digits=9))


def _seam(a: str, b: str, n: int, name: str) -> str:
    strip = max(8, min(40, W // 30))
    return f"(SELECT category, avg(abs(CAST(p.value AS DOUBLE) - q.value)) AS {name} FROM v p JOIN v q USING (category, {b}) WHERE p.{a} < {strip} AND q.{a} = p.{a} + {n - strip} GROUP BY category)"


def _inner(a: str, b: str, name: str) -> str:
    return f"(SELECT category, avg(abs(CAST(p.value AS DOUBLE) - q.value)) AS {name} FROM v p JOIN v q USING (category, {b}) WHERE p.{a} % 256 = 0 AND q.{a} = p.{a} - 1 GROUP BY category)"


@query(
    f", v AS (SELECT * FROM pixels WHERE value <> {ND}) SELECT c.category, round(coalesce(left_right_diff, 0), 4) AS left_right_diff, round(coalesce(top_bottom_diff, 0), 4) AS top_bottom_diff, round(coalesce(vertical_seams, 0), 4) AS vertical_seams, round(coalesce(horizontal_seams, 0), 4) AS horizontal_seams FROM (SELECT DISTINCT category FROM v) c "
    f"LEFT JOIN {_seam('col_id', 'row_id', W, 'left_right_diff')} USING (category) LEFT JOIN {_seam('row_id', 'col_id', H, 'top_bottom_diff')} USING (category) LEFT JOIN {_inner('col_id', 'row_id', 'vertical_seams')} USING (category) LEFT JOIN {_inner('row_id', 'col_id', 'horizontal_seams')} USING (category)",
    "pixels",
)
def d6_seam_metrics(spark, d):
    m = validate.seam_metrics(raster.valid(fx.pixels(spark, d), ND), H, W)
    return m.select("category", *_r("left_right_diff", "top_bottom_diff", "vertical_seams", "horizontal_seams", digits=4))


TIERS = ", ".join(f"quantile_cont(CAST(density AS DOUBLE), {p}) OVER (PARTITION BY category) AS {n}" for n, p in (("a", 0.95), ("b", 0.98), ("c", 0.99), ("e", 0.995)))


@query(f"SELECT category, tier, count(*) AS n FROM (SELECT category, CASE WHEN density >= e THEN 'p99.5' WHEN density >= c THEN 'p99' WHEN density >= b THEN 'p98' WHEN density >= a THEN 'p95' ELSE 'base' END AS tier FROM (SELECT *, {TIERS} FROM traffic)) GROUP BY ALL", "traffic")
def d7_density_tiers(spark, d):
    return validate.density_tiers(fx.traffic(spark, d)).groupBy("category", "tier").agg(F.count("*").alias("n"))


@query(
    ", " + _cells("traffic", 1.0, "category,") + ", s AS (SELECT a.category, a.lat_idx, a.lon_idx, sum(CAST(b.density_sum AS DOUBLE)) AS s, count(*) AS w FROM cells a JOIN cells b ON a.category = b.category AND b.lat_idx BETWEEN a.lat_idx - 1 AND a.lat_idx + 1 AND b.lon_idx BETWEEN a.lon_idx - 1 AND a.lon_idx + 1 GROUP BY ALL), g AS (SELECT category, avg(CAST(density_sum AS DOUBLE)) AS m, stddev_pop(CAST(density_sum AS DOUBLE)) AS sd, count(*) AS n FROM cells GROUP BY category), "
    "z AS (SELECT *, (s - m * w) / (sd * sqrt((n * w - w * w) / CAST(n - 1 AS DOUBLE))) AS gi FROM cells JOIN s USING (category, lat_idx, lon_idx) JOIN g USING (category)) "
    "SELECT category, lat_bin, lon_bin, density_sum, round(gi, 5) AS gi_star, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY density_sum * gi DESC, lat_idx, lon_idx) AS rank FROM z WHERE gi > 1.96) WHERE rank <= 20",
    "traffic",
)
def d8_top_hotspots(spark, d):
    cells = autocorr.getis_ord_by(materialize(grid.aggregate_grid(fx.traffic(spark, d), 1.0, ["category"])), ["category"], "density_sum").where("gi_star > 1.96")
    order = [F.desc(F.col("density_sum") * F.col("gi_star")), F.asc("lat_idx"), F.asc("lon_idx")]
    return validate.top_by(cells, ["category"], order, 20).select("category", "lat_bin", "lon_bin", "density_sum", *_r("gi_star", digits=5), "rank")


# ---- joins


@query(", " + _cells("traffic", 1.0) + " SELECT country, lat_bin, lon_bin FROM cells JOIN countries ON lon_bin > lon0 AND lon_bin < lon1 AND lat_bin > lat0 AND lat_bin < lat1", "traffic", "countries")
def e1_point_in_polygon(spark, d):
    cells = grid.aggregate_grid(fx.traffic(spark, d), 1.0).select("lat_bin", "lon_bin", F.col("lon_bin").alias("longitude"), F.col("lat_bin").alias("latitude"))
    return geo.within(cells, fx.countries(spark, d)).select("country", "lat_bin", "lon_bin")


ZONE_COLUMNS = "round(mean_density, 4) AS mean_density, round(mean_intensity, 6) AS mean_intensity, total_density, points, cells"


@query(IN_COUNTRY + f" SELECT country, {ZONE_COLUMNS} FROM z", "traffic", "countries")
def e2_zonal_statistics(spark, d):
    return _zones(spark, d).select("country", *_r("mean_density", digits=4), *_r("mean_intensity"), "total_density", "points", "cells")


@query(IN_COUNTRY + " SELECT country, round(coalesce(mean_density, 0), 4) AS mean_density, coalesce(total_density, 0) AS total_density, coalesce(cells, 0) AS cells FROM countries LEFT JOIN z USING (country)", "traffic", "countries")
def e3_choropleth(spark, d):
    c = fx.countries(spark, d)
    return geo.choropleth(c, _zones(spark, d)).select("country", *_r("mean_density", digits=4), "total_density", "cells")


@query("SELECT category, count(*) AS n FROM (SELECT category FROM traffic UNION ALL SELECT 'global' FROM traffic) GROUP BY category", "traffic")
def e4_global_union(spark, d):
    t = fx.traffic(spark, d)
    return t.unionByName(t.withColumn("category", F.lit("global"))).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT category, latitude, longitude, density, CAST(intensity AS DOUBLE) AS intensity FROM (SELECT *, quantile_cont(CAST(density AS DOUBLE), 0.9) OVER (PARTITION BY category) AS p FROM traffic) WHERE density >= p", "traffic")
def e5_combined_hotspots(spark, d):
    t = fx.traffic(spark, d)
    parts = [raster.hotspots(serving.in_categories(t, [c])) for c in serving.CATEGORIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("category", "latitude", "longitude", "density", F.col("intensity").cast("double").alias("intensity"))


def _haversine(lon1, lat1, lon2, lat2) -> str:
    return f"2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


ANCHOR_ROWS = "anchors AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for k, n, x, y in fx.ANCHORS) + ") AS a(kind, name, lon, lat))"


@query(", " + _cells("traffic", 1.0) + f", {ANCHOR_ROWS} SELECT lat_bin, lon_bin, round(min(CASE WHEN kind = 'port' THEN {_haversine('lon_bin', 'lat_bin', 'lon', 'lat')} END), 4) AS distance_to_port_km, round(min(CASE WHEN kind = 'strait' THEN {_haversine('lon_bin', 'lat_bin', 'lon', 'lat')} END), 4) AS distance_to_strait_km FROM cells, anchors GROUP BY ALL", "traffic")
def e6_nearest_anchor(spark, d):
    c = grid.aggregate_grid(fx.traffic(spark, d), 1.0).withColumn("longitude", F.col("lon_bin")).withColumn("latitude", F.col("lat_bin"))
    a = fx.anchors(spark)
    x = geo.nearest_anchor_km(geo.nearest_anchor_km(c, a, "port", "distance_to_port_km"), a, "strait", "distance_to_strait_km")
    return x.select("lat_bin", "lon_bin", *_r("distance_to_port_km", "distance_to_strait_km", digits=4))


def _features(spark, d):
    """One-degree cells of traffic with the engineered distances and the log of density."""
    c = grid.aggregate_grid(fx.traffic(spark, d), 1.0).withColumn("longitude", F.col("lon_bin")).withColumn("latitude", F.col("lat_bin"))
    a = fx.anchors(spark)
    x = geo.nearest_anchor_km(geo.nearest_anchor_km(c, a, "port", "distance_to_port_km"), a, "strait", "distance_to_strait_km")
    return geo.boundary_km(x.withColumn("log_density", F.log1p(F.col("density_sum").cast("double"))), fx.countries(spark, d))


def _plane(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    return f"{fn.WGS84_A * _K0!r} * radians({lon})", f"{fn.WGS84_A / (2 * _K0)!r} * {1 - _E2!r} * ({s} / (1 - {_E2!r} * {s} * {s}) - {1 / (2 * _E)!r} * ln((1 - {_E!r} * {s}) / (1 + {_E!r} * {s})))"


def _to_rectangles() -> str:
    """SQL of the distance from cells to the nearest side of the countries, which are rectangles in the plane too."""
    (px, py), (x0, y0), (x1, y1) = _plane("lon_bin", "lat_bin"), _plane("lon0", "lat0"), _plane("lon1", "lat1")
    side = lambda along, lo, hi, across, at: f"sqrt(pow(greatest({lo} - {along}, 0, {along} - {hi}), 2) + pow({across} - {at}, 2))"
    sides = [side("px", "x0", "x1", "py", y) for y in ("y0", "y1")] + [side("py", "y0", "y1", "px", x) for x in ("x0", "x1")]
    return f", c AS (SELECT lat_bin, lon_bin, {px} AS px, {py} AS py FROM cells), r AS (SELECT {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1 FROM countries) SELECT lat_bin, lon_bin, round(min(least({', '.join(sides)})) / 1000, 4) AS distance_to_coast_km FROM c, r GROUP BY lat_bin, lon_bin"


@query(", " + _cells("traffic", 1.0) + _to_rectangles(), "traffic", "countries")
def e7_boundary_distance(spark, d):
    cells = grid.aggregate_grid(fx.traffic(spark, d), 1.0).withColumn("longitude", F.col("lon_bin")).withColumn("latitude", F.col("lat_bin"))
    return geo.boundary_km(cells, fx.countries(spark, d)).select("lat_bin", "lon_bin", *_r("distance_to_coast_km", digits=4))


def _hot_points(spark, d):
    cells = grid.aggregate_grid(fx.clustered(spark, d), 0.5).withColumn("intensity_sum", F.round("intensity_sum", 4))
    return materialize(pointpattern.ranked_hotspots(cells).withColumn("id", F.col("hotspot_rank")).withColumn("longitude", F.col("lon_bin")).withColumn("latitude", F.col("lat_bin")))


PAIR = _haversine("a.lon_bin", "a.lat_bin", "b.lon_bin", "b.lat_bin")


@query(_hot("clustered") + f" SELECT a.hotspot_rank AS a, b.hotspot_rank AS b, round({PAIR}, 4) AS km FROM hot a JOIN hot b ON a.hotspot_rank <> b.hotspot_rank WHERE {PAIR} <= 150", "clustered")
def e8_radius_join(spark, d):
    return neighbors.radius_pairs(_hot_points(spark, d), 150.0).select("a", "b", *_r("km", digits=4))


@query(_hot("clustered") + f" SELECT a.hotspot_rank AS id, round(min({PAIR}), 4) AS km FROM hot a JOIN hot b ON a.hotspot_rank <> b.hotspot_rank GROUP BY 1", "clustered")
def e9_nearest_neighbour(spark, d):
    return neighbors.nearest_neighbour(_hot_points(spark, d)).select("id", *_r("km", digits=4))


@query(_hot("clustered") + f", {ANCHOR_ROWS} SELECT CAST(radius AS DOUBLE) AS km, count(*) AS n, round(avg(CASE WHEN near <= radius THEN 1.0 ELSE 0.0 END), 6) AS precision FROM (SELECT hotspot_rank, min({_haversine('lon_bin', 'lat_bin', 'lon', 'lat')}) AS near FROM hot, anchors WHERE kind = 'port' GROUP BY 1), (VALUES (50), (500), (2000)) AS r(radius) GROUP BY radius", "clustered")
def e11_port_precision(spark, d):
    hot, ports = _hot_points(spark, d), fx.anchors(spark)
    parts = [geo.port_precision(hot, ports, km).select(F.lit(km).alias("km"), "n", *_r("precision")) for km in (50.0, 500.0, 2000.0)]
    return parts[0].union(parts[1]).union(parts[2])


# ---- scalar functions


@query(
    "SELECT category, latitude, longitude, density, round(log10(CAST(density + 1 AS DOUBLE)), 6) AS log_intensity, round(ln(CAST(density + 1 AS DOUBLE)), 6) AS log_density, floor((latitude + 90) / 2) * 2 - 90 + 1 AS lat_centre, round(least(greatest(CAST(intensity AS DOUBLE) / 5, 0), 1), 5) AS clipped, round(cos(radians(latitude)), 6) AS area_weight, round(sqrt(CAST(density AS DOUBLE)), 6) AS root, CASE category WHEN 'oil_gas' THEN 'oil & gas' ELSE category END AS label FROM traffic",
    "traffic",
)
def f1_f2_f4_f5_f8_f11_f13_scalars(spark, d):
    v = F.col("density")
    return fx.traffic(spark, d).select("category", "latitude", "longitude", "density", F.round(fn.log_intensity(v), 6).alias("log_intensity"), F.round(F.log1p(v.cast("double")), 6).alias("log_density"), fn.bin_centre(fn.bin_index(F.col("latitude"), 2.0, 90.0), 2.0, 90.0).alias("lat_centre"), F.round(fn.clip01(F.col("intensity").cast("double") / 5), 5).alias("clipped"), F.round(fn.area_weight(F.col("latitude")), 6).alias("area_weight"), F.round(F.sqrt(v), 6).alias("root"), fn.display_label(F.col("category")).alias("label"))


@query(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, round({_haversine('(a.n_nationkey * 14 - 175)', '(a.n_nationkey % 5 * 24 - 60)', '(b.n_nationkey * 14 - 175)', '(b.n_nationkey % 5 * 24 - 60)')}, 4) AS km FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def f3_haversine(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 14 - 175).alias("lon"), (F.col("n_nationkey") % 5 * 24 - 60).alias("lat"))
    b = n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return n.join(b, "n_regionkey").select(F.col("n_nationkey").alias("a"), "b", F.round(fn.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("km"))




@query(
    f", s AS (SELECT DISTINCT latitude, longitude, sin(radians(latitude)) AS s FROM traffic) SELECT latitude, longitude, round({fn.WGS84_A * _K0!r} * radians(longitude), 2) AS x, round({fn.WGS84_A / (2 * _K0)!r} * {1 - _E2!r} * (s / (1 - {_E2!r} * s * s) - {1 / (2 * _E)!r} * ln((1 - {_E!r} * s) / (1 + {_E!r} * s))), 2) AS y FROM s",
    "traffic",
)
def f6_equal_area(spark, d):
    x, y = fn.equal_area_xy(F.col("longitude"), F.col("latitude"))
    return fx.traffic(spark, d).select("latitude", "longitude").distinct().select("latitude", "longitude", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("SELECT event_id, CASE WHEN (event_id % 100) / CAST(1000 AS DOUBLE) > 0.05 THEN 'NS' ELSE CASE event_id % 6 WHEN 1 THEN 'HH' WHEN 2 THEN 'LH' WHEN 3 THEN 'LL' WHEN 4 THEN 'HL' ELSE 'NS' END END AS label FROM events")
def f7_lisa_label(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fn.lisa_label(F.col("event_id") % 6, (F.col("event_id") % 100) / F.lit(1000.0)).alias("label"))


@query(f"SELECT category, row_id, col_id, round(least(greatest(CAST(value AS DOUBLE), 0), p), 4) AS value FROM (SELECT *, quantile_cont(CAST(value AS DOUBLE), 0.99) FILTER (WHERE value > 0) OVER (PARTITION BY category) AS p FROM pixels WHERE value <> {ND})", "pixels")
def f9_percentile_clip(spark, d):
    x = raster.clipped_at_percentile(raster.valid(fx.pixels(spark, d), ND), "value", 0.99, ["category"])
    return x.select("category", "row_id", "col_id", *_r("value", digits=4))


@query(f"SELECT category, row_id, col_id, round((value - avg(value) OVER w) / stddev_pop(CAST(value AS DOUBLE)) OVER w, 5) + 0.0 AS z, round(value / CAST(max(value) OVER w AS DOUBLE), 6) AS share FROM pixels WHERE value <> {ND} WINDOW w AS (PARTITION BY category)", "pixels")
def f10_normalisations(spark, d):
    v = raster.valid(fx.pixels(spark, d), ND)
    x = grid.normalised_by_max(grid.z_scores(v, "value", ["category"], "z"), "value", ["category"], "share")
    return x.select("category", "row_id", "col_id", (F.round("z", 5) + 0.0).alias("z"), *_r("share"))


@query("SELECT event_id, key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def f12_json_profile(spark, d):
    return validate.json_profile(spark.read.parquet(f"{d}/events.parquet"), "event_id", "props").select("event_id", "key", "kind")


@query("SELECT round(longitude, 6) AS lon_bin, round(latitude, 6) AS lat_bin, category AS top_category, CASE category WHEN 'commercial' THEN 'commercial_traffic' WHEN 'oil_gas' THEN 'oil_gas_traffic' ELSE 'passenger_traffic' END AS dataset_class, density, CAST(intensity AS DOUBLE) AS intensity FROM traffic", "traffic")
def f14_hotspot_features(spark, d):
    return serving.hotspot_features(fx.traffic(spark, d))


@query("SELECT round(latitude, 5) AS lat, round(longitude, 5) AS lon, density, CAST(intensity AS DOUBLE) AS intensity, category FROM traffic", "traffic")
def f14_hotspot_records(spark, d):
    return serving.hotspot_records(fx.traffic(spark, d))


# ---- point patterns

KDE = (
    _hot("clustered")
    + ", m AS (SELECT sum(w) AS sw, sum(w * w) AS sw2, sum(w * lon_bin) / sum(w) AS mx, sum(w * lat_bin) / sum(w) AS my FROM (SELECT *, round(intensity_sum, 4) AS w FROM hot)), c AS (SELECT sum(w * (lon_bin - mx) * (lon_bin - mx)) / any_value(sw) / (1 - any_value(sw2) / pow(any_value(sw), 2)) AS xx, sum(w * (lon_bin - mx) * (lat_bin - my)) / any_value(sw) / (1 - any_value(sw2) / pow(any_value(sw), 2)) AS xy, sum(w * (lat_bin - my) * (lat_bin - my)) / any_value(sw) / (1 - any_value(sw2) / pow(any_value(sw), 2)) AS yy, any_value(sw) AS sw, any_value(sw2) AS sw2 FROM (SELECT *, round(intensity_sum, 4) AS w FROM hot), m)"
    + ", h AS (SELECT xx * f AS xx, xy * f AS xy, yy * f AS yy, sw, (xx * yy - xy * xy) * f * f AS det FROM (SELECT *, pow(sw * sw / sw2, -1.0 / 3) AS f FROM c))"
)


@query(KDE + ", k AS (SELECT a.hotspot_rank, sum(round(b.intensity_sum, 4) / sw * exp(-0.5 * ((a.lon_bin - b.lon_bin) * (a.lon_bin - b.lon_bin) * yy - 2 * (a.lon_bin - b.lon_bin) * (a.lat_bin - b.lat_bin) * xy + (a.lat_bin - b.lat_bin) * (a.lat_bin - b.lat_bin) * xx) / det)) / (2 * pi() * sqrt(any_value(det))) AS kde FROM hot a, hot b, h GROUP BY 1) SELECT hotspot_rank, round(kde * 1000, 6) AS kde_milli, round(kde / (SELECT max(kde) FROM k), 6) AS kde_score_norm FROM k", "clustered")
def g1_d5_kernel_density(spark, d):
    k = pointpattern.kernel_density(_hot_points(spark, d), "intensity_sum")
    return k.select("hotspot_rank", F.round(F.col("kde_score") * 1000, 6).alias("kde_milli"), *_r("kde_score_norm"))


@query(
    _hot("clustered") + f", near AS (SELECT a.hotspot_rank, min({PAIR}) AS km FROM hot a JOIN hot b ON a.hotspot_rank <> b.hotspot_rank GROUP BY 1), b AS (SELECT count(*) AS n, greatest(1, (max(lon_bin) - min(lon_bin)) * (pi() * 6371.0088 / 180) * cos(radians(min(lat_bin))) * (max(lat_bin) - min(lat_bin)) * (pi() * 6371.0088 / 180)) AS area FROM hot) "
    "SELECT n, round(o, 4) AS observed_km, round(0.5 / sqrt(n / area), 4) AS expected_km, round(o / (0.5 / sqrt(n / area)), 6) AS ratio FROM b, (SELECT avg(km) AS o FROM near)",
    "clustered",
)
def g2_nearest_neighbour_ratio(spark, d):
    return pointpattern.nearest_neighbour_ratio(_hot_points(spark, d)).select("n", *_r("observed_km", "expected_km", digits=4), *_r("ratio"))


@query(
    _hot("clustered") + ", r AS (SELECT " + "unnest([" + ", ".join(repr(x) for x in pointpattern.radii()) + "]) AS radius), b AS (SELECT count(*) AS n, (max(lon_bin) - min(lon_bin)) * (max(lat_bin) - min(lat_bin)) AS area FROM hot), p AS (SELECT sqrt(pow(x.lon_bin - y.lon_bin, 2) + pow(x.lat_bin - y.lat_bin, 2)) AS dist FROM hot x JOIN hot y ON x.hotspot_rank <> y.hotspot_rank) "
    "SELECT round(radius, 6) AS radius, round(any_value(area) * count(dist) / CAST(any_value(n) * any_value(n) AS DOUBLE), 5) AS k FROM r CROSS JOIN b LEFT JOIN p ON dist <= radius GROUP BY r.radius",
    "clustered",
)
def g3_ripley_k(spark, d):
    return pointpattern.ripley_k(_hot_points(spark, d)).select(*_r("radius"), *_r("k", digits=5))


@query()
def g4_ripley_p_values(spark, d):
    return pointpattern.ripley_p(_hot_points(spark, d))


DBSCAN = (
    f", near AS (SELECT a.hotspot_rank AS a, b.hotspot_rank AS b FROM hot a JOIN hot b ON a.hotspot_rank <> b.hotspot_rank WHERE {PAIR} <= 150), core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5), joined AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), "
    "reach(id, root) AS (SELECT id, id FROM core UNION SELECT joined.b, reach.root FROM reach JOIN joined ON reach.id = joined.a), low AS (SELECT id, min(root) AS root FROM reach GROUP BY id), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM low)), "
    "label AS (SELECT id, c FROM low JOIN num USING (root) UNION ALL SELECT near.a, min(c) FROM near JOIN low ON low.id = near.b JOIN num USING (root) WHERE near.a NOT IN (SELECT id FROM core) GROUP BY near.a), clusters AS (SELECT hot.*, CAST(coalesce(c, -1) AS INT) AS cluster_id FROM hot LEFT JOIN label ON label.id = hot.hotspot_rank)"
)


@query(_hot("clustered") + DBSCAN + " SELECT hotspot_rank, lat_bin, lon_bin, cluster_id, cluster_id < 0 AS is_noise FROM clusters", "clustered")
def g5_c19_dbscan(spark, d):
    return pointpattern.dbscan(_hot_points(spark, d)).select("hotspot_rank", "lat_bin", "lon_bin", "cluster_id", "is_noise")


@query(_hot("clustered") + DBSCAN + ", size AS (SELECT cluster_id, count(*) AS n FROM clusters GROUP BY cluster_id) SELECT cluster_id, n, (SELECT count(*) FROM size WHERE cluster_id >= 0) AS clusters, CAST((SELECT coalesce(sum(n), 0) FROM size WHERE cluster_id < 0) AS BIGINT) AS noise FROM size", "clustered")
def c19_cluster_sizes(spark, d):
    counts = pointpattern.cluster_counts(pointpattern.dbscan(_hot_points(spark, d)))
    return counts.select(F.explode("sizes").alias("cluster_id", "n"), "clusters", "noise")


@query(
    KDE + DBSCAN + ", k AS (SELECT a.hotspot_rank, sum(round(b.intensity_sum, 4) / sw * exp(-0.5 * ((a.lon_bin - b.lon_bin) * (a.lon_bin - b.lon_bin) * yy - 2 * (a.lon_bin - b.lon_bin) * (a.lat_bin - b.lat_bin) * xy + (a.lat_bin - b.lat_bin) * (a.lat_bin - b.lat_bin) * xx) / det)) / (2 * pi() * sqrt(any_value(det))) AS kde FROM hot a, hot b, h GROUP BY 1) "
    "SELECT hotspot_rank, lon_bin AS lon, lat_bin AS lat, density_sum, points, round(kde * 1000, 6) AS kde_milli, cluster_id, cluster_id < 0 AS is_noise FROM clusters JOIN k USING (hotspot_rank)",
    "clustered",
)
def g6_feature_properties(spark, d):
    """The features' text, read again."""
    read = F.from_json("feature", "geometry struct<type:string,coordinates:array<double>>, properties struct<density_sum:bigint,points:bigint,hotspot_rank:bigint,kde_score:double,cluster_id:int,is_noise:boolean>")
    f = g6_cluster_features(spark, d).select(read.alias("f")).select("f.geometry.coordinates", "f.properties.*")
    return f.select("hotspot_rank", F.col("coordinates")[0].alias("lon"), F.col("coordinates")[1].alias("lat"), "density_sum", "points", F.round(F.col("kde_score") * 1000, 6).alias("kde_milli"), "cluster_id", "is_noise")


@query()
def g6_cluster_features(spark, d):
    k = pointpattern.dbscan(pointpattern.kernel_density(_hot_points(spark, d), "intensity_sum"))
    p = ["density_sum", "density_mean", "intensity_sum", "intensity_mean", "points", "hotspot_rank", "kde_score", "kde_score_norm", "cluster_id", "is_noise"]
    return k.select("hotspot_rank", tables.feature(F.col("lon_bin"), F.col("lat_bin"), p).alias("feature"), tables.feature(F.col("lon_bin"), F.col("lat_bin"), ["kde_score", "kde_score_norm", "intensity_sum"]).alias("kde_feature"))


@query()
def g7_pattern_metrics(spark, d):
    hot = _hot_points(spark, d)
    counts = pointpattern.cluster_counts(pointpattern.dbscan(hot))
    k = pointpattern.ripley_p(hot).agg(F.array_sort(F.collect_list(F.struct("radius", "k", "p_value"))).alias("ripley"))
    return pointpattern.nearest_neighbour_ratio(hot).crossJoin(counts).crossJoin(k)


@query(
    _hot("clustered") + DBSCAN + " SELECT cluster_id, round(avg(lon_bin), 6) AS centre_lon, round(avg(lat_bin), 6) AS centre_lat, min(lon_bin) AS west, max(lon_bin) AS east, min(lat_bin) AS south, max(lat_bin) AS north, CAST(sum(density_sum) AS BIGINT) AS total_density, max(density_sum) AS max_density, count(*) AS size FROM clusters WHERE cluster_id >= 0 GROUP BY cluster_id",
    "clustered",
)
def g8_cluster_profiles(spark, d):
    profile = pointpattern.cluster_profile(pointpattern.dbscan(_hot_points(spark, d)))
    return profile.withColumns({c: F.round(c, 6) for c in ("centre_lon", "centre_lat")})


@query()
def g9_planar_dbscan(spark, d):
    pixels = grid.aggregate_grid(fx.pixelled(spark, d), 0.005).where("density_sum > 10000")
    order = [F.desc("density_sum"), F.asc("lat_idx"), F.asc("lon_idx")]
    x = pointpattern.ranked(pixels, order, "hotspot_rank").withColumn("longitude", F.col("lon_bin")).withColumn("latitude", F.col("lat_bin"))
    return pointpattern.dbscan(materialize(x), 0.05, 10, "planar").select("hotspot_rank", "lat_idx", "lon_idx", "cluster_id", "is_noise")


# ---- autocorrelation and regression on one-degree cells


def _cells_and_weights(spark, d):
    c = materialize(grid.aggregate_grid(fx.traffic(spark, d), 1.0).withColumn("log_density", F.log1p(F.col("density_sum").cast("double"))))
    return c, materialize(neighbors.knn_grid(c))


# Neighbours are looked for in a square of steps, which is wide where cells are few.
KNN = (
    ", " + _cells("traffic", 1.0)
    + ", reach AS (SELECT CASE WHEN count(*) > 20000 THEN 12 ELSE 45 END AS r FROM cells), step AS (SELECT unnest(range(-r, r + 1)) AS s FROM reach), steps AS (SELECT CAST(a.s AS INT) AS di, CAST(b.s AS INT) AS dj FROM step a, step b WHERE a.s <> 0 OR b.s <> 0)"
    + ", val AS (SELECT lat_idx, lon_idx, ln(CAST(density_sum + 1 AS DOUBLE)) AS v FROM cells)"
    + ", knn AS (SELECT * FROM (SELECT a.lat_idx AS src_lat, a.lon_idx AS src_lon, b.lat_idx AS dst_lat, b.lon_idx AS dst_lon, b.v, row_number() OVER (PARTITION BY a.lat_idx, a.lon_idx ORDER BY di * di + dj * dj, b.lat_idx, b.lon_idx) AS rank FROM val a CROSS JOIN steps JOIN val b ON b.lat_idx = a.lat_idx + di AND b.lon_idx = a.lon_idx + dj) WHERE rank <= 8)"
    + ", lag AS (SELECT src_lat AS lat_idx, src_lon AS lon_idx, avg(v) AS lag FROM knn GROUP BY 1, 2)"
)


@query(KNN + " SELECT src_lat, src_lon, dst_lat, dst_lon, CAST(rank AS INT) AS rank, CAST(0.125 AS DOUBLE) AS w FROM knn", "traffic")
def e10_h1_knn_weights(spark, d):
    return _cells_and_weights(spark, d)[1].select("src_lat", "src_lon", "dst_lat", "dst_lon", F.col("rank").cast("int").alias("rank"), "w")


@query(KNN + " SELECT lat_idx, lon_idx, round(lag, 6) AS lag FROM lag", "traffic")
def h2_spatial_lag(spark, d):
    c, w = _cells_and_weights(spark, d)
    return neighbors.spatial_lag(c, w, "log_density").select("lat_idx", "lon_idx", *_r("lag"))


@query(KNN + ", z AS (SELECT v - (SELECT avg(v) FROM val) AS z, lag - (SELECT avg(v) FROM val) AS lz FROM val JOIN lag USING (lat_idx, lon_idx)) SELECT count(*) AS n, round(sum(z * lz) / sum(z * z), 6) AS moran_i, round(-1.0 / (count(*) - 1), 8) AS expected_i FROM z", "traffic")
def h3_moran(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.moran(c, w, "log_density").select("n", *_r("moran_i"), *_r("expected_i", digits=8))


@query()
def h4_moran_permutations(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.moran_permutations(c, w, "log_density")


@query(
    KNN + ", z AS (SELECT v - (SELECT avg(v) FROM val) AS z, lag - (SELECT avg(v) FROM val) AS lz FROM val JOIN lag USING (lat_idx, lon_idx)), m AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z * lz) AS zl, sum(z * z) AS zz, count(*) * sum(z * z * z * z) / pow(sum(z * z), 2) AS k FROM z), w AS (SELECT src_lat * 1000 + src_lon AS a, dst_lat * 1000 + dst_lon AS b, 0.125 AS w FROM knn), "
    "s1 AS (SELECT sum(w * w) AS s1 FROM (SELECT CAST(sum(w) AS DOUBLE) AS w FROM w GROUP BY least(a, b), greatest(a, b))), s2 AS (SELECT sum(w * w) AS s2 FROM (SELECT CAST(sum(w) AS DOUBLE) AS w FROM (SELECT a AS i, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY i)), "
    "v AS (SELECT n, zl / zz AS i, -1 / (n - 1) AS e, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * n * n) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * n * n)) / ((n - 1) * (n - 2) * (n - 3) * n * n) AS q FROM m, s1, s2) "
    "SELECT CAST(n AS BIGINT) AS n, round(i, 6) AS moran_i, round(e, 8) AS expected_i, round((q - e * e) * 1000, 6) AS variance_milli, round((i - e) / sqrt(q - e * e), 4) AS z_norm FROM v",
    "traffic",
)
def h4_moran_moments(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.moran_moments(c, w, "log_density").select("n", *_r("moran_i"), *_r("expected_i", digits=8), F.round(F.col("variance") * 1000, 6).alias("variance_milli"), *_r("z_norm", digits=4))


@query(KNN + ", z AS (SELECT lat_idx, lon_idx, v - (SELECT avg(v) FROM val) AS z, lag - (SELECT avg(v) FROM val) AS lz FROM val JOIN lag USING (lat_idx, lon_idx)) SELECT lat_idx, lon_idx, round(z * lz * (SELECT (count(*) - 1) / sum(z * z) FROM z), 5) AS local_i, CASE WHEN z > 0 AND lz > 0 THEN 1 WHEN z <= 0 AND lz > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM z", "traffic")
def h5_local_moran(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.local_moran(c, w, "log_density").select("lat_idx", "lon_idx", *_r("local_i", digits=5), "quadrant")


@query()
def h6_h7_c20_lisa(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.lisa(c, w, "log_density").select("lat_idx", "lon_idx", "local_i", "quadrant", "p_sim", "lisa_cluster")


@query(KNN + " SELECT round(regr_slope(lag, v), 6) AS slope, round(regr_intercept(lag, v), 5) AS intercept, round(avg(v), 6) AS mean_value, round(avg(lag), 6) AS mean_lag FROM val JOIN lag USING (lat_idx, lon_idx)", "traffic")
def h8_moran_scatter(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.scatter_line(c, w, "log_density").select(*_r("slope"), *_r("intercept", digits=5), *_r("mean_value", "mean_lag"))


@query()
def h9_feature_table(spark, d):
    f = materialize(_features(spark, d))
    w = materialize(neighbors.knn_grid(f))
    lagged = neighbors.spatial_lag(f, w, "log_density", "spatial_lag_log_density")
    local = autocorr.lisa(f, w, "log_density").select("lat_idx", "lon_idx", "local_i", "quadrant", "p_sim", "lisa_cluster")
    return lagged.join(local, ["lat_idx", "lon_idx"]).select("lat_bin", "lon_bin", "density_sum", "density_mean", "intensity_sum", "intensity_mean", "points", "log_density", "distance_to_port_km", "distance_to_strait_km", "distance_to_coast_km", "spatial_lag_log_density", "local_i", "quadrant", "p_sim", "lisa_cluster")


@query()
def h10_autocorrelation_summary(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.summary(c, w, "log_density")


@query(
    KNN + ", own AS (SELECT src_lat, src_lon, v FROM knn UNION ALL SELECT lat_idx, lon_idx, v FROM val), s AS (SELECT src_lat AS lat_idx, src_lon AS lon_idx, sum(v) AS s, count(*) AS w FROM own GROUP BY 1, 2), g AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM val) "
    "SELECT lat_idx, lon_idx, round((s - m * w) / (sd * sqrt((n * w - w * w) / CAST(n - 1 AS DOUBLE))), 5) AS gi_star FROM s, g",
    "traffic",
)
def h11_getis_ord(spark, d):
    c, w = _cells_and_weights(spark, d)
    return autocorr.getis_ord(c, w, "log_density").select("lat_idx", "lon_idx", *_r("gi_star", digits=5))


@query(
    ", " + _cells("traffic", 1.0) + ", val AS (SELECT lat_idx, lon_idx, ln(CAST(density_sum + 1 AS DOUBLE)) AS v FROM cells), step AS (SELECT CAST(unnest(range(-4, 5)) AS INT) AS s), near AS (SELECT a.lat_idx, a.lon_idx, b.v, exp(-0.5 * (di.s * di.s + dj.s * dj.s)) AS w FROM val a CROSS JOIN step di CROSS JOIN step dj JOIN val b ON b.lat_idx = a.lat_idx + di.s AND b.lon_idx = a.lon_idx + dj.s) SELECT lat_idx, lon_idx, round(sum(v * w) / sum(w), 6) AS smooth FROM near GROUP BY 1, 2",
    "traffic",
)
def h12_gaussian_smoothing(spark, d):
    c = grid.aggregate_grid(fx.traffic(spark, d), 1.0).withColumn("v", F.log1p(F.col("density_sum").cast("double")))
    return grid.smoothed(c, "v", 1.0).select("lat_idx", "lon_idx", *_r("smooth"))


XS = ["port", "coast", "strait"]


def _model(spark, d):
    f = _features(spark, d)
    return materialize(f.select("lat_idx", "lon_idx", "log_density", (F.col("distance_to_port_km") / 1000).alias("port"), (F.col("distance_to_coast_km") / 1000).alias("coast"), (F.col("distance_to_strait_km") / 1000).alias("strait")))


LINE = ", x AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx, avg(x) AS mx, regr_r2(y, x) AS r2 FROM x), e AS (SELECT *, (1 - r2) * syy AS ssr FROM s)"


@query("WITH " + LINE[2:] + " SELECT 'const' AS variable, round(a, 4) AS coefficient, round(sqrt(ssr / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS std_error FROM e UNION ALL SELECT 'x', round(b, 4), round(sqrt(ssr / (n - 2) / sxx), 4) FROM e")
def i1_simple_regression(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return regression.ols(x, "y", ["x"])[0].select("variable", *_r("coefficient", "std_error", digits=4))


@query("WITH " + LINE[2:] + " SELECT n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / CAST(n - 2 AS DOUBLE), 6) AS adj_r2, round(n * (ln(2 * pi() * ssr / n) + 1) + 4, 3) AS aic, round(n * (ln(2 * pi() * ssr / n) + 1) + 2 * ln(n), 3) AS bic FROM e")
def i2_fit_statistics(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return regression.ols(x, "y", ["x"])[1].select("n", *_r("r2", "adj_r2"), *_r("aic", "bic", digits=3))


@query()
def i1_ols_table(spark, d):
    return regression.ols(_model(spark, d), "log_density", XS)[0]


@query()
def i3_residual_moran(spark, d):
    m = _model(spark, d)
    return regression.residual_moran(m, materialize(neighbors.knn_grid(m)), "log_density", XS)


@query()
def i4_i7_spatial_lag_model(spark, d):
    m = _model(spark, d)
    w = materialize(neighbors.knn_grid(m))
    coefficients, fit = regression.spatial_lag_model(m, w, "log_density", XS)
    return regression.documents(coefficients, fit)


@query(f", c AS (SELECT row_id, col_id, CAST(sum(value) AS BIGINT) AS part FROM pixels WHERE value <> {ND} AND category <> 'passenger' GROUP BY 1, 2), g AS (SELECT row_id, col_id, CAST(sum(value) AS BIGINT) AS whole FROM pixels WHERE value <> {ND} GROUP BY 1, 2), x AS (SELECT coalesce(whole, 0) AS whole, coalesce(part, 0) AS part FROM g FULL JOIN c USING (row_id, col_id)) SELECT count(*) AS cells, count(*) FILTER (WHERE whole > part) AS over, count(*) FILTER (WHERE whole < part) AS under, count(*) FILTER (WHERE whole = part) AS equal, CAST(sum(whole - part) AS BIGINT) AS residual_sum FROM x", "pixels")
def i5_residual_layer(spark, d):
    v = raster.valid(fx.pixels(spark, d), ND)
    return raster.residual(v, v.where("category <> 'passenger'"))


@query(", " + _cells("traffic", 1.0) + " SELECT lat_idx, lon_idx FROM cells ORDER BY ((CAST(lat_idx AS BIGINT) * 1000003 + CAST(lon_idx AS BIGINT) * 7919 + 42 * 104729) * 48271) % 2147483647, lat_idx, lon_idx LIMIT 4000", "traffic")
def i6_seeded_rows(spark, d):
    return regression.seeded_rows(grid.aggregate_grid(fx.traffic(spark, d), 1.0)).select("lat_idx", "lon_idx")


@query(
    ", dn AS (" + _down("round(sum(value) / CAST(count(*) AS DOUBLE))") + "), lg AS (SELECT category, row_id, col_id, log10(CAST(value AS DOUBLE) + 1) AS v FROM dn), cl AS (SELECT category, row_id, col_id, CASE WHEN p IS NULL THEN v ELSE least(greatest(v, 0), p) END AS v FROM (SELECT *, quantile_cont(v, 0.99) FILTER (WHERE v > 0) OVER (PARTITION BY category) AS p FROM lg)) SELECT category, row_id, col_id, round(CASE WHEN max(v) OVER (PARTITION BY category) > 0 THEN v / max(v) OVER (PARTITION BY category) ELSE v END, 5) AS value FROM cl",
    "pixels",
)
def i8_preprocess(spark, d):
    return raster.preprocess(fx.pixels(spark, d), H, W, ND, raster.PRESETS["global"]).select("category", "row_id", "col_id", *_r("value", digits=5))


@query(
    f", dn AS (SELECT category, CAST(row_id * 68 // 340 AS INT) AS row_id, CAST(col_id * 144 // 720 AS INT) AS col_id, round(sum(value) / CAST(count(*) AS DOUBLE)) AS value FROM pixels WHERE value <> {ND} GROUP BY 1, 2, 3), rt AS (SELECT category, row_id, col_id, sqrt(value) AS v FROM dn) SELECT category, row_id, col_id, round(CASE WHEN p IS NULL THEN v ELSE least(greatest(v, 0), p) END, 5) AS value FROM (SELECT *, quantile_cont(v, 0.995) FILTER (WHERE v > 0) OVER (PARTITION BY category) AS p FROM rt)",
    "pixels",
)
def i8_preprocess_regional(spark, d):
    return raster.preprocess(fx.pixels(spark, d), H, W, ND, raster.PRESETS["regional"]).select("category", "row_id", "col_id", *_r("value", digits=5))


@query(f"SELECT category, row_id, col_id, CAST(CASE WHEN value < 10 THEN 0 ELSE value END AS DOUBLE) AS value FROM pixels WHERE value <> {ND}", "pixels")
def i8_preprocess_analysis(spark, d):
    return raster.preprocess(fx.pixels(spark, d), H, W, ND, raster.PRESETS["analysis"]).select("category", "row_id", "col_id", "value")


@query("SELECT category, true AS no_negatives, true AS max_ok, true AS not_all_null, true AS same_rows FROM pixels GROUP BY category", "pixels")
def i9_preprocess_checks(spark, d):
    p = fx.pixels(spark, d)
    return raster.preprocess_checks(p, raster.preprocess(p, H, W, ND, raster.PRESETS["analysis"]), ND)


@query(STATS, "pixels")
def j1_streaming_statistics(spark, d):
    from gridwake.streaming import raster_stats

    arriving = _folder(spark)
    fx.raster_tiles(spark, d).write.partitionBy("tile_row").parquet(arriving)
    s = raster_stats.run(spark, arriving, _folder(spark), _folder(spark), ND)
    s = s.withColumn("zero_pct", F.col("zeros") / F.col("valid") * 100).withColumn("nonzero_pct", F.col("nonzeros") / F.col("valid") * 100)
    return s.select("category", "valid", "zeros", "nonzeros", "min", "max", *_r("mean"), *_r("std", digits=4), *_r("zero_pct", "nonzero_pct"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to half-degree cells, the top twentieth by density, ranked."""
    return b6_d1_ranked_hotspots(spark, sf_dir)

